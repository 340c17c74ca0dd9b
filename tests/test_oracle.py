"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from bindings.registry import ORACLES as WITH_SQL
from bindings.registry import QUERIES as REGISTERED

SF_DIR = "/root/testdata/sf0.001"
# These have no row on the smallest tables.
LARGER = "/root/testdata/sf0.01"
ON_LARGER = {
    "having_min_count", "filter_level_members", "density_2d", "density_bands", "patient_points", "pie_map", "disease_regions",
    "disease_ages", "disease_age_outliers", "disease_age_histogram", "cohort_labs", "important_tests",
    "followup_of_positive", "paired_lab_results", "age_band_summary", "age_band_points", "village_geo",
    "village_counts_corrected_after", "patient_map", "patient_map_file", "age_band_persons", "shared_coordinates",
    "repeated_villages",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
QUERIES = {name: fn for name, fn in entry.queries().items() if name in REGISTERED}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    def connect(sf_dir):
        con = duckdb.connect()
        for name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        return con

    return {sf_dir: connect(sf_dir) for sf_dir in (SF_DIR, LARGER)}


def comparable(x):
    if hasattr(x, "as_tuple"):
        x = float(x)
    return None if isinstance(x, float) and math.isnan(x) else x


def in_order(table):
    def key(row):
        return tuple((x is None, x if isinstance(x, (int, float)) else 0, "" if x is None else str(x)) for x in row)

    return sorted(table, key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    sf_dir = LARGER if name in ON_LARGER else SF_DIR
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = in_order(tuple(comparable(x) for x in r) for r in df.select(*columns).collect())
    result = duck[sf_dir].execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = in_order(tuple(comparable(r[i]) for i in places) for r in result.fetchall())
    assert got == want and got


def test_every_query_has_sql():
    assert set(QUERIES) == set(WITH_SQL) == set(REGISTERED)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["p_name", "diag_count", "inv_rank"]
    assert df.count() >= 10

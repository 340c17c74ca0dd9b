"""What the planner makes of the operators."""

import re

import pytest

import __spark_entry__ as entry
from bindings.views import Views
from cohortlens import functions as fn
from cohortlens import operators as op

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calendar_filter_reaches_the_scan(spark):
    orders = Views(spark, SF_DIR).table("orders")
    plan = plan_of(orders.filter(fn.calendar_parts("o_orderdate", 1998, 3)).select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate,1998-03-01T00:00)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name, columns", [
    ("count_by_two", {"l_returnflag", "l_linestatus"}),
    ("histogram_20", {"value", "event_type"}),
    ("topn_within", {"l_returnflag", "l_suppkey"}),
])
def test_scans_read_only_needed_columns(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan_of(QUERIES[name](spark, SF_DIR)))
    assert schemas
    for schema in schemas:
        assert {f.split(":")[0] for f in schema.split(",")} <= columns


def test_no_plan_has_a_cartesian_product_or_python_rows(spark):
    for name, build in QUERIES.items():
        plan = plan_of(build(spark, SF_DIR))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "BatchEvalPython" not in plan, name


def test_global_rank_windows_never_see_the_rows(spark):
    """The only window without partition columns runs over the chunk totals."""
    counts = op.count_by(Views(spark, SF_DIR).table("lineitem"), "l_partkey")
    plan = plan_of(op.add_rank(counts, "count"))
    for line in plan.splitlines():
        if "Window [" in line and "_chunk" not in line:
            pytest.fail(line)
        if "SinglePartition" in line:
            assert "_chunk" in plan


def test_top_n_within_trims_before_the_shuffle(spark):
    counts = op.count_by(Views(spark, SF_DIR).table("lineitem"), "l_returnflag", "l_suppkey")
    assert "WindowGroupLimit" in plan_of(op.top_n(counts, 5, "count", within=["l_returnflag"]))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_results_do_not_depend_on_shuffle_partitions(spark, partitions):
    def result():
        return {
            name: sorted(map(str, QUERIES[name](spark, SF_DIR).collect()))
            for name in ("quantiles_101", "rank_dense_within", "diag_top_regions", "first_per_key")
        }

    want = result()
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert result() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")

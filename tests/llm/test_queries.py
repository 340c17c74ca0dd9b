"""The registered queries against their SQL, and the pipeline against brute force."""

import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from cohortlens.llm import queries
from cohortlens.llm.exact_dedup import kept_rows
from cohortlens.llm.quality_rules import quality_verdicts
from tests.llm.odd import odd_documents, odd_rows, similar, without_repeats
from tests.test_oracle import comparable, in_order

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "benchmark"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = in_order(tuple(comparable(x) for x in r) for r in df.select(*columns).collect())
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = in_order(tuple(comparable(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_covers_its_table(spark, name):
    got = queries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").distinct().count()


def test_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_stages_agree_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    exact = corpus_pipeline.exact(spark, docs, SF_DIR)
    first = {}
    for i in sorted(rows):
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]).encode()).hexdigest(), i)
    assert {r.doc_id for r in exact.collect()} == set(first.values()) and exact.columns == docs.columns
    near = corpus_pipeline.near(spark, docs, SF_DIR)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in similar(rows).items() if c == i}
    left = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs, SF_DIR).collect()}
    want = without_repeats(list(rows.items()))
    for i, words in want.items():
        full = rows[i].split()
        if not words and full:
            assert i not in left
        else:
            assert left[i].text == (rows[i] if len(words) == len(full) else " ".join(words))
            assert left[i].n_chars == len(left[i].text)


def test_run_packs_what_the_stages_keep(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema)
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in got.collect()} == ids and 0 < len(ids) < 200


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_and_empty_documents(spark, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = odd_documents(spark)
    out = function(spark, docs, SF_DIR).collect()
    assert out
    if stage < 4:
        assert function(spark, docs, SF_DIR).columns == docs.columns
        assert {(r.doc_id) for r in out} <= {i for i, _ in odd_rows()}
    assert function(spark, odd_documents(spark, []), SF_DIR).collect() == []


def test_rows_without_id_are_kept_together(spark):
    docs = odd_documents(spark, [(None, "a"), (1, "b"), (None, "c")])
    decisions = spark.createDataFrame([(None, True), (1, False)], "doc_id long, kept boolean")
    assert sorted(r.text for r in kept_rows(docs, decisions).collect()) == ["a", "c"]


def test_rows_loaded_twice_and_rows_without_id_are_decided_one_by_one(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, prose(1)), (1, prose(1)), (2, prose(1)), (2, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(2) + " end"), (None, "bad")]
    docs = odd_documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    left = kept_rows(docs, quality_verdicts(docs, none, with_key=True))
    assert sorted(r.text for r in left.collect()) == sorted(t for _, t in rows if t != "bad")
    left = corpus_pipeline.exact(spark, docs, SF_DIR)
    want = {(1, prose(1)), (2, prose(2)), (None, prose(3)), (None, prose(2) + " end"), (None, "bad")}
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert set(got) == want and len(got) == len(want) and left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, left, SF_DIR).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want - {(None, prose(2) + " end")}))

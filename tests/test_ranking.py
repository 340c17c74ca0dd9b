import math
import random
import sys

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens import operators as op
from cohortlens.functions import repeatable_mean, repeatable_sum


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(7)
    # One group holds most rows and one value of it is very frequent; some groups and values are missing.
    data = [("hot", rng.choice([1.0, 1.0, 1.0, rng.uniform(0, 50)])) for _ in range(3000)]
    data += [(rng.choice(["a", "b", None]), float(rng.randint(0, 9))) for _ in range(300)]
    data += [("a", None), (None, None)]
    return spark.createDataFrame(data, "g string, v double").cache()


@pytest.mark.parametrize("chunks", [1, 3, 64])
def test_ordered_positions_equals_plain_windows(values, chunks):
    got = op.ordered_positions(values.filter("v IS NOT NULL"), ["v"], ["g"], chunks=chunks)
    w = Window.partitionBy("g").orderBy("v")
    counts = values.filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    want = counts.select(
        "g", "v", "n",
        (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("n_before"),
        F.sum("n").over(Window.partitionBy("g")).alias("n_total"),
        F.row_number().over(w).alias("position"),
    )
    assert rows(got) == rows(want)


def test_ordered_positions_with_text_keys_and_weight(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 3)], "k string, w long")
    got = op.ordered_positions(df, ["k"], weight="w").select("k", "n", "n_before", "n_total", "position")
    assert rows(got) == [("a", 1, 0, 6, 1), ("b", 5, 1, 6, 2)]


def test_add_rank_is_dense_rank(values):
    got = op.add_rank(values.groupBy("g", "v").count(), "count", within=["g"], name="r")
    want = values.groupBy("g", "v").count().withColumn(
        "r", F.dense_rank().over(Window.partitionBy("g").orderBy(F.desc("count")))
    )
    assert rows(got) == rows(want)


def test_add_rank_null_value_has_no_rank(spark):
    df = spark.createDataFrame([("x", 5), ("y", None), ("z", 9)], "k string, n long")
    assert rows(op.add_rank(df, "n")) == [("x", 5, 2), ("y", None, None), ("z", 9, 1)]


def test_top_n_never_splits_a_tie(spark):
    # 12 diagnoses, places 10 to 12 tied
    df = spark.createDataFrame([(f"d{i}", 100 - min(i, 9)) for i in range(12)], "d string, n long")
    top = op.top_n(df, 10, "n", rank="inv_rank")
    assert top.count() == 12
    assert {r.inv_rank for r in top.collect() if r.n == 91} == {10}


@pytest.mark.parametrize("n", [1, 3, 100])
def test_top_n_within_equals_rank(values, n):
    counts = values.groupBy("g", "v").count()
    got = op.top_n(counts, n, "count", within=["g"], rank="r")
    w = Window.partitionBy("g").orderBy(F.desc("count"))
    want = counts.select("*", F.dense_rank().over(w).alias("r"), F.rank().over(w).alias("x")).filter(F.col("x") <= n)
    assert rows(got) == rows(want.drop("x"))


def test_top_n_of_nothing_is_nothing(spark):
    assert op.top_n(spark.createDataFrame([], "k string, n long"), 5, "n").count() == 0


def test_shares(spark):
    df = spark.createDataFrame([("x", "F")] * 3 + [("x", "M")] + [("y", "F")], "k string, s string")
    assert rows(op.share_of_total(df, ["k", "s"])) == [("x", "F", 3, 0.6), ("x", "M", 1, 0.2), ("y", "F", 1, 0.2)]
    assert rows(op.share_within(df, "k", "s")) == [("x", "F", 3, 0.75), ("x", "M", 1, 0.25), ("y", "F", 1, 1.0)]


def test_share_of_parent_drops_parts_without_total(spark):
    parts = spark.createDataFrame([("x", 1), ("y", 1)], "k string, p long")
    totals = spark.createDataFrame([("x", 3)], "k string, t long")
    assert rows(op.share_of_parent(parts, totals, ["k"], "p", "t")) == [("x", 1, 3, 33.33)]


def test_first_per_key_does_not_depend_on_partitioning(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (2, 9, "c"), (1, 7, "z")], "k int, o int, v string")
    for partitions in (1, 4):
        got = op.first_per_key(df.repartition(partitions), ["k"], ["o"])
        assert rows(got) == [(1, 5, "a"), (2, 9, "c")]


def test_category_order_and_level_codes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 5), ("b", 7), ("c", 6), (None, 6)], "c string, n long")
    assert [r.c for r in op.category_order(df.na.drop(), "c", "n").orderBy("category_order").collect()] == ["b", "c", "a"]
    assert rows(op.level_codes(df, "c").select("c", "level_code").distinct()) == [
        ("a", 1), ("b", 2), ("c", 3), (None, None)
    ]


def test_sort_desc_puts_missing_last(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "id int, v int")
    assert [r.id for r in op.sort_desc(df, "v", "id").collect()] == [3, 2, 4, 1]


def test_rank_and_top_of_sums_of_doubles(spark):
    df = spark.range(2000).selectExpr("id % 50 AS k", "CAST(id * 0.1 AS DOUBLE) / 3 AS v").groupBy("k").agg(repeatable_sum("v").alias("v"))
    ranked = op.add_rank(df, "v").collect()
    assert sorted(r.inv_rank for r in ranked) == list(range(1, 51))
    assert op.top_n(df, 7, "v").count() == 7


def test_sums_of_doubles_are_the_same_bits_on_any_partitioning(spark):
    values = "CAST((id * 7919 % 100003) * 0.1 AS DOUBLE) / 3 * pow(10, id % 9) * (1 - 2 * (id % 2))"
    df = spark.range(20000).selectExpr("id % 7 AS k", f"{values} AS v")
    found = []
    for parts in (1, 5, 31):
        sums = df.repartition(parts, F.xxhash64("v", F.lit(parts))).groupBy("k").agg(repeatable_sum("v").alias("s"), repeatable_mean("v").alias("m"))
        found.append({r.k: (r.s.hex(), r.m.hex()) for r in sums.collect()})
    assert found[0] == found[1] == found[2]
    exact = {}
    for r in df.collect():
        exact.setdefault(r.k, []).append(r.v)
    for k, (s, m) in found[0].items():
        assert float.fromhex(s) == pytest.approx(math.fsum(exact[k]), rel=1e-15, abs=1e-9)
        assert float.fromhex(m) == pytest.approx(math.fsum(exact[k]) / len(exact[k]), rel=1e-15)
    odd = spark.createDataFrame([(1, None), (2, 1.5), (2, None), (3, float("nan")), (4, float("inf")), (4, 1.0), (5, 1e300), (5, 1e300)], "k int, v double")
    got = {r.k: r.s for r in odd.groupBy("k").agg(repeatable_sum("v").alias("s")).collect()}
    assert got[1] is None and got[2] == 1.5 and math.isnan(got[3]) and got[4] == float("inf") and got[5] == 2e300


def test_ranks_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["cohortlens.sources.materialize"], "shared_folder", lambda spark: (_ for _ in ()).throw(AssertionError("a table was written")))
    df = spark.range(500).selectExpr("id % 50 AS k", "id * 0.1D AS v").groupBy("k").agg(repeatable_sum("v").alias("v"))
    assert op.add_rank(df, "v").agg(F.max("inv_rank")).first()[0] == 50 and op.top_n(df, 3, "v").count() == 3
    assert op.category_order(df, "k", "v").count() == 50


def test_rank_of_nan_dates_and_text(spark):
    nan = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,), (None,)], "v double")
    assert {str(r.v): r.inv_rank for r in op.add_rank(nan, "v").collect()} == {"nan": 1, "2.0": 2, "1.0": 3, "None": None}
    assert {str(r.v): r.r for r in op.add_rank(nan, "v", name="r", descending=False).collect()}["nan"] == 3
    text = spark.createDataFrame([("a", "2020-01-02"), ("b", "2021-01-01"), ("b", "2019-01-01")], "k string, d string")
    dated = text.withColumn("d", F.col("d").cast("date"))
    assert rows(op.add_rank(text, "k").select("k", "inv_rank")) == [("a", 2), ("b", 1), ("b", 1)]
    assert [r.inv_rank for r in op.add_rank(dated, "d").orderBy("d").collect()] == [3, 2, 1]


def test_ranges_grow_with_the_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "700")
    try:
        df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
        got = op.ordered_positions(df, ["k"]).where("position <> k + 1 OR n_before <> k").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == 0

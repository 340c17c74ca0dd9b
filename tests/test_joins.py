import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortlens import operators as op


@pytest.fixture(scope="module")
def skewed(spark):
    # A third of the rows share key 1, another part has no key at all.
    return spark.range(3000).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 97)
        .cast("long").alias("k"),
    ).cache()


@pytest.fixture(scope="module")
def dimension(spark):
    return spark.range(50).select(F.col("id").alias("k"), F.concat(F.lit("name"), "id").alias("name")).cache()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("aggregated", [False, True])
def test_skew_join_equals_join(no_broadcast, skewed, dimension, how, aggregated):
    want = skewed.join(dimension, "k", how)
    right = dimension.unionByName(no_broadcast.createDataFrame([(None, "no key")], "k int, name string"))
    got = op.skew_join(skewed, right, "k", how, aggregated=aggregated)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.select(want.columns)) == rows(want)


@pytest.mark.parametrize("aggregated", [False, True])
def test_adaptive_execution_splits_hot_keys(no_broadcast, aggregated):
    """One key has 18 % of the rows and one 1.9 %: no task joins more than a few thousand of them."""
    rows_per_task = 8000
    settings = {
        "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "48k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for name, value in settings.items():
        no_broadcast.conf.set(name, value)
    try:
        left = no_broadcast.range(0, 100_000, 1, 40).select(
            F.when(F.col("id") % 50 < 9, -1).when(F.col("id") % 1000 < 19, -2).otherwise(F.col("id")).alias("k"),
            F.xxhash64("id").alias("row"),
        )
        ids = no_broadcast.range(-2, 100_000).withColumnRenamed("id", "k")
        ids = ids.groupBy("k").agg(F.count("*").alias("n")) if aggregated else ids
        joined = op.skew_join(left, ids.withColumn("name", F.xxhash64("k")), "k", aggregated=aggregated)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"))
        largest, total, _ = sizes.agg(F.max("n"), F.sum("n"), F.max("row")).first()
        assert total == 100_000 and largest <= rows_per_task
    finally:
        for name in settings:
            no_broadcast.conf.unset(name)
        no_broadcast.conf.set("spark.sql.shuffle.partitions", "8")


def test_skew_join_runs_no_job(spark, skewed, dimension):
    tracker, group = spark.sparkContext.statusTracker(), "build only"
    spark.sparkContext.setJobGroup(group, group)
    op.skew_join(skewed, dimension, "k")
    op.semi_join(skewed, dimension, "k")
    op.cohort_join(skewed, dimension, "k")
    assert list(tracker.getJobIdsForGroup(group)) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_on_two_keys_of_other_types(no_broadcast, skewed, how):
    def keyed(df):
        return df.withColumns({
            "day": F.date_add(F.lit("2020-01-01").cast("date"), (F.coalesce("k", F.lit(0)) % 3).cast("int")),
            "name": F.concat(F.lit("n"), F.col("k") % 5),
        })

    right = keyed(no_broadcast.range(40).withColumnRenamed("id", "k")).select("day", "name").distinct()
    right = right.withColumn("x", F.lit(1.5))
    got = op.skew_join(keyed(skewed), right, ["day", "name"], how)
    assert rows(got) == rows(keyed(skewed).join(right, ["day", "name"], how))


def test_skew_join_rejects_right_joins(skewed, dimension):
    with pytest.raises(ValueError):
        op.skew_join(skewed, dimension, "k", "right")


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(op.null_safe_join(left, right, ["k"])) == [("a", 2, 20), (None, 1, 10)]
    assert rows(op.restrict_to(left, right, "k")) == [("a", 2, 20)]
    assert rows(op.restrict_to(left, right, "k", null_safe=True)) == [("a", 2, 20), (None, 1, 10)]


def test_null_safe_join_of_a_frame_with_its_own_aggregate(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5)], "k string, x int")
    totals = df.groupBy("k").agg(F.sum("x").alias("t"))
    assert rows(op.null_safe_join(df, totals, ["k"])) == [("a", 1, 3), ("a", 2, 3), (None, 5, 5)]


def test_suffix_join(spark):
    left = spark.createDataFrame([(1, 0, "a")], "id int, voided int, l string")
    right = spark.createDataFrame([(1, 1, "b")], "id int, voided int, r string")
    joined = op.suffix_join(left, right, "id")
    assert joined.columns == ["id", "voided_x", "l", "voided_y", "r"]
    assert rows(joined) == [(1, 0, "a", 1, "b")]


def test_group_parent_join(spark):
    child = spark.createDataFrame([(1, 10, 7), (2, 11, 8), (3, None, 9)], "obs_id long, obs_group_id long, value_coded long")
    parent = spark.createDataFrame([(10, 100), (12, 101)], "obs_id long, person_id long")
    got = op.group_parent_join(child, parent)
    assert rows(got, "obs_id", "person_id") == [(1, 100)]


def test_semi_join_does_not_multiply(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "p int, v string")
    keys = spark.createDataFrame([(1,), (1,), (1,)], "p int")
    assert rows(op.semi_join(facts, keys, "p")) == [(1, "x")]


def test_cohort_join_counts_the_fan_out(spark):
    events = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "person_id int, e string")
    cohort = spark.createDataFrame([(1, "F"), (1, "F")], "person_id int, gender string")
    compact = op.cohort_join(events, cohort, carry=["gender"])
    assert rows(compact) == [(1, "a", "F", 2), (1, "b", "F", 2)]
    listed = op.cohort_join(events, cohort, carry=["gender"], fan_out=True)
    assert rows(listed) == rows(events.join(cohort, "person_id"))
    distinct = op.cohort_join(events, cohort, carry=["gender"], distinct_cohort=True)
    assert {r.cohort_rows for r in distinct.collect()} == {1}


def test_pair_measures_counts_all_pairs(spark):
    # p1: 2 low results x 2 results of the other test -> 4 pairs
    low = spark.createDataFrame([(1, 9.0), (1, 11.0), (2, 8.0)], "person_id int, value_numeric double")
    other = spark.createDataFrame([(1, 6.5), (1, 7.0), (3, 5.0)], "person_id int, value_numeric double")
    got = op.pair_measures(other, low)
    assert rows(got) == [(1, 6.5, 2, 9.0, 11.0, 10.0), (1, 7.0, 2, 9.0, 11.0, 10.0)]
    assert got.agg(F.sum("pairs")).first()[0] == other.join(low, "person_id").count() == 4


def test_include_tuples_and_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "x string, y int")
    tuples = spark.createDataFrame([("a", 1), (None, 1)], "x string, y int")
    assert rows(op.include_tuples(df, tuples)) == [("a", 1), (None, 1)]
    levels = {"x": spark.createDataFrame([("a",)], "x string"), "y": spark.createDataFrame([(1,), (2,)], "y int")}
    assert rows(op.include_levels(df, levels)) == [("a", 1), ("a", 2)]

import datetime
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources import (
    TableSource, literal_frame, materialize, read_csv, read_table, shared_folder, staged, staged_by, write_csv,
)
from cohortlens.sources.materialize import CLEAN_UP
from cohortlens.sources.tables import bounds_query, jdbc_options, range_predicates

SCHEMA = "city_village string, count long, day date, at timestamp_ntz, lon double"
DATA = [
    ("Plain", 5, datetime.date(2015, 3, 1), datetime.datetime(2015, 3, 1, 10, 0, 1), 81.25),
    ('Comma, and "quote"', 1, None, None, None),
    ("two\nlines", None, None, None, 0.1),
    (None, 7, None, None, 81.28999999999999),
]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    write_csv(spark.createDataFrame(DATA, SCHEMA), path)
    assert rows(read_csv(spark, path, SCHEMA, multi_line=True)) == rows(spark.createDataFrame(DATA, SCHEMA))


def test_csv_written_as_text_with_header_and_na(spark, tmp_path):
    path = tmp_path / "out"
    write_csv(spark.createDataFrame([("a, b", None)], "name string, n long").coalesce(1), str(path))
    part = next(path.glob("part-*.csv"))
    assert part.read_text() == 'name,n\n"a, b",NA\n'


def test_csv_by_position(spark, tmp_path):
    (tmp_path / "in.csv").write_text('unique(x$name)\n"Burn, second degree"\nGastritis\n')
    df = read_csv(spark, str(tmp_path / "in.csv"), "diagnosis string")
    assert rows(df) == [("Burn, second degree",), ("Gastritis",)]


def test_csv_does_not_overwrite(spark, tmp_path):
    write_csv(spark.range(1), str(tmp_path / "out"))
    with pytest.raises(Exception, match="already exists"):
        write_csv(spark.range(1), str(tmp_path / "out"))


def test_literal_frame(spark):
    schema = T.StructType([T.StructField("city", T.StringType()), T.StructField("n", T.LongType())])
    df = literal_frame(spark, [("Gereshk", 1), ("", None)], schema)
    assert rows(df) == [("", None), ("Gereshk", 1)]
    assert df.schema.simpleString() == schema.simpleString()
    assert literal_frame(spark, [], schema).count() == 0


def test_parquet_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, "t", TableSource(parquet_dir=str(tmp_path))).count() == 3


def test_jdbc_options_split_the_scan():
    source = TableSource(jdbc={"url": "jdbc:x"}, split={"obs": ("obs_id", 1, 1000, 64)})
    options = jdbc_options("obs", source)
    assert options["partitionColumn"] == "obs_id" and options["numPartitions"] == "64"
    assert options["preferTimestampNTZ"] == "true" and options["dbtable"] == "obs"
    assert "partitionColumn" not in jdbc_options("concept", source)


KEYS = {
    "gaps": [*range(100), *range(10**12, 10**12 + 100)],
    "skew": [*range(50), *[7] * 300, *[None] * 20],
    "few": [5, 5, None],
    "none": [None],
    "empty": [],
    "words": ["O'Neil", "b", "a", None, "", "a"],
}


@pytest.mark.parametrize("name", KEYS)
def test_every_row_meets_one_range(spark, name):
    kind = "string" if name == "words" else "long"
    df = spark.createDataFrame([(k,) for k in KEYS[name]], f"k {kind}")
    df.createOrReplaceTempView("ranged")
    bounds = [r.bound for r in spark.sql(bounds_query("ranged", "k", 8)).collect()]
    # the doubled quote is a quote in a database; Spark joins neighbouring literals instead
    conditions = [c.replace("''N", "\\'N") for c in range_predicates("k", bounds)]
    sizes = [df.where(c).count() for c in conditions]
    assert len(bounds) <= 8 and sum(sizes) == len(KEYS[name])
    beyond = spark.createDataFrame([(k,) for k in ("", "zz")] if name == "words" else [(-5,), (10**15,)], f"k {kind}")
    assert sum(beyond.where(c).count() for c in conditions) == 2
    if name == "gaps":
        assert sizes == [25] * 8 + [0]
    if name == "skew":  # the repeated key has a range of its own with few others
        assert sizes[-1] == 20 and sorted(sizes)[-1] <= 300 + 350 // 8 + 1


def test_table_is_read_by_ranges(spark):
    asked = []

    class Reader:
        def format(self, kind):
            return self

        def options(self, **options):
            asked.append(options["dbtable"])
            return self

        def load(self):
            return spark.createDataFrame([(1,), (40,), (90,)], "bound long")

        def jdbc(self, url, table, predicates, properties):
            asked.append((url, table, predicates, sorted(properties)))
            return spark.createDataFrame([(1, True)], "obs_id long, voided boolean")

    class Session:
        read = Reader()

    source = TableSource(jdbc={"url": "jdbc:x", "user": "u"}, ranges={"obs": ("obs_id", 3)})
    assert rows(read_table(Session(), "obs", source)) == [(1, 1)]
    assert asked[0].startswith("(SELECT MIN(range_key)") and "NTILE(3)" in asked[0]
    want = ["obs_id < 40", "obs_id >= 40 AND obs_id < 90", "obs_id >= 90", "obs_id IS NULL"]
    assert asked[1] == ("jdbc:x", "obs", want, ["fetchsize", "preferTimestampNTZ", "user"])
    both = TableSource(jdbc={"url": "jdbc:x"}, ranges={"obs": ("obs_id", 3)}, split={"obs": ("obs_id", 1, 9, 2)})
    with pytest.raises(ValueError):
        read_table(Session(), "obs", both)
    with pytest.raises(ValueError):
        bounds_query("obs", "obs_id", 0)


def test_materialize_marks_for_reuse(spark):
    df = materialize(spark.range(10).withColumnRenamed("id", "kept"))
    try:
        assert df.count() == 10
        assert "InMemoryTableScan" in df.filter("kept > 3")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.unpersist()


def test_staged_cuts_lineage(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    table = staged(df)
    assert rows(table) == rows(df)
    assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()


class FakeSession:
    """Only what ``shared_folder`` asks a session for."""

    def __init__(self, configured=None, master="local[2]"):
        self.sparkContext, self.conf, self.master = self, self, master
        self.configured, self.folder = configured, None

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.configured or default

    def setCheckpointDir(self, folder):
        self.folder = f"file:{folder}/some-id"

    def getCheckpointDir(self):
        return self.folder


def test_shared_folder():
    assert shared_folder(FakeSession("hdfs:///shared")) == "hdfs:///shared"
    local = FakeSession()
    assert shared_folder(local) == shared_folder(local) == local.folder
    with pytest.raises(ValueError):
        shared_folder(FakeSession(master="spark://host:7077"))


def test_staged_by_joins_without_shuffling_the_table(no_broadcast):
    spark = no_broadcast
    wide = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"), F.lit("x").alias("k_"))
    few = spark.range(0, 300, 7).withColumnRenamed("id", "k")
    names = {row.tableName for row in spark.sql("SHOW TABLES").collect()}
    with staged_by(wide, "k", 3) as table:
        joined = few.join(table.select("k", "v"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1  # of the few keys
        got = sorted(tuple(r) for r in joined.collect())
    assert got == sorted((v % 300, v) for v in range(1000) if v % 300 % 7 == 0)
    assert {row.tableName for row in spark.sql("SHOW TABLES").collect()} == names


def test_staged_by_of_an_empty_table_and_of_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "k long, v long")
    with staged_by(rows, "k") as table:
        assert sorted(r.v for r in table.collect()) == [1, 2, 3]
    with staged_by(rows.limit(0), "k") as table:
        assert table.columns == ["k", "v"] and table.collect() == []


def test_staged_by_of_several_frames_is_one_table_whose_files_go(no_broadcast):
    spark = no_broadcast
    rows = spark.range(100).select((F.col("id") % 30).alias("k"), "id")
    with staged_by([rows.where("id % 3 = 0"), rows.where("id % 3 > 0"), rows.limit(0)], "k", 3) as table:
        plan = spark.range(5).withColumnRenamed("id", "k").join(table, "k")
        assert sorted(r.id for r in table.collect()) == list(range(100))
        assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(r.id for r in plan.collect()) == [i for i in range(100) if i % 30 < 5]
        files = [f.removeprefix("file://") for f in table.inputFiles()]
        assert files and all(map(os.path.exists, files))
    assert not any(map(os.path.exists, files))


def test_a_failed_block_leaves_no_name_and_no_setting(spark):
    before = spark.conf.get(CLEAN_UP)
    with pytest.raises(ZeroDivisionError), staged_by(spark.range(5), "id"):
        raise ZeroDivisionError
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith("cohortlens_")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        staged(spark.range(5).select((F.lit(1) / (F.col("id") - 2)).alias("q")))
    assert spark.conf.get(CLEAN_UP) == before

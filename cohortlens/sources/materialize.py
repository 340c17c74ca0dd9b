"""Keep an intermediate result that several outputs share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def materialize(df: DataFrame) -> DataFrame:
    """Mark ``df`` for reuse. Rows stay on the executors; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local master may leave it unset; then a temporary folder is used, which goes when the program ends.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="cohortlens-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


#: Spark drops the shuffle files of a query when it ends, not when the driver's memory happens to be collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends. A written table needs none of them again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def _new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cohortlens-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it. Runs a job.

    Cuts lineage: what follows reads the table, however often, and lost executors cost nothing but their
    running tasks. The planner also learns the true size, so later joins broadcast on facts, not guesses.
    Shuffle files of the write go when it ends. Tables lie in a folder per application and can be removed when it has ended.
    """
    spark = df.sparkSession
    path = _new_folder(spark)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_by(df: DataFrame | list[DataFrame], key: str, buckets: int | None = None) -> Iterator[DataFrame]:
    """As ``staged``, but dealt into buckets by ``key``: joins on ``key`` read the table without a shuffle of it.

    For a wide table that several small ones are joined with. There are as many buckets as shuffle partitions, or ``buckets`` if that is
    more (with fewer, Spark would shuffle the table all the same). Several frames are written one after another, so that only one of them
    has shuffle files at a time. The table exists inside the ``with`` block only, so what is read from it must be written or collected
    there; its name and its files go at the end.
    """
    frames = df if isinstance(df, list) else [df]
    spark = frames[0].sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    n = min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets or 1))
    name, path = f"cohortlens_{uuid.uuid4().hex}", _new_folder(spark)
    try:
        with _shuffles_dropped(spark):
            for part in frames:
                # dealt as the buckets are, so that each of them is one file
                dealt = part.repartition(n, key).write.format("parquet").mode("append")
                dealt.option("path", path).bucketBy(n, key).saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

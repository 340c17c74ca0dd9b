"""Small Spark helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.materialize import staged

__all__ = ["attach_groups", "bounded_sample", "read", "row_key", "staged", "texts", "unused"]

#: A group with more than this share of the rows is hot; so there are at most ``1 / HOT_SHARE`` of them.
HOT_SHARE = 0.001


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``text`` only, whatever else the table has; a null text becomes an empty one."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer by underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text", doc_id: str = "doc_id"):
    """Names a row by its id and text, so that rows that share an id or have none stay apart; equal rows share it."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.lit(0), F.coalesce(F.col(text), F.lit("")))


def bounded_sample(rows: DataFrame, key: str, n: int, *then: str) -> DataFrame:
    """At most ``n`` rows: those whose ``key`` has the smallest hashes, ties by ``key`` and ``then``.

    Rows are thinned by the same hash to about twice as many first, so that what is sorted does not grow with the table.
    """
    share = min(1.0, 2.0 * n / max(rows.count(), 1))
    place = F.xxhash64(key)
    thinned = rows if share == 1.0 else rows.where(place < F.lit(int(-(2**63) + share * 2**64)))
    return thinned.orderBy(place, key, *then).limit(n)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left rows with their group's columns, for groups of any size.

    ``groups`` has one row per ``key`` and its number of rows in ``size``. Groups above a thousandth of all rows, of
    which there are at most a thousand, are joined by broadcast, so no key with that many rows is shuffled. All other
    keys are joined by a shuffle, where none exceeds that share. ``rows`` and ``groups`` should be written tables.
    """
    total = rows.count()
    hot = F.col(size) > F.lit(HOT_SHARE * total)
    big, small = groups.where(hot), groups.where(~hot)
    marked = rows.join(F.broadcast(big.select(key, F.lit(True).alias("_hot"))), key, "left")
    return (
        marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(big), key)
        .unionByName(marked.where(F.col("_hot").isNull()).drop("_hot").join(small, key))
    )

"""Small relational steps that DataFrame methods do not already name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keep, then drop, then rename columns."""
    out = df.select(*keep) if keep is not None else df
    out = out.drop(*drop) if drop else out
    return out.withColumnsRenamed(dict(rename)) if rename else out


def add_record_count(df: DataFrame, name: str = "number_of_records") -> DataFrame:
    """A measure that is 1 in every row."""
    return df.withColumn(name, F.lit(1))


def having(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter on aggregated columns."""
    return df.filter(predicate)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name and keep duplicates."""
    return reduce(lambda a, b: a.unionByName(b), frames)

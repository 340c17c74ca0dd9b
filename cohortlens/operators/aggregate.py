"""Group counts, summaries and drill paths. All of them combine rows before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count_by(df: DataFrame, *keys: str, weight: str | None = None, name: str = "count") -> DataFrame:
    """Rows per key combination; ``weight`` sums that column instead, for rows that are already counts."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys).agg(measure.alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, NULL included."""
    return df.select(column).distinct()


def bounding_box(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row with the extent of the coordinates."""
    return df.agg(
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
    )


def sum_records(df: DataFrame, dims: Sequence[str], name: str = "records", weight: str | None = None) -> DataFrame:
    """Sum of the constant 1 (or of ``weight``) over the dimensions."""
    return df.groupBy(*dims).agg(F.sum(F.lit(1) if weight is None else F.col(weight)).alias(name))


def column_summary(df: DataFrame, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """One row with the default aggregate of every column.

    Numbers are summed, strings counted, dates and timestamps give the number of distinct years. An entry
    of ``overrides`` picks another aggregate for a column: ``sum``, ``avg``, ``count``, ``count_distinct``,
    ``min``, ``max`` or ``years``. Output columns are named ``<aggregate>_<column>``.

    Where several columns have ``count_distinct``, each is counted in a pass over that column alone, combined before its shuffle,
    instead of copying every row once per column. Give a table, not a costly frame, which would be computed once per pass.
    """
    overrides = dict(overrides or {})
    unknown = set(overrides) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    build = {
        "sum": F.sum, "avg": F.avg, "count": F.count, "count_distinct": F.count_distinct,
        "min": F.min, "max": F.max,
        # years are few, so their set is small; several distinct counts would copy every row once per column
        "years": lambda c: F.size(F.collect_set(F.year(c))).cast("long"),
    }
    several = sum(kind == "count_distinct" for kind in overrides.values()) > 1
    measures, passes, names = [], {}, []
    for field in df.schema:
        kind = overrides.get(field.name)
        if kind is None:
            if isinstance(field.dataType, T.NumericType):
                kind = "sum"
            elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                kind = "years"
            else:
                kind = "count"
        column, name = F.col(f"`{field.name}`"), f"{kind}_{field.name}"
        names.append(name)
        if several and kind == "count_distinct":
            passes[name] = df.select(column.alias("level")).distinct().agg(F.count("level")).scalar()
        else:
            measures.append(build[kind](column).alias(name))
    summary = df.agg(*measures or [F.count(F.lit(1)).alias("_rows")])
    return summary.select(*[passes[n].alias(n) if n in passes else F.col(f"`{n}`") for n in names])


def drill_counts(df: DataFrame, path: Sequence[str], name: str = "count") -> DataFrame:
    """Counts at every level of a drill path, from the grand total down to the full path.

    ``level_id`` is the grouping id of the row. Rows are counted on the full path first, so the rollup
    copies only one row per distinct path instead of every input row.
    """
    leaves = df.groupBy(*path).agg(F.count(F.lit(1)).alias("_n"))
    return leaves.rollup(*path).agg(
        F.sum("_n").alias(name), F.grouping_id().cast("int").alias("level_id")
    )

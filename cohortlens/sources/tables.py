"""Lazy handles on tables: parquet folders, or a relational database over JDBC."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSource:
    """Where tables live.

    Give ``parquet_dir`` for files, or ``jdbc`` (the connection options) for a database. For JDBC,
    ``split`` maps a table to ``(column, lower, upper, partitions)`` so that the scan runs as that many
    range queries instead of one. ``ranges`` maps a table to ``(column, partitions)`` instead: the database is asked for bounds
    that leave as many rows between them, so gaps and crowded stretches of the key do not matter. A table in neither is
    read through one connection.
    """

    parquet_dir: str | None = None
    jdbc: dict[str, str] = field(default_factory=dict)
    split: dict[str, tuple[str, int, int, int]] = field(default_factory=dict)
    ranges: dict[str, tuple[str, int]] = field(default_factory=dict)
    flags: Sequence[str] = ("voided", "dead", "birthdate_estimated", "deathdate_estimated")


def jdbc_options(name: str, source: TableSource) -> dict[str, str]:
    """The reader options of one table scan."""
    options = {"preferTimestampNTZ": "true", "fetchsize": "10000", **source.jdbc, "dbtable": name}
    if name in source.split:
        column, lower, upper, partitions = source.split[name]
        options |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def bounds_query(name: str, column: str, partitions: int) -> str:
    """The lowest key of each of ``partitions`` parts of equal size: one row per part, from the key column alone."""
    if partitions < 1:
        raise ValueError("a scan needs at least one partition")
    parts = f"SELECT {column} AS range_key, NTILE({partitions}) OVER (ORDER BY {column}) AS part FROM {name} WHERE {column} IS NOT NULL"
    return f"SELECT MIN(range_key) AS bound FROM ({parts}) parts GROUP BY part"


def _sql_literal(value: object) -> str:
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, bounds: Iterable) -> list[str]:
    """One condition per range of the key, and one for rows without a key; every row meets exactly one.

    ``bounds`` may come from ``bounds_query`` or a histogram of the catalogue, in any order; equal ones (a key that fills several
    parts) count once. The outer ranges are open, so rows beyond the bounds, or added since, are read as well.
    """
    cuts = sorted({b for b in bounds if b is not None})[1:]
    if not cuts:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    at = [_sql_literal(c) for c in cuts]
    inner = [f"{column} >= {low} AND {column} < {high}" for low, high in zip(at, at[1:], strict=False)]
    return [f"{column} < {at[0]}", *inner, f"{column} >= {at[-1]}", f"{column} IS NULL"]


def _scan_by_ranges(spark: SparkSession, name: str, source: TableSource) -> DataFrame:
    """The table as one query per key range; the driver sees one bound per partition."""
    column, partitions = source.ranges[name]
    options = jdbc_options(name, source)
    asked = f"({bounds_query(name, column, partitions)}) bounds"
    bounds = [row.bound for row in spark.read.format("jdbc").options(**options | {"dbtable": asked}).load().collect()]
    properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], name, predicates=range_predicates(column, bounds), properties=properties)


def read_table(spark: SparkSession, name: str, source: TableSource) -> DataFrame:
    """Lazy scan of table ``name``; filters and column choices reach the file scan or the database."""
    if source.parquet_dir is not None:
        return spark.read.parquet(f"{source.parquet_dir}/{name}.parquet")
    if name in source.split and name in source.ranges:
        raise ValueError(f"{name} has both a split and ranges")
    if name in source.ranges:
        df = _scan_by_ranges(spark, name, source)
    else:
        df = spark.read.format("jdbc").options(**jdbc_options(name, source)).load()
    # Drivers report one-bit flags as booleans; the studies compare them with 0.
    booleans = [f.name for f in df.schema if f.name in source.flags and isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({c: F.col(c).cast("int") for c in booleans}) if booleans else df


def literal_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small table written out in code, with its types declared.

    Built as an inline expression, so the planner knows how small it is and broadcasts it.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], declared)
    literals = [
        F.struct(*[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(row, declared, strict=True)])
        for row in rows
    ]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*literals)))

"""Ranks, top-n with ties, shares and orderings.

None of these puts an unbounded group into one task. Ranks over a whole result are computed from the
distinct ranking values, cut into key ranges of similar size; top-n reads at most ``n`` rows per group
from every input partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import repeatable_mean
from cohortlens.operators.joins import null_safe_join, skew_join

SAMPLES_PER_CHUNK = 8
MIN_CHUNKS = 8


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    within: Sequence[str] = (),
    weight: str | None = None,
    chunks: int | None = None,
    with_distinct: bool = False,
) -> DataFrame:
    """The distinct ``keys`` of every group in ascending order, with their place in that order.

    Adds ``n`` (rows, or summed ``weight``), ``n_before`` (rows of the group with smaller keys),
    ``n_total`` (rows of the group) and ``position`` (1, 2, ... over the distinct keys); ``with_distinct`` adds
    ``n_distinct``, the last position of the group.

    A window over a whole group would sort that group in one task. Here the distinct keys are cut into
    ``chunks`` ranges (default: the session's shuffle partitions, which are set to suit the data) by splitters taken from
    a hash sample of them; each range is ordered on its own and shifted by the totals of the ranges
    before it. The sample only decides where the cuts are, so
    the positions are exact, and it is chosen by hash, so a repeated task makes the same cuts.

    Keys must come out the same when they are computed again. Columns of a table do, also rounded or cast, and so do
    whole numbers; sums and means of doubles do as ``functions.repeatable_sum`` and ``repeatable_mean``.
    """
    within, keys = list(within), list(keys)
    if chunks is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = max(partitions, MIN_CHUNKS)
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    distinct = df.groupBy(*within, *keys).agg(measure.alias("n"))

    # Reads the same columns as the main branch, so both share one shuffle.
    sample = (
        distinct.select(F.struct(*keys).alias("k"), "n", F.xxhash64(*within, *keys).alias("h"))
        .orderBy("h", "k").limit(chunks * SAMPLES_PER_CHUNK)
        .agg(F.sort_array(F.collect_list("k")).alias("k"), F.sum("n").alias("n"))
    )
    thinned = sample.select(
        F.struct(
            F.filter("k", lambda _, i: (i % SAMPLES_PER_CHUNK == SAMPLES_PER_CHUNK - 1)).alias("k"), F.col("n")
        ).alias("splitters")
    )
    cut = (
        distinct.withColumn("_splitters", thinned.scalar())
        .withColumn("_key", F.struct(*keys))
        .withColumn("_chunk", _place_among("_splitters.k", "_key", chunks))
        .drop("_splitters", "_key")
    )

    totals = cut.groupBy(*within, "_chunk").agg(F.sum("n").alias("_chunk_rows"), F.count(F.lit(1)).alias("_chunk_keys"))
    chunk_order = Window.partitionBy(*within).orderBy("_chunk")  # at most `chunks` rows per group
    before = chunk_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *within,
        "_chunk",
        F.coalesce(F.sum("_chunk_rows").over(before), F.lit(0)).alias("_n_offset"),
        F.coalesce(F.sum("_chunk_keys").over(before), F.lit(0)).alias("_d_offset"),
        F.sum("_chunk_rows").over(Window.partitionBy(*within)).alias("n_total"),
        F.sum("_chunk_keys").over(Window.partitionBy(*within)).alias("n_distinct"),
    )
    placed = null_safe_join(cut, offsets, [*within, "_chunk"])
    in_chunk = Window.partitionBy(*within, "_chunk").orderBy(*keys)
    running = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        *within,
        *keys,
        "n",
        (F.col("_n_offset") + F.sum("n").over(running) - F.col("n")).alias("n_before"),
        "n_total",
        (F.col("_d_offset") + F.row_number().over(in_chunk)).alias("position"),
        *(["n_distinct"] if with_distinct else []),
    )


def _place_among(splitters: str, key: str, chunks: int) -> Column:
    """How many of the sorted splitters lie below the key: first among every k-th, then among the k after it."""
    step = max(1, math.isqrt(chunks))
    below = lambda s: s < F.col(key)
    every = F.filter(splitters, lambda _, i: i % step == step - 1)
    skipped = F.size(F.filter(every, below)) * step
    return skipped + F.size(F.filter(F.slice(splitters, skipped + 1, F.lit(step)), below))


def add_rank(
    df: DataFrame, by: str, within: Sequence[str] = (), name: str = "inv_rank", descending: bool = True
) -> DataFrame:
    """Add the dense rank of ``by``, over the whole result or inside groups. Rows with a NULL ``by`` get NULL.

    ``by`` may have any type that can be ordered; NaN is higher than every number, as in ``top_n``. Nothing is
    written: values are compared with those of another branch of the plan, so sums and means of doubles should be
    ``functions.repeatable_sum`` and ``repeatable_mean``.
    """
    within = list(within)
    present = df.filter(F.col(by).isNotNull()).select(*within, F.col(by).alias("_by"))
    from_below = F.col("position")
    place = F.col("n_distinct") - from_below + 1 if descending else from_below
    placed = ordered_positions(present, ["_by"], within, with_distinct=True)
    ranks = placed.select(*within, F.col("_by").alias(by), place.cast("int").alias(name))
    return null_safe_join(df, ranks, [*within, by], how="left").select(*df.columns, name)


def top_n(
    df: DataFrame, n: int, by: str, within: Sequence[str] = (), rank: str | None = None
) -> DataFrame:
    """Rows whose ``by`` is among the ``n`` highest, ties at the cut included (rank <= n).

    ``rank`` names an optional dense-rank column; above the cut it equals the dense rank over all rows.

    The ``n`` highest values are found first. Ties beyond them never travel together: a row is kept by
    comparing it with that short list, wherever it is. For sums and means of doubles see ``add_rank``.
    """
    within = list(within)
    values = df.filter(F.col(by).isNotNull())
    highest = F.sort_array(F.collect_set(by), asc=False)
    if not within:
        best = values.select(by).orderBy(F.desc(by)).limit(n).agg(highest.alias("_top"))
        marked = df.withColumn("_top", best.scalar())
    else:
        order = Window.partitionBy(*within).orderBy(F.desc(by))
        best = (
            values.select(*within, by)
            .withColumn("_row", F.row_number().over(order))
            .filter(F.col("_row") <= n)
            .groupBy(*within)
            .agg(highest.alias("_top"))
        )
        marked = null_safe_join(df, best, within)
    place = F.array_position("_top", F.col(by)).cast("int")
    kept = marked.filter(F.array_contains("_top", F.col(by)))
    if rank is not None:
        kept = kept.withColumn(rank, place)
    return kept.drop("_top")


def share_of_parent(
    parts: DataFrame, totals: DataFrame, on: Sequence[str], part: str, total: str, name: str = "percentage"
) -> DataFrame:
    """Percentage of a separately computed total, two decimals. Parts without a total are dropped."""
    joined = parts.join(totals.select(*on, total), list(on))
    return joined.withColumn(name, F.round(F.try_divide(F.col(part), F.col(total)) * 100, 2))


def share_of_total(df: DataFrame, keys: Sequence[str], weight: str | None = None, name: str = "share") -> DataFrame:
    """Count per key combination and its share of the grand total."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys).agg(measure.alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("_total", total).withColumn(name, F.try_divide("n", "_total")).drop("_total")


def share_within(df: DataFrame, key: str, part: str, weight: str | None = None, name: str = "share") -> DataFrame:
    """Count per (key, part) and its share inside the key."""
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(key, part).agg(measure.alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("_total"))
    return null_safe_join(counts, totals, [key]).select(
        key, part, "n", F.try_divide("n", "_total").alias(name)
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the stated order (ascending, NULL first).

    An aggregate that keeps one row per key on the map side; nothing is sorted. The remaining columns break
    ties, so the choice never depends on how rows were partitioned.
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    lead = [c if isinstance(c, Column) else F.col(c) for c in order]
    position = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(lead)], *rest)
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), position).alias("_row"))
    return picked.select(*key, "_row.*")


def sort_desc(df: DataFrame, by: str, *then: str) -> DataFrame:
    """Descending by one column, ascending by the others, missing values last."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(c) for c in then])


def category_order(df: DataFrame, category: str, measure: str, name: str = "category_order") -> DataFrame:
    """Categories ordered by descending mean of a measure, ties by category name; adds the place 1, 2, ..."""
    means = df.groupBy(category).agg(repeatable_mean(-F.col(measure)).alias("_score"))
    placed = ordered_positions(means, ["_score", category])
    return placed.select(
        category, (-F.col("_score")).alias("mean_measure"), F.col("position").cast("int").alias(name)
    )


def level_codes(df: DataFrame, column: str, name: str = "level_code") -> DataFrame:
    """Add the place of a value among the sorted distinct values of its column; NULL stays NULL."""
    levels = ordered_positions(df.filter(F.col(column).isNotNull()).select(column), [column])
    codes = levels.select(column, F.col("position").cast("int").alias(name))
    return skew_join(df, codes, column, "left", aggregated=True).select(*df.columns, name)

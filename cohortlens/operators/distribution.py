"""The numbers behind charts: bars, quantiles, box plots, histograms, trends and thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.numbers import t_critical
from cohortlens.operators.joins import null_safe_join
from cohortlens.operators.ranking import category_order, ordered_positions
from cohortlens.sources.materialize import staged

#: Cells that one pass of a quantile cuts a range of values into, and groups up to which that is done.
CELLS = 4096
MOST_GROUPS = 10_000
#: Rows of a cell that are sorted rather than counted again.
SORT_ROWS = 50_000


def _measure(weight: str | None):
    return F.count(F.lit(1)) if weight is None else F.sum(weight)


def _quantiles_of(positions: DataFrame, value: str, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Linear-interpolation quantiles from ``ordered_positions`` of a value column."""
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1

    def target(p):
        return (F.col("n_total") - 1) * p

    wanted = F.filter(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: (F.ceil(target(p)) >= first) & (F.floor(target(p)) <= last),
    )
    hits = positions.withColumn("_probs", wanted).withColumn("prob", F.explode("_probs"))
    h = target(F.col("prob"))
    low = F.max(F.when(F.floor(h).between(first, last), F.col(value)))
    high = F.max(F.when(F.ceil(h).between(first, last), F.col(value)))
    return (
        hits.groupBy(*by, "prob")
        .agg(low.alias("_low"), high.alias("_high"), F.max(h - F.floor(h)).alias("_part"))
        .select(*by, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))
    )


def _value_positions(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    present = df.filter(F.col(value).isNotNull())
    return ordered_positions(present.withColumn(value, F.col(value).cast("double")), [value], by, weight)


def _same_group(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """Columns of ``left`` equal those of ``right``, NULL like NULL."""
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in on.items()])


def _size(x: Column) -> Column:
    """Grows with ``x`` as its logarithm does, on both sides of zero."""
    return F.when(x > 0, F.ln(x) + 746).when(x < 0, -746 - F.ln(-x)).otherwise(F.lit(0.0))


def _needed_positions(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str], weight: str | None) -> DataFrame:
    """The order statistics that the probabilities ask for, as ``ordered_positions`` has them, by repeated counting.

    One pass counts how many values of a group lie in each of ``CELLS`` cells between its lowest and highest one. Cells that hold a
    wanted rank are counted again, cut as finely between their own extremes, until each holds one value, or so few rows
    (``SORT_ROWS``) that these are put in order. Every pass is a scan with map-side counts; no other values are shuffled. The cells looked into (two per group and
    probability at most) are broadcast; with more than ``MOST_GROUPS`` groups values are sorted instead.
    """
    by = list(by)
    copies = F.lit(1).cast("long") if weight is None else F.col(weight)
    groups_of = {c: f"_by{i}" for i, c in enumerate(by)} | {"_all": "_one"}
    x = F.col("_x")
    finite = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    # always 0, but not a literal: a join on it alone stays a hash join where there are no groups
    zero = F.pmod(F.hash(value), F.lit(1))
    present = df.filter(F.col(value).isNotNull()).select(
        *by, zero.alias("_all"), F.col(value).cast("double").alias("_x"), copies.alias("_w"), F.lit(0).cast("long").alias("_cell"),
    )
    groups = staged(present.groupBy(*by, "_all").agg(
        F.sum("_w").alias("n_total"), F.min(F.when(finite, x)).alias("_lo"), F.max(F.when(finite, x)).alias("_hi"),
    ))
    if groups.count() > MOST_GROUPS:
        return _value_positions(df, value, by, weight)
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("n_total") - 1) * float(p)), F.ceil((F.col("n_total") - 1) * float(p))) for p in probs
    ])))
    wanted = groups.withColumn("_ranks", ranks).withColumnsRenamed(groups_of)
    into = wanted.select(*groups_of.values(), F.lit(0).cast("long").alias("_in"), F.lit(0).cast("long").alias("_before"), "_lo", "_hi", "n_total", "_ranks")
    rows, found = present, []
    while True:
        # the cells of the last pass that are looked into; a row in none of them is left out from here on
        same = _same_group(rows, into, groups_of) & (rows["_cell"] == into["_in"])
        inside = rows.join(F.broadcast(into.select(*groups_of.values(), "_in", "_lo", "_hi")), same)
        width = F.col("_hi") - F.col("_lo")
        half = (x / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # where the width itself is too large
        part = F.when(width < F.lit(float("inf")), (x - F.col("_lo")) / width).otherwise(half)
        if len(found) % 2:  # what is still far apart after even cells is cut by size
            small, large = F.least(F.abs("_lo"), F.abs("_hi")), F.greatest(F.abs("_lo"), F.abs("_hi"))
            wide = (F.signum("_lo") != F.signum("_hi")) | (large / 1e3 > small)
            by_size = (_size(x) - _size(F.col("_lo"))) / (_size(F.col("_hi")) - _size(F.col("_lo")))
            part = F.when(wide, by_size).otherwise(part)
        part = F.floor(part * CELLS)
        cell = (
            F.when(F.isnan(x), CELLS + 1).when(x == F.lit(float("inf")), CELLS).when(x == F.lit(float("-inf")), -1)
            .when(F.col("_hi") > F.col("_lo"), F.least(part, F.lit(CELLS - 1))).otherwise(0)
        )
        # the number of a cell in all passes so far: few cells are looked into, so they are numbered by their first rank
        rows = inside.withColumn("_cell", cell.cast("long")).select(*by, "_all", "_x", "_w", "_cell", F.col("_in").alias("_over"))
        counted = rows.groupBy(*by, "_all", "_over", "_cell").agg(F.sum("_w").alias("n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        to = into.select(*groups_of.values(), F.col("_in").alias("_over_"), "_before", "n_total", "_ranks")
        placed = counted.join(F.broadcast(to), _same_group(counted, to, groups_of) & (counted["_over"] == to["_over_"]))
        order = Window.partitionBy(*by, "_all", "_over").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.col("_before") + F.sum("n").over(order) - F.col("n")
        hit = F.exists("_ranks", lambda r: (r >= F.col("n_before")) & (r < F.col("n_before") + F.col("n")))
        hits = staged(placed.withColumn("n_before", first).where(hit).select(
            *by, "_all", "_over", "_cell", "n", "n_before", "n_total", "_low", "_high", "_ranks",
        ))
        alone = F.col("_low").eqNullSafe(F.col("_high"))
        found.append(hits.where(alone).select(*by, F.col("_low").alias(value), "n", "n_before", "n_total"))
        more = hits.where(~alone)
        most = more.agg(F.max("n")).first()[0]
        if most is None:
            return reduce(DataFrame.unionByName, found)
        # a cell goes by its number of rows before it, which no other cell of the group shares
        into = more.withColumnsRenamed(groups_of).select(
            *groups_of.values(), F.col("n_before").alias("_in"), F.col("n_before").alias("_before"),
            F.col("_low").alias("_lo"), F.col("_high").alias("_hi"), "n_total", "_ranks", F.col("_over").alias("_at_over"), F.col("_cell").alias("_at_cell"),
        )
        at = into.select(*[F.col(c).alias(f"{c}_") for c in groups_of.values()], "_at_over", "_at_cell", F.col("_in").alias("_next"))
        same = _same_group(rows, at, {a: f"{b}_" for a, b in groups_of.items()}) & (rows["_over"] == at["_at_over"]) & (rows["_cell"] == at["_at_cell"])
        rows = rows.join(F.broadcast(at), same).select(*by, "_all", "_x", "_w", F.col("_next").alias("_cell"))
        if most <= SORT_ROWS:
            distinct = rows.groupBy(*by, "_all", "_cell", "_x").agg(F.sum("_w").alias("n"))
            totals = into.select(*groups_of.values(), "_in", "n_total")
            placed = distinct.join(F.broadcast(totals), _same_group(distinct, totals, groups_of) & (distinct["_cell"] == totals["_in"]))
            order = Window.partitionBy(*by, "_all", "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            before = F.col("_cell") + F.sum("n").over(order) - F.col("n")  # a cell's number is that of the rows before it
            found.append(placed.withColumn("n_before", before).select(*by, F.col("_x").alias(value), "n", "n_before", "n_total"))
            return reduce(DataFrame.unionByName, found)


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours: one row per group and probability.

    Missing values are left out. The order statistics are found by counting ranges of values, so no task holds all
    values of a group, and none is shuffled. Runs jobs: one per pass, few where values are spread.
    """
    return _quantiles_of(_needed_positions(df, value, probs, by, weight), value, probs, list(by))


def _with_fences(df: DataFrame, value: str, by: Sequence[str], weight: str | None) -> DataFrame:
    """The values with the quartiles of their group and the 1.5 IQR fences; ``n`` says how often a row counts."""
    by = list(by)
    tall = quantiles(df, value, (0.25, 0.5, 0.75), by, weight)
    quartiles = staged(tall.groupBy(*by).agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    ]))
    iqr = F.col("q3") - F.col("q1")
    copies = F.lit(1).cast("long") if weight is None else F.col(weight)
    present = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value), copies.alias("n"))
    if quartiles.count() <= MOST_GROUPS:
        quartiles = F.broadcast(quartiles)
    return null_safe_join(present, quartiles, by).withColumns(
        {"_low": F.col("q1") - iqr * 1.5, "_high": F.col("q3") + iqr * 1.5}
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Quartiles, whiskers (the extreme values inside the fences) and the number of outliers per group."""
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    return _with_fences(df, value, by, weight).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
        F.sum("n").alias("n"),
    )


def box_outliers(df: DataFrame, value: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """The values outside the fences, with how often each occurs."""
    fenced = _with_fences(df, value, by, weight)
    return fenced.filter(~F.col(value).between(F.col("_low"), F.col("_high"))).groupBy(*by, value).agg(F.sum("n").alias("n"))


def histogram(
    df: DataFrame, value: str, by: Sequence[str] = (), bins: int = 20, weight: str | None = None
) -> DataFrame:
    """Counts per bin and group; the bins span the range of the whole column.

    Bins are right-closed and as wide as the range divided by ``bins - 1``, with a boundary at half a width.
    When all values are equal there is one bin of width 1 around them. Two passes: the range, then the counts.
    """
    if bins < 2:
        raise ValueError("a histogram needs at least 2 bins")
    present = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    extent = present.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("r"))
    span = F.col("_r.hi") - F.col("_r.lo")
    width = F.when(span > 0, span / (bins - 1)).otherwise(F.lit(1.0))
    origin = F.when(span > 0, width / 2 + F.floor((F.col("_r.lo") - width / 2) / width) * width).otherwise(
        F.col("_r.lo") - 0.5
    )
    placed = present.withColumn("_r", extent.scalar()).withColumns({"_w": width, "_o": origin})
    number = F.greatest(F.ceil((F.col(value) - F.col("_o")) / F.col("_w") - 1e-8), F.lit(1)).cast("int")
    return (
        placed.withColumn("bin", number)
        .groupBy(*by, "bin", "_o", "_w")
        .agg(_measure(weight).alias("n"))
        .select(
            *by,
            "bin",
            (F.col("_o") + (F.col("bin") - 1) * F.col("_w")).alias("bin_low"),
            (F.col("_o") + F.col("bin") * F.col("_w")).alias("bin_high"),
            "n",
        )
    )


def stacked_bar(df: DataFrame, x: str, fill: str, weight: str | None = None, name: str = "n") -> DataFrame:
    """Weight per (x, fill) with the place of x when bars go by descending mean segment."""
    bars = df.groupBy(x, fill).agg(_measure(weight).alias(name))
    order = category_order(bars, x, name).select(x, "category_order")
    return null_safe_join(bars, order, [x])


def filled_bar(df: DataFrame, x: str, fill: str, weight: str | None = None) -> DataFrame:
    """Share of every fill inside its bar, and the running share where its label goes."""
    segments = ordered_positions(df, [fill], [x], weight)
    return segments.select(
        x,
        fill,
        "n",
        F.try_divide("n", "n_total").alias("share"),
        F.try_divide(F.col("n_before") + F.col("n"), F.col("n_total")).alias("label_at"),
    )


def faceted_counts(df: DataFrame, facet: str, x: str, weight: str | None = None) -> DataFrame:
    """Bar heights per x in every facet."""
    return df.groupBy(facet, x).agg(_measure(weight).alias("n"))


def linear_trend(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group: slope, intercept and what its error band needs.

    ``residual_se`` and ``dof`` are NULL for fewer than 3 points.
    """
    yx = (F.col(y).cast("double"), F.col(x).cast("double"))
    both = yx[0].isNotNull() & yx[1].isNotNull()
    sums = df.groupBy(*by).agg(
        F.regr_count(*yx).alias("n"),
        F.regr_slope(*yx).alias("slope"),
        F.regr_intercept(*yx).alias("intercept"),
        F.regr_avgx(*yx).alias("mean_x"),
        F.regr_sxx(*yx).alias("sxx"),
        F.regr_syy(*yx).alias("_syy"),
        F.regr_sxy(*yx).alias("_sxy"),
        F.min(F.when(both, yx[1])).alias("min_x"),
        F.max(F.when(both, yx[1])).alias("max_x"),
    )
    enough = F.col("n") > 2
    unexplained = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    return sums.withColumns({
        "dof": F.when(enough, F.col("n") - 2),
        "residual_se": F.when(enough & F.col("slope").isNotNull(), F.sqrt(F.try_divide(unexplained, F.col("n") - 2))),
    }).drop("_syy", "_sxy")


def linear_band(df: DataFrame, y: str, x: str, by: Sequence[str] = (), points: int = 80) -> DataFrame:
    """The trend line with its 95 % confidence band at evenly spaced x of every group."""
    if points < 2:
        raise ValueError("a band needs at least 2 points")
    trend = linear_trend(df, y, x, by)
    grid = trend.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("min_x") + (F.col("max_x") - F.col("min_x")) * F.col("step") / (points - 1)
    )
    spread = F.lit(1.0) / F.col("n") + F.try_divide(F.pow(F.col("x") - F.col("mean_x"), F.lit(2.0)), F.col("sxx"))
    return grid.withColumns({
        "fit": F.col("intercept") + F.col("slope") * F.col("x"),
        "se": F.col("residual_se") * F.sqrt(spread),
        "t": F.when(F.col("dof") > 0, t_critical(F.col("dof").cast("double"))),
    }).select(
        *by, "step", "x", "fit", "se", "dof",
        (F.col("fit") - F.col("t") * F.col("se")).alias("lower"),
        (F.col("fit") + F.col("t") * F.col("se")).alias("upper"),
    )


def point_series(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Scatter points: rows that have both coordinates."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)


def line_series(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Points in drawing order: by group, then x (then y, so that equal x can be split over partitions)."""
    return point_series(df, x, y, by).orderBy(*by, x, y)


def threshold_counts(df: DataFrame, value: str, cut: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows below the threshold and at or above it."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(value) < cut).alias("below"), F.count_if(F.col(value) >= cut).alias("at_or_above")
    )

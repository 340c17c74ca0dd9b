"""Two-dimensional Gaussian density of weighted points on a grid."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.distribution import quantiles
from cohortlens.sources.materialize import staged

#: What a partial grid says about where it lies.
EXTENT = ("x0", "x1", "y0", "y1")

# Fixed values of the normal-reference bandwidth rule.
BANDWIDTH_FACTOR = 1.06
IQR_TO_SD = 1.34


def _settings(points: DataFrame) -> dict:
    """Scalar columns: weight, range and standard deviation of both axes, and their interquartile ranges."""
    means = points.agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "xy"])
    squares = {c: F.sum(F.col("w") * F.pow(F.col(c) - F.col(f"_mean.{c}"), F.lit(2.0))) for c in "xy"}
    spread = points.withColumn("_mean", means.select(F.struct("x", "y")).scalar()).agg(
        F.struct(
            F.sum("w").alias("n"),
            *[F.struct(
                F.min(c).alias("lo"), F.max(c).alias("hi"),
                F.sqrt(F.try_divide(squares[c], F.sum("w") - 1)).alias("sd"),
            ).alias(c) for c in "xy"],
        ).alias("s")
    )
    tall = points.select("w", F.explode(F.create_map(F.lit("x"), "x", F.lit("y"), "y")).alias("axis", "v"))
    quarters = quantiles(tall, "v", (0.25, 0.75), by=["axis"], weight="w")

    def quarter(axis: str, p: float):
        return F.max(F.when((F.col("axis") == axis) & (F.col("prob") == p), F.col("quantile")))

    iqr = quarters.agg(F.struct(*[(quarter(c, 0.75) - quarter(c, 0.25)).alias(c) for c in "xy"]).alias("iqr"))
    return {"_spread": spread.scalar(), "_iqr": iqr.scalar()}


def _bandwidth(c: str):
    axis = f"_spread.{c}"
    sd, iqr, n = F.col(f"{axis}.sd"), F.col(f"_iqr.{c}"), F.col("_spread.n")
    narrow = F.when(iqr > 0, F.least(sd, iqr / IQR_TO_SD)).otherwise(sd)
    # A spread that is only rounding noise of the coordinates counts as none.
    noise = F.lit(1e-12) * F.greatest(F.abs(F.col(f"{axis}.lo")), F.abs(F.col(f"{axis}.hi")), F.lit(1.0))
    usable = (sd > noise) & (F.col(f"{axis}.hi") > F.col(f"{axis}.lo"))
    return F.when(usable, F.lit(BANDWIDTH_FACTOR) * narrow * F.pow(n, F.lit(-0.2))).otherwise(
        F.raise_error(F.lit(f"no density: all points share one value of the {c} axis"))
    )


def density_2d(
    df: DataFrame,
    lon: str = "lon",
    lat: str = "lat",
    weight: str | None = None,
    grid: tuple[int, int] = (100, 100),
) -> DataFrame:
    """Kernel density on a regular grid over the extent of the points.

    Points are first summed per coordinate and written. The Gaussian kernel is a product of one factor per axis, so a
    batch of points adds ``Kx * W * Ky'`` to the grid: one small matrix product instead of a row per point
    and cell. A task sends its partial grid as one row. These are added in two levels, each task of the first one adding
    about the square root of their number.
    """
    nx, ny = grid
    if min(grid) < 2:
        raise ValueError("the grid needs at least 2 cells per axis")
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    points = staged(
        df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .groupBy(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
        .agg(measure.cast("double").alias("w"))
    )
    prepared = points.withColumns(_settings(points)).select(
        "x", "y", "w",
        F.col("_spread.x.lo").alias("x0"), F.col("_spread.x.hi").alias("x1"), _bandwidth("x").alias("sx"),
        F.col("_spread.y.lo").alias("y0"), F.col("_spread.y.hi").alias("y1"), _bandwidth("y").alias("sy"),
        F.col("_spread.n").alias("total"),
    )

    def partial_grid(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, last = np.zeros((nx, ny)), None
        for batch in batches:
            if batch.empty:
                continue
            last = batch.iloc[0]
            gx = np.linspace(last.x0, last.x1, nx)[:, None]
            gy = np.linspace(last.y0, last.y1, ny)[:, None]
            kx = np.exp(-0.5 * ((gx - batch.x.to_numpy()) / last.sx) ** 2)
            ky = np.exp(-0.5 * ((gy - batch.y.to_numpy()) / last.sy) ** 2)
            cells += (kx * batch.w.to_numpy()) @ ky.T
        if last is not None:
            cells /= 2 * math.pi * last.sx * last.sy * last.total
            yield pd.DataFrame({**{c: [last[c]] for c in EXTENT}, "grid": [cells.tobytes()]})

    def added(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, last = np.zeros((nx, ny)), None
        for batch in batches:
            for grid_ in batch.grid:
                cells += np.frombuffer(grid_).reshape(nx, ny)
            last = last if batch.empty else batch.iloc[0]
        if last is not None:
            yield pd.DataFrame({**{c: [last[c]] for c in EXTENT}, "grid": [cells.tobytes()]})

    def cells_of(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for total in added(batches):
            last = total.iloc[0]
            ix, iy = (i.ravel() for i in np.indices((nx, ny)))
            yield pd.DataFrame({
                "ix": ix, "iy": iy, "gx": np.linspace(last.x0, last.x1, nx)[ix], "gy": np.linspace(last.y0, last.y1, ny)[iy],
                "density": np.frombuffer(last.grid),
            })

    schema = ", ".join(f"{c} double" for c in EXTENT) + ", grid binary"
    parts = staged(prepared.mapInPandas(partial_grid, schema))
    tasks = max(1, math.isqrt(parts.count()))
    levels = parts.repartition(tasks, F.xxhash64("grid")).mapInPandas(added, schema)
    return levels.repartition(1).mapInPandas(cells_of, "ix int, iy int, gx double, gy double, density double")


def density_bands(density: DataFrame, bins: int = 16, value: str = "density") -> DataFrame:
    """Add the band 1..bins of each cell, in equal steps up to the highest density."""
    peak = density.agg(F.max(value)).scalar()
    band = F.least(F.width_bucket(F.col(value), F.lit(0.0), F.col("_peak"), F.lit(bins)), F.lit(bins))
    return density.withColumn("_peak", peak).withColumn("band", band.cast("int")).drop("_peak")

"""Places: spelling corrections, gazetteer lookups, patient points and the pie map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import correct_values
from cohortlens.operators.joins import skew_join
from cohortlens.operators.ranking import first_per_key


def correct_column(df: DataFrame, column: str, corrections: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace misspellings in a column.

    A mapping becomes an inline literal. A table with columns ``wrong`` and ``right`` is joined; its ``wrong``
    values must be unique, which is checked while the join runs.
    """
    if not isinstance(corrections, DataFrame):
        return df.withColumn(column, correct_values(column, corrections))
    checked = corrections.groupBy(F.col("wrong").alias(column)).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("right"))
        .otherwise(F.raise_error(F.concat(F.lit("several corrections for "), F.first("wrong"))))
        .alias("_right")
    )
    joined = skew_join(df, checked, column, "left", aggregated=True)
    return joined.withColumn(column, F.coalesce("_right", column)).drop("_right").select(*df.columns)


def place_key(c: Column | str) -> Column:
    """Key under which place names are looked up: trimmed, lower case, single spaces; blank text is NULL."""
    column = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.trim(F.regexp_replace(column, r"\s+", " ")))
    return F.when(text != "", text)


def geocode(
    df: DataFrame,
    gazetteer: DataFrame,
    on: str,
    country: str | None = None,
    order: Sequence[str | Column] = (),
) -> DataFrame:
    """Add ``lon`` and ``lat`` of the place named in column ``on``.

    The gazetteer has columns ``name``, ``lon``, ``lat`` (and ``country``, to restrict the search). When a
    name has several entries the first in ``order`` counts. Blank and unknown names get NULL coordinates.
    """
    entries = gazetteer if country is None else gazetteer.filter(F.col("country") == country)
    keyed = entries.withColumn("_place", place_key("name")).filter(F.col("_place").isNotNull())
    hits = first_per_key(keyed, ["_place"], order).select("_place", "lon", "lat")
    placed = df.withColumn("_place", place_key(on))
    return skew_join(placed, hits, "_place", "left", aggregated=True).drop("_place")


def attach_coords(df: DataFrame, places: DataFrame, on: str) -> DataFrame:
    """Rows whose place is in ``places``, with its columns. One place may hold a large part of the rows."""
    return skew_join(df, places, on)


def round_coords(df: DataFrame, lon: str = "lon", lat: str = "lat", digits: int = 4) -> DataFrame:
    """Coordinates rounded to ``digits`` decimals."""
    return df.withColumns({lon: F.round(lon, digits), lat: F.round(lat, digits)})


def pie_map(
    df: DataFrame,
    min_sum: int = 500,
    members: Sequence[str] = ("F", "M"),
    dims: Sequence[str] = ("lat", "lon", "city_village", "gender"),
    weight: str | None = None,
) -> DataFrame:
    """Records per place and sex, groups with at least ``min_sum`` only, and the share inside each place.

    The last of ``dims`` is the slice (restricted to ``members``), the others identify a pie. Only slices
    that pass the limit count towards the pie they are part of.
    """
    *place, wedge = dims
    measure = F.sum(F.lit(1) if weight is None else F.col(weight))
    slices = (
        df.filter(F.col(wedge).isin(list(members))).groupBy(*dims).agg(measure.alias("records"))
        .filter(F.col("records") >= min_sum)
    )
    # At most len(members) slices per pie, so the pie total is a small group.
    totals = slices.groupBy(*place).agg(F.sum("records").alias("pie_total"))
    return slices.join(totals, place).withColumn("share", F.try_divide("records", "pie_total"))

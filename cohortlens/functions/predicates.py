"""Row predicates whose NULL rules matter."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def none_of(c: Column | str, values: Iterable) -> Column:
    """NOT IN with the SQL rule: a NULL value is not kept."""
    return ~_col(c).isin(list(values))


def any_present(*columns: Column | str) -> Column:
    """At least one of the columns holds a value."""
    if not columns:
        raise ValueError("any_present needs at least one column")
    result = _col(columns[0]).isNotNull()
    for c in columns[1:]:
        result = result | _col(c).isNotNull()
    return result


def calendar_parts(c: str, min_year: int, min_month: int) -> Column:
    """``year >= min_year AND month >= min_month``, part by part as the studies define it.

    January and February of every year are lost when ``min_month`` is 3; ``since`` is the plain date
    filter. The year condition implies a lower bound on the column itself, which file and partition
    statistics can use, so that bound is stated too.
    """
    floor = datetime.datetime(min_year, min_month, 1)
    return (F.col(c) >= F.lit(floor.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.year(c) >= min_year) & (
        F.month(c) >= min_month
    )


def since(c: str, day: datetime.date) -> Column:
    """Every row on or after ``day``."""
    return F.col(c) >= F.lit(datetime.datetime(day.year, day.month, day.day).isoformat(sep=" ")).cast("timestamp_ntz")

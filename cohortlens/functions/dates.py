"""Dates and ages."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Text to DATE; text that is no date becomes NULL."""
    return F.try_to_date(c, fmt)


def parse_datetime(c: Column | str, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text to TIMESTAMP_NTZ; text that is no timestamp becomes NULL."""
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def date_parts(c: str, prefix: str) -> dict[str, Column]:
    """Year and month columns of ``c``, ready for ``withColumns``."""
    return {f"{prefix}_year": F.year(c), f"{prefix}_month": F.month(c)}


def age_years(birthdate: Column | str, as_of: datetime.date | Column) -> Column:
    """Age in years with one decimal on the day ``as_of``.

    Whole years, plus the part of the current year of life that has passed. The day is an argument so that
    results do not depend on when the job runs.
    """
    born = F.col(birthdate) if isinstance(birthdate, str) else birthdate
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    years = F.floor(F.months_between(day, born) / 12).cast("int")
    last = F.add_months(born, years * 12)
    following = F.add_months(born, (years + 1) * 12)
    return F.round(years + F.datediff(day, last) / F.datediff(following, last), 1)

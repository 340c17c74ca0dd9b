"""Numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed bands (low, high) and the divisor used inside each.
RESCALE_BANDS = ((100.0, 999.99, 100.0), (1000.0, 9999.99, 1000.0))


def rescale_outliers(c: Column | str, bands: Sequence[tuple[float, float, float]] = RESCALE_BANDS) -> Column:
    """Divide values that fall in a closed band by the divisor of that band; others stay.

    Values between two bands (such as 999.995) and above the last one are left alone.
    """
    column = F.col(c) if isinstance(c, str) else c
    result = None
    for low, high, divisor in bands:
        inside, scaled = column.between(low, high), column / divisor
        result = F.when(inside, scaled) if result is None else result.when(inside, scaled)
    return column if result is None else result.otherwise(column)


def cast_numeric(c: Column | str) -> Column:
    """Text to DOUBLE; text that is no number becomes NULL."""
    column = F.col(c) if isinstance(c, str) else c
    return column.try_cast("double")


def percent_of(part: Column | str, total: Column | str, digits: int = 2) -> Column:
    """``part`` as a rounded percentage of ``total``; NULL when the total is 0."""
    part = F.col(part) if isinstance(part, str) else part
    return F.round(F.try_divide(part * 100.0, F.col(total) if isinstance(total, str) else total), digits)


#: Where a value is cut in two, and beyond which a sum is a plain one.
_LOW_PART, _BEYOND = 2.0**30, 1e27


def repeatable_sum(c: Column | str) -> Column:
    """Sum of a DOUBLE column that comes out the same, to the last bit, in whatever order the rows are added.

    A plain sum of doubles rounds after each step, so another partitioning or a recomputed task may end in another
    digit, and a comparison of two branches of a plan then fails. Here each value is cut into a multiple of 2^30 and the
    rest to 16 decimals; both are added as whole numbers, which is exact, up to 10^10 rows of the largest values. NaN, infinities and numbers from
    10^27 on are added as doubles. NULL if there is no value.
    """
    column = (F.col(c) if isinstance(c, str) else c).cast("double")
    usual = F.abs(column) < _BEYOND
    high = F.rint(column / _LOW_PART) * _LOW_PART
    low = F.sum(F.when(usual, (column - high).cast("decimal(27,16)"))).cast("double")
    top = F.sum(F.when(usual & (high != 0), high.cast("decimal(28,0)"))).cast("double")
    rest = F.sum(F.when(~usual, column))
    some = [F.coalesce(part, F.lit(0.0)) for part in (low, top, rest)]
    return F.when(F.count(column) > 0, some[0] + some[1] + some[2])


def repeatable_mean(c: Column | str) -> Column:
    """Mean of a DOUBLE column, from ``repeatable_sum``."""
    column = F.col(c) if isinstance(c, str) else c
    return F.try_divide(repeatable_sum(column), F.count(column))


# Fixed value: the 97.5 % point of the standard normal distribution.
Z_975 = 1.959964


# The 97.5 % points of Student's t distribution for 1 to 30 degrees of freedom.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)


def t_critical(dof: Column, z: float = Z_975) -> Column:
    """97.5 % Student t point for ``dof`` degrees of freedom: the tabled value up to 30, beyond it the Cornish-Fisher
    series around ``z``, which is right to six decimals there. NULL below 1.
    """
    terms = (
        ((z**3 + z) / 4, 1),
        ((5 * z**5 + 16 * z**3 + 3 * z) / 96, 2),
        ((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, 3),
    )
    total = F.lit(z)
    for weight, power in terms:
        total = total + F.try_divide(F.lit(weight), F.pow(dof, F.lit(float(power))))
    tabled = F.element_at(F.lit(list(T_975)), dof.cast("int"))
    return F.when(dof.between(1, len(T_975)), tabled).when(dof > len(T_975), total)

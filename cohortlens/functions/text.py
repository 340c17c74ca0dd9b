"""String columns. Everything is a native expression, so scans stay in generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cap_words(c: Column | str) -> Column:
    """Upper-case the first character of every space-separated word and keep the rest as it is.

    One trailing space goes away, inner double spaces stay, NULL stays NULL. ``initcap`` would be wrong
    here because it lower-cases the remaining letters.
    """
    column = F.col(c) if isinstance(c, str) else c
    words = F.split(F.regexp_replace(column, " $", ""), " ", -1)
    capitalised = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.array_join(capitalised, " ")


def correct_values(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace known misspellings and pass every other value through.

    The map becomes one literal of the plan, of any size; ``operators.geo.correct_column`` takes a table instead.
    """
    column = F.col(c) if isinstance(c, str) else c
    if not mapping:
        return column
    known = F.map_from_arrays(F.lit(list(mapping)), F.lit(list(mapping.values())))
    return F.coalesce(known[column], column)


def joined_address(name: Column | str, parts: Sequence[str]) -> Column:
    """``name`` followed by fixed parts, three spaces between them; NULL for a NULL name.

    The three spaces are part of the address text the gazetteer is keyed by.
    """
    column = F.col(name) if isinstance(name, str) else name
    pieces = [column]
    for part in parts:
        pieces += [F.lit(" "), F.lit(part)]
    return F.when(column.isNotNull(), F.concat_ws(" ", *pieces))


def attr(c: Column | str) -> Column:
    """Aggregate: the single value of a group, or ``*`` when it has several."""
    return F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit("*"))


def pct_label(share: Column | str, digits: int = 1) -> Column:
    """A share as percent text: 0.1234 becomes ``12.3%``."""
    column = F.col(share) if isinstance(share, str) else share
    return F.concat(F.format_number(column * 100, digits), F.lit("%"))


def comma_label(n: Column | str) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(n, 0)

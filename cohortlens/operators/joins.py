"""Joins of facts with dimensions, parents, cohorts and earlier results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys where NULL matches NULL; the keys appear once, from the left."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = None
    for c in on:
        nullable = left.schema[c].nullable and right.schema[c].nullable
        mine, theirs = F.col(c), F.col(f"_r_{c}")
        term = mine.eqNullSafe(theirs) if nullable else mine == theirs
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{c}" for c in on])


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner", *, aggregated: bool = False
) -> DataFrame:
    """Join a large ``left`` whose keys may be skewed with a ``right`` that has few rows per key.

    One lazy join at every size. What is broadcast and what is split is decided at run time on measured sizes: adaptive
    execution broadcasts a side that proves small, and cuts a partition that a hot key has filled into tasks of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` each, every one joined with that partition's right rows.
    It can do so for joins that keep or filter left rows, so others are refused. ``session.RECOMMENDED`` turns the split on
    also where a later step has to shuffle again for it.

    A ``right`` that was just aggregated by the key is joined where the aggregate left it, without a shuffle of its own,
    and such a join is never split. ``aggregated`` compares the keys as one value, for which both sides are
    shuffled; the aggregate is the small side, so that costs little.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join keeps or filters left rows; {how!r} is not supported")
    on = [on] if isinstance(on, str) else list(on)
    if not aggregated:
        return left.join(right, on, how)
    key = F.struct(*[F.col(c).cast(left.schema[c].dataType).alias(c) for c in on])
    known = right.dropna(subset=on).select(key.alias("_key"), *[c for c in right.columns if c not in on])
    return left.withColumn("_key", key).join(known, "_key", how).drop("_key")


def suffix_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "inner",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join where columns both sides carry get a suffix, so that none is lost or ambiguous."""
    on = [on] if isinstance(on, str) else list(on)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    l = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    r = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return l.join(r, on, how)


def group_parent_join(
    child: DataFrame,
    parent: DataFrame,
    *,
    child_key: str = "obs_group_id",
    parent_key: str = "obs_id",
) -> DataFrame:
    """Observation rows with the group row they belong to; rows without a group row are dropped.

    Columns of the parent that the child also has are taken from the child. One group may hold a large part
    of all observations; see ``skew_join``.
    """
    extra = [c for c in parent.columns if c != parent_key and c not in child.columns]
    parents = parent.select(F.col(parent_key).alias(child_key), *extra)
    return skew_join(child, parents, child_key)


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``; never multiplies rows."""
    on = [on] if isinstance(on, str) else list(on)
    return skew_join(df, keys.select(*on).distinct(), on, "left_semi", aggregated=True)


def restrict_to(
    df: DataFrame, selection: DataFrame, on: Sequence[str] | str, null_safe: bool = False
) -> DataFrame:
    """Facts whose key is in an earlier result, together with the columns of that result.

    NULL keys match nothing, as in SQL; ``null_safe=True`` lets NULL match NULL.
    """
    on = [on] if isinstance(on, str) else list(on)
    return null_safe_join(df, selection, on) if null_safe else skew_join(df, selection, on, aggregated=True)


def cohort_join(
    events: DataFrame,
    cohort: DataFrame,
    on: str = "person_id",
    *,
    carry: Sequence[str] = (),
    fan_out: bool = False,
    distinct_cohort: bool = False,
) -> DataFrame:
    """Events of the persons of a cohort.

    A person may be in the cohort several times (several addresses or codes), and a plain join would repeat
    each of the person's events that often. Here every event appears once, and ``cohort_rows`` says how often the
    plain join would repeat it; ``fan_out=True`` repeats it, ``distinct_cohort=True`` counts persons once.
    """
    members = cohort.groupBy(on, *carry).agg(F.count(F.lit(1)).alias("cohort_rows"))
    if distinct_cohort:
        members = members.withColumn("cohort_rows", F.lit(1).cast("long"))
    joined = skew_join(events, members, on, aggregated=True)
    if not fan_out:
        return joined
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("cohort_rows")))).drop(
        "_copy", "cohort_rows"
    )


def pair_measures(
    first: DataFrame,
    second: DataFrame,
    *,
    on: str = "person_id",
    value: str = "value_numeric",
    weight: str | None = None,
) -> DataFrame:
    """Rows of one test next to what the same person's rows of a second test say.

    Listing every pair would square the rows of a person with many results. Each row of ``first`` appears
    once, with the number of partner rows (``pairs``) and the lowest, highest and mean partner value. Rows
    without a partner are dropped, as the inner join does; the sum of ``pairs`` is the number of pairs.
    ``weight`` names a column of ``second`` that says how many rows a row stands for.
    """
    copies = F.lit(1).cast("long") if weight is None else F.col(weight)
    partners = second.groupBy(on).agg(
        F.sum(copies).alias("pairs"),
        F.min(value).alias("partner_min"),
        F.max(value).alias("partner_max"),
        F.try_divide(
            F.sum(F.col(value) * copies), F.sum(F.when(F.col(value).isNotNull(), copies))
        ).alias("partner_mean"),
    )
    return skew_join(first, partners, on, aggregated=True)


def include_tuples(df: DataFrame, tuples: DataFrame) -> DataFrame:
    """Rows whose combination of values occurs in ``tuples`` (matched on all of its columns)."""
    return null_safe_join(df, tuples.distinct(), tuples.columns, how="left_semi")


def include_levels(df: DataFrame, levels: Mapping[str, DataFrame]) -> DataFrame:
    """Rows whose value is a member of the level list of every named column.

    The same rows as ``include_tuples`` on all combinations of the levels, without building them.
    """
    out = df
    for column, members in levels.items():
        out = null_safe_join(out, members.select(column).distinct(), [column], how="left_semi")
    return out

"""Patient-diagnosis facts and the rankings and single-disease studies built on them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dates import age_years, date_parts
from cohortlens.operators.aggregate import count_by, distinct_values
from cohortlens.operators.distribution import box_outliers, box_stats, histogram, stacked_bar
from cohortlens.operators.joins import group_parent_join, restrict_to, semi_join, skew_join
from cohortlens.operators.ranking import add_rank, top_n
from cohortlens.plans.study import (
    StudyCodes, StudyTables, coded_in_class, full_names, live, useful_answers,
)
from cohortlens.sources.materialize import staged


def _names(t: StudyTables, codes: StudyCodes, only: Sequence[str] | None) -> DataFrame:
    names = full_names(t, codes).withColumnsRenamed({"concept_id": "value_coded", "name": "diagnosis"})
    return names if only is None else names.filter(F.col("diagnosis").isin(list(only)))


def _of_names(coded: DataFrame, t: StudyTables, codes: StudyCodes, only: Sequence[str] | None) -> DataFrame:
    """Only the observations whose code has one of the names, so that little else is shuffled."""
    return coded if only is None else semi_join(coded, _names(t, codes, only), "value_coded")


def _fact(
    coded: DataFrame, t: StudyTables, codes: StudyCodes, as_of: datetime.date, only: Sequence[str] | None
) -> DataFrame:
    """One row per (person, code, address): event count, name of the code, village and age.

    Events are counted per (person, code) before anything else is joined; that combines rows on the map side
    and flattens a person who holds a large part of them. The joins on the person then share one partitioning.
    """
    events = coded.groupBy("person_id", "value_coded").agg(F.count(F.lit(1)).alias("count"))
    persons = live(t.person).select("person_id", "gender", "birthdate")
    enrolled = ["date_created"] if "date_created" in t.person_address.columns else []
    addresses = t.person_address.select("person_id", "city_village", *enrolled).withColumnsRenamed(
        {"date_created": "date_enrolled"}
    )
    return (
        events.join(persons, "person_id").join(addresses, "person_id")
        .join(_names(t, codes, only), "value_coded", "left" if only is None else "inner")
        .select(
            "person_id",
            "gender",
            F.col("value_coded").alias("diagnosis_id"),
            "diagnosis",
            "count",
            "city_village",
            *(["date_enrolled"] if enrolled else []),
            "birthdate",
            age_years("birthdate", as_of).alias("age"),
        )
    )


def diagnosis_fact_by_group(
    t: StudyTables, as_of: datetime.date, codes: StudyCodes = StudyCodes(), include_voided: bool = True,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Facts from answers that belong to a diagnosis group row.

    Voided observations count by default, as in the original study. Observations without a person column
    take the person of their group row. ``only`` gives the facts of the named diagnoses, at the cost of
    those alone.
    """
    children = useful_answers(t, codes) if include_voided else live(useful_answers(t, codes))
    own_person = [c for c in ("person_id",) if c in children.columns]
    children = children.select("obs_group_id", "value_coded", *own_person)
    parents = t.group_rows.filter(F.col("concept_id").isin(list(codes.group_questions)))
    parents = parents.select("obs_id", *([] if own_person else ["person_id"]))
    linked = group_parent_join(_of_names(children, t, codes, only), parents)
    return _fact(linked, t, codes, as_of, only)


def diagnosis_fact_by_class(
    t: StudyTables, as_of: datetime.date, codes: StudyCodes = StudyCodes(), include_voided: bool = True,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Facts from answers whose concept is of the diagnosis class; ``only`` as above."""
    coded = coded_in_class(t, codes)
    coded = coded if include_voided else live(coded)
    return _fact(_of_names(coded, t, codes, only), t, codes, as_of, only)


def diagnosis_master(fact: DataFrame) -> DataFrame:
    """The distinct diagnosis names; NULL stands for codes without a name."""
    return distinct_values(fact, "diagnosis")


def diagnosis_cells(fact: DataFrame, weight: str | None = None) -> DataFrame:
    """Facts per (diagnosis, gender, village): the one aggregate all rankings below are rolled up from.

    Facts are counted as rows, as in the original study; ``weight="count"`` sums events instead.
    """
    return count_by(fact, "diagnosis", "gender", "city_village", weight=weight, name="facts")


def _staged_cells(fact: DataFrame, weight: str | None = None) -> DataFrame:
    """The cells as a table, so that a ranking that needs them several times reads the facts once."""
    return fact if "facts" in fact.columns else staged(diagnosis_cells(fact, weight))


def top_diagnoses(fact: DataFrame, n: int = 10, weight: str | None = None) -> DataFrame:
    """The ``n`` most frequent diagnoses, ties included; ``inv_rank`` is their dense rank.

    This and the rankings below take the facts or their ``diagnosis_cells``.
    """
    return _top(_staged_cells(fact, weight), n)


def _top(cells: DataFrame, n: int) -> DataFrame:
    totals = cells.groupBy("diagnosis").agg(F.sum("facts").alias("diag_count"))
    return top_n(totals, n, "diag_count", rank="inv_rank")


def top_by_sex(fact: DataFrame, n: int = 10, null_safe: bool = False) -> DataFrame:
    """The top diagnoses by sex."""
    cells = _staged_cells(fact)
    chosen = restrict_to(cells, _top(cells, n).select("diagnosis"), "diagnosis", null_safe)
    return chosen.groupBy("diagnosis", "gender").agg(F.sum("facts").alias("diag_sex_count"))


def top_regions_per_diagnosis(
    fact: DataFrame, n: int = 10, regions: int = 5, null_safe: bool = False
) -> DataFrame:
    """The villages with the most facts of each top diagnosis, ties included."""
    cells = _staged_cells(fact)
    chosen = restrict_to(cells, _top(cells, n).select("diagnosis"), "diagnosis", null_safe)
    counts = chosen.groupBy("diagnosis", "city_village").agg(F.sum("facts").alias("diag_region_count"))
    return top_n(counts, regions, "diag_region_count", within=["diagnosis"], rank="reg_rank")


def regions_by_sex(fact: DataFrame, n: int = 10, regions: int = 5, null_safe: bool = False) -> DataFrame:
    """Those villages by sex; the dense rank restarts for every (diagnosis, sex)."""
    cells = _staged_cells(fact)
    keys = top_regions_per_diagnosis(cells, n, regions, null_safe).select("diagnosis", "city_village")
    chosen = restrict_to(cells, keys, ["diagnosis", "city_village"], null_safe)
    counts = chosen.withColumnRenamed("facts", "diag_sex_region_count")
    return add_rank(counts, "diag_sex_region_count", within=["diagnosis", "gender"], name="reg_rank").select(
        "diagnosis", "gender", "city_village", "diag_sex_region_count", "reg_rank"
    )


def disease_regions(fact: DataFrame, diagnosis: str, n: int = 10, regions: int = 5) -> DataFrame:
    """Bars of one disease: facts per (village, sex), villages in drawing order."""
    cells = _staged_cells(fact)
    of_disease = F.col("diagnosis") == diagnosis
    keys = top_regions_per_diagnosis(cells, n, regions).filter(of_disease).select("diagnosis", "city_village")
    chosen = restrict_to(cells.filter(of_disease), keys, ["diagnosis", "city_village"])
    return stacked_bar(chosen, "city_village", "gender", weight="facts")


def disease_ages(
    fact: DataFrame, diagnosis: str, n: int = 10, regions: int = 5, rows: DataFrame | None = None
) -> DataFrame:
    """Facts of one disease in its top villages, one row per fact with the age.

    ``rows`` are the facts of that disease, if they can be had at less cost than by filtering ``fact``.
    """
    keys = top_regions_per_diagnosis(fact, n, regions).filter(F.col("diagnosis") == diagnosis)
    return skew_join(
        fact.filter(F.col("diagnosis") == diagnosis) if rows is None else rows,
        keys.select("diagnosis", "city_village"),
        ["diagnosis", "city_village"],
    )


def _age_counts(ages: DataFrame) -> DataFrame:
    """Facts per (village, sex, age): ages have one decimal, so this is small however many facts there are."""
    return staged(ages.groupBy("city_village", "gender", "age").agg(F.count(F.lit(1)).alias("facts")))


def disease_age_boxes(ages: DataFrame) -> DataFrame:
    """Box plot numbers of age per (village, sex)."""
    return box_stats(_age_counts(ages), "age", ["city_village", "gender"], weight="facts")


def disease_age_outliers(ages: DataFrame) -> DataFrame:
    """Ages outside the whiskers per (village, sex)."""
    return box_outliers(_age_counts(ages), "age", ["city_village", "gender"], weight="facts")


def disease_age_histogram(ages: DataFrame, bins: int = 20) -> DataFrame:
    """Age histogram per (village, sex) with bins shared by all of them."""
    return histogram(_age_counts(ages), "age", ["city_village", "gender"], bins, weight="facts")


def code_trend(
    t: StudyTables, codes_studied: Sequence | None = None, codes: StudyCodes = StudyCodes(),
    include_voided: bool = False,
) -> DataFrame:
    """Observations of the studied code(s) per month and year."""
    wanted = [codes.studied_code] if codes_studied is None else list(codes_studied)
    obs = t.obs if include_voided else live(t.obs)
    return month_year_counts(obs.filter(F.col("value_coded").isin(wanted)))


def month_year_counts(obs: DataFrame) -> DataFrame:
    """Observations per month and year."""
    return obs.withColumns(date_parts("obs_datetime", "obs")).groupBy("obs_month", "obs_year").agg(
        F.count(F.lit(1)).alias("count")
    )

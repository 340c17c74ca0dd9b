"""Enrolled patients per village, and the sexes inside the villages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.predicates import calendar_parts
from cohortlens.functions.text import cap_words
from cohortlens.operators.joins import skew_join
from cohortlens.operators.ranking import share_of_parent, share_of_total, top_n
from cohortlens.plans.study import StudyTables, live
from cohortlens.sources.materialize import staged

MIN_YEAR, MIN_MONTH = 2015, 3


def _addresses(t: StudyTables) -> DataFrame:
    return t.person_address.select("person_id", "city_village", "date_created")


def _patients(t: StudyTables) -> DataFrame:
    return live(t.patient).select(F.col("patient_id").alias("person_id"))


def patients_by_region(
    t: StudyTables, n: int = 10, min_year: int = MIN_YEAR, min_month: int = MIN_MONTH,
    distinct_person: bool = False,
) -> DataFrame:
    """The ``n`` villages with the most enrolled patients, ties included.

    Address rows are counted, so a person with two addresses counts twice; ``distinct_person=True`` counts a
    person once per village.
    """
    addresses = _addresses(t).filter(calendar_parts("date_created", min_year, min_month))
    rows = skew_join(addresses, _patients(t), "person_id")
    if distinct_person:
        rows = rows.select(cap_words("city_village").alias("city_village"), "person_id").distinct()
    # Counted by the name as written; only the distinct spellings are capitalised and merged.
    spellings = rows.groupBy("city_village").agg(F.count(F.lit(1)).alias("addresses"))
    return _top_of(spellings, n)


def enrolment_cells(t: StudyTables, min_year: int = MIN_YEAR, min_month: int = MIN_MONTH) -> DataFrame:
    """Address rows of patients per (village as written, in the period, has a live person, sex), as a table.

    One pass over the addresses; the percentages below need it in several groupings.
    """
    sexes = live(t.person).select("person_id", "gender", F.lit(True).alias("is_live"))
    patients = _patients(t)
    rows = skew_join(
        _addresses(t), patients.join(sexes, "person_id", "left"), "person_id",
    )
    return staged(
        rows.groupBy(
            "city_village",
            F.coalesce(calendar_parts("date_created", min_year, min_month), F.lit(False)).alias("in_period"),
            F.coalesce("is_live", F.lit(False)).alias("is_live"),
            "gender",
        ).agg(F.count(F.lit(1)).alias("addresses"))
    )


def _top_of(spellings: DataFrame, n: int) -> DataFrame:
    counts = spellings.groupBy(cap_words("city_village").alias("city_village")).agg(
        F.sum("addresses").alias("patient_count")
    )
    return top_n(counts, n, "patient_count", rank="inv_rank")


def region_sex_share(
    t: StudyTables, n: int = 10, min_year: int = MIN_YEAR, min_month: int = MIN_MONTH,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Sexes inside the top villages as a percentage of the village.

    The parts need a live person row and the village total does not, so parts need not add up to 100.
    """
    cells = enrolment_cells(t, min_year, min_month) if cells is None else cells
    counts = cells.filter("in_period AND is_live").groupBy(
        cap_words("city_village").alias("city_village"), "gender"
    ).agg(F.sum("addresses").alias("pat_count"))
    return share_of_parent(counts, _top_of(cells.filter("in_period"), n), ["city_village"], "pat_count", "patient_count").select(
        "city_village", "gender", "pat_count", "percentage"
    )


def region_share(
    t: StudyTables, n: int = 10, min_year: int = MIN_YEAR, min_month: int = MIN_MONTH, normalise: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Share of every (village, sex) among all patients of the top villages, whatever their enrolment date.

    Village names are compared as written with the capitalised top list; ``normalise=True`` capitalises both.
    """
    cells = enrolment_cells(t, min_year, min_month) if cells is None else cells
    name = cap_words("city_village") if normalise else F.col("city_village")
    rows = cells.filter("is_live").withColumn("city_village", name)
    chosen = rows.join(_top_of(cells.filter("in_period"), n).select("city_village"), "city_village")
    return share_of_total(chosen, ["city_village", "gender"], weight="addresses")

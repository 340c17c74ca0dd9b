"""Laboratory results: cohorts of diagnosed persons, follow-up tests, and one measure in depth."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.dates import age_years
from cohortlens.functions.numbers import RESCALE_BANDS, rescale_outliers
from cohortlens.operators.distribution import linear_trend, quantiles, threshold_counts
from cohortlens.operators.joins import cohort_join, pair_measures, semi_join
from cohortlens.plans.study import StudyCodes, StudyTables, lab_rows, live
from cohortlens.sources.materialize import staged

# The tests the study calls important.
IMPORTANT_TESTS = (
    "Helminths parasite/Ova/Cyst/Trophozoites", "Occult Blood Test", "Blood (Stool)", "SGOT/AST", "SGPT/ALT",
    "Alkaline Phosphate", "Bilirubin Total", "Bilirubin Direct", "Protein (Serum)", "Albumin (Serum)",
    "A-G Ratio",
)
MEASURE_NAMES = ("Haemoglobin (Blood)", "Haemoglobin (Serum)")
LAB_COLUMNS = ("concept_id", "lab_test", "value_numeric", "value_text", "comments", "obs_datetime")


def cohort_lab_results(
    t: StudyTables, fact: DataFrame, diagnosis: str, codes: StudyCodes = StudyCodes(),
    with_age: bool = False, fan_out: bool = False, distinct_cohort: bool = False,
) -> DataFrame:
    """Laboratory results of the persons who have a diagnosis.

    One row per result. ``cohort_rows`` is the number of facts of that diagnosis the person has, which is
    how often a plain join lists the result; ``fan_out=True`` lists it that often. The cohort is written as a
    table first: it is used several times and is small next to the facts.
    """
    carry = ["gender", "age"] if with_age else ["gender"]
    cohort = staged(fact.filter(F.col("diagnosis") == diagnosis).select("person_id", *carry))
    joined = cohort_join(
        lab_rows(t, codes), cohort, carry=carry, fan_out=fan_out, distinct_cohort=distinct_cohort,
    )
    count = [] if fan_out else ["cohort_rows"]
    return joined.select("obs_id", "person_id", *carry, *LAB_COLUMNS, *count)


def important_tests(labs: DataFrame, sex: str = "F", tests: Sequence[str] = IMPORTANT_TESTS) -> DataFrame:
    """Results of the named tests for one sex."""
    return labs.filter((F.col("gender") == sex) & F.col("lab_test").isin(list(tests)))


def followup_of_positive(
    labs: DataFrame, first_test: str = "Occult Blood Test", positive: str = "Positive",
    second_test: str = "Helminths parasite/Ova/Cyst/Trophozoites",
) -> DataFrame:
    """Results of a second test for the persons whose first test was positive.

    The rows that matter are taken from ``labs`` in one pass and written; persons and results are read from there.
    """
    is_first = (F.col("lab_test") == first_test) & (F.col("value_text") == positive)
    rows = staged(labs.filter(is_first | (F.col("lab_test") == second_test)))
    positives, followups = rows.filter(is_first), rows.filter(F.col("lab_test") == second_test)
    return semi_join(followups, positives, "person_id")


def paired_lab_results(
    labs: DataFrame, low_test: str = "Haemoglobin (Blood)", limit: float = 11.0, paired_test: str = "HbA1c"
) -> DataFrame:
    """Results of one test next to the low results of another test of the same person.

    ``pairs`` counts the low results of the person as often as the cohort join lists them; the lowest, highest
    and mean low value stand for the single partners. ``cohort_rows`` is how often the row itself is listed.
    """
    is_low = (F.col("lab_test") == low_test) & (F.col("value_numeric") <= limit)
    rows = staged(labs.filter(is_low | (F.col("lab_test") == paired_test)))  # one pass over ``labs`` for both tests
    paired = pair_measures(rows.filter(F.col("lab_test") == paired_test), rows.filter(is_low), weight="cohort_rows")
    return paired.withColumn("partner_test", F.lit(low_test))


def measure_by_person(
    t: StudyTables, as_of: datetime.date, names: Sequence[str] = MEASURE_NAMES,
    codes: StudyCodes = StudyCodes(), per_person_mean: bool = False,
) -> DataFrame:
    """Mean, count and sum of a measure per (person, age, sex, birthdate, test, value).

    The value is part of the key as in the original study, so its mean is the value itself;
    ``per_person_mean=True`` leaves it out and gives the mean over a person's results.
    """
    keys = ["person_id", "lab_test"] + ([] if per_person_mean else ["value_numeric"])
    results = lab_rows(t, codes, names).groupBy(*keys).agg(
        F.avg("value_numeric").alias("measure_value"),
        F.count(F.lit(1)).alias("count"),
        F.sum("value_numeric").alias("value_sum"),
    )
    persons = live(t.person).select("person_id", "gender", "birthdate")
    return results.join(persons, "person_id").select(
        "person_id", age_years("birthdate", as_of).alias("age"), "gender", "birthdate", "lab_test",
        *keys[2:], "measure_value", "count", "value_sum",
    )


def repaired(measures: DataFrame, bands=RESCALE_BANDS) -> DataFrame:
    """Measures with values in the implausible bands scaled down."""
    return measures.withColumn("measure_value", rescale_outliers("measure_value", bands))


def value_quantiles(measures: DataFrame) -> DataFrame:
    """The 0, 1, ..., 100 % quantiles of the measure."""
    return quantiles(measures, "measure_value", [p / 100 for p in range(101)])


def repaired_trend(measures: DataFrame, bands=RESCALE_BANDS) -> DataFrame:
    """Trend of the measure on age per sex, before and after the repair, from one pass over the measures."""
    versions = F.array(
        F.struct(F.lit("before").alias("stage"), F.col("measure_value").alias("v")),
        F.struct(F.lit("after").alias("stage"), rescale_outliers("measure_value", bands).alias("v")),
    )
    both = measures.select("gender", "age", F.explode(versions).alias("_x")).select("gender", "age", "_x.*")
    return linear_trend(both, "v", "age", ["stage", "gender"])


def age_band(measures: DataFrame, low: float = 12, high: float = 18) -> DataFrame:
    """Repaired measures of persons within a closed age range."""
    return repaired(measures).filter(F.col("age").between(low, high))


def age_band_summary(measures: DataFrame, low: float = 12, high: float = 18, cut: float = 12.0) -> DataFrame:
    """Result rows of an age range per sex, in all and on each side of a threshold."""
    banded = age_band(measures, low, high)
    counts = threshold_counts(banded, "measure_value", cut, ["gender"])
    totals = banded.groupBy("gender").agg(F.count(F.lit(1)).alias("count"))
    return totals.join(counts, "gender")


def age_band_persons(measures: DataFrame, low: float = 12, high: float = 18, cut: float = 12.0) -> DataFrame:
    """Persons instead of result rows: those of an age range per sex, in all and with a value on each side.

    A person with values on both sides counts on both. Results are reduced to one row per person first.
    """
    value = F.col("measure_value")
    persons = age_band(measures, low, high).groupBy("gender", "person_id").agg(
        F.max((value < cut).cast("int")).alias("_below"), F.max((value >= cut).cast("int")).alias("_above")
    )
    return persons.groupBy("gender").agg(
        F.count(F.lit(1)).alias("persons"), F.coalesce(F.sum("_below"), F.lit(0)).alias("persons_below"),
        F.coalesce(F.sum("_above"), F.lit(0)).alias("persons_at_or_above"),
    )

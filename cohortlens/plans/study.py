"""The tables a study reads and the codes it looks for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.predicates import any_present, none_of
from cohortlens.operators.joins import skew_join


@dataclass(frozen=True)
class StudyTables:
    """Entity-attribute-value tables, each a lazy DataFrame.

    ``obs`` holds observations: a question (``concept_id``), one answer (``value_coded``, ``value_numeric``
    or ``value_text``) and the group row it belongs to (``obs_group_id``). ``obs_group`` holds those group
    rows and is ``obs`` itself unless they are kept apart.
    """

    person: DataFrame
    person_address: DataFrame
    obs: DataFrame | None = None
    concept: DataFrame | None = None
    concept_name: DataFrame | None = None
    patient: DataFrame | None = None
    obs_group: DataFrame | None = None

    @property
    def group_rows(self) -> DataFrame:
        return self.obs if self.obs_group is None else self.obs_group


# Fixed values of one hospital's concept dictionary.
@dataclass(frozen=True)
class StudyCodes:
    """Codes of the vocabulary; the defaults are those of the dictionary the studies were written for."""

    excluded_answers: Sequence[Any] = (1, 2, 17, 18, 20, 21)
    group_questions: Sequence[Any] = (13, 15, 16)
    diagnosis_class: Any = 4
    lab_class: Any = 26
    studied_code: Any = 5660
    name_type: str = "FULLY_SPECIFIED"
    locale: str = "en"


def live(df: DataFrame) -> DataFrame:
    """Rows that are not voided."""
    return df.filter(F.col("voided") == 0)


def full_names(t: StudyTables, codes: StudyCodes) -> DataFrame:
    """``(concept_id, name)`` of the full names in the study's language."""
    return (
        live(t.concept_name)
        .filter((F.col("concept_name_type") == codes.name_type) & (F.col("locale") == codes.locale))
        .select("concept_id", "name")
    )


def coded_in_class(t: StudyTables, codes: StudyCodes) -> DataFrame:
    """Observations whose answer is a diagnosis."""
    answers = t.concept.filter(F.col("class_id") == codes.diagnosis_class).select(
        F.col("concept_id").alias("value_coded")
    )
    return skew_join(t.obs, answers, "value_coded")


def useful_answers(t: StudyTables, codes: StudyCodes) -> DataFrame:
    """Observations whose answer is none of the uninteresting codes; observations without a code drop too."""
    return t.obs.filter(none_of("value_coded", codes.excluded_answers))


def lab_rows(
    t: StudyTables, codes: StudyCodes, names: Sequence[str] | None = None, include_voided: bool = False
) -> DataFrame:
    """Laboratory observations that have a number or a text, with the name of the test.

    Tests without a full name keep a NULL ``lab_test``. With ``names`` only those tests are kept. Concept and
    name are joined into one small dictionary first, so the observations are joined once.
    """
    obs = t.obs if include_voided else live(t.obs)
    results = obs.filter(any_present("value_numeric", "value_text"))
    tests = t.concept.filter(F.col("class_id") == codes.lab_class).select("concept_id")
    labels = full_names(t, codes).withColumnRenamed("name", "lab_test")
    if names is None:
        dictionary = tests.join(labels, "concept_id", "left")
    else:
        dictionary = tests.join(labels.filter(F.col("lab_test").isin(list(names))), "concept_id")
    return skew_join(results, dictionary, "concept_id")

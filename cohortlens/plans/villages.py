"""Village names cleaned, counted, placed on the map and joined back to the patients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.predicates import calendar_parts
from cohortlens.functions.text import cap_words, joined_address
from cohortlens.operators.geo import attach_coords, correct_column, geocode
from cohortlens.operators.joins import skew_join
from cohortlens.operators.ranking import add_rank
from cohortlens.operators.relational import drop_incomplete, having
from cohortlens.plans.study import StudyTables, live
from cohortlens.sources.materialize import staged
from cohortlens.sources.schemas import PATIENT_MAP_SCHEMA

# Spellings and what they are corrected to.
VILLAGE_CORRECTIONS = {
    "Baradadevi": "Baradadivi",
    "Batulasain": "Batulasen",
    "Chaphamandaun": "Chaphamandau",
    "Mastabandali": "Mashtanamdali",
    "Mastamandaun": "Mastamandau",
    "Hattikot": "Hatikot",
    "Ghodasain": "Dhodasain",
    "Kamalbazar Municipality": "Kamal Bazar",
    "Attariya Municipality": "Attariya",
}
ADDRESS_PARTS = ("Achham", "Nepal")
ADDRESS_COLUMNS = ("person_id", "postal_code", "latitude", "longitude", "city_village", "state_province", "country")


def enrolled_addresses(
    t: StudyTables, min_year: int = 2015, min_month: int = 3, columns: Sequence[str] | None = None
) -> DataFrame:
    """Live addresses of live persons who were registered in the period, village names capitalised.

    ``columns`` limits the person columns that are carried along.
    """
    present = [c for c in ADDRESS_COLUMNS if c in t.person_address.columns]
    addresses = live(t.person_address).select(*present, F.col("voided").alias("voided_x"))
    persons = live(t.person).filter(calendar_parts("date_created", min_year, min_month)).withColumnRenamed(
        "voided", "voided_y"
    )
    if columns is not None:
        persons = persons.select("person_id", *columns)
    joined = skew_join(addresses, persons, "person_id")
    return joined.withColumn("city_village", cap_words("city_village"))


def village_counts(
    addresses: DataFrame, corrections: Mapping[str, str] | DataFrame, min_count: int = 10,
    correct_after: bool = False, weight: str | None = None,
) -> DataFrame:
    """Patients per village with the dense rank, villages of at least ``min_count`` patients only.

    Spellings are corrected before counting, so variants of a name are merged. ``correct_after=True`` counts
    first, as the original script is written; names may then occur twice.
    """
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = staged(addresses.groupBy("city_village").agg(measure.alias("count")))
    if not correct_after:
        # Correct the distinct spellings, then merge them: the corrections touch one row per spelling.
        counts = correct_column(counts, "city_village", corrections).groupBy("city_village").agg(
            F.sum("count").alias("count")
        )
    # Smaller villages rank below all others, so dropping them first leaves the ranks as they are.
    ranked = add_rank(having(counts, F.col("count") >= min_count), "count")
    return correct_column(ranked, "city_village", corrections) if correct_after else ranked


def village_geo(
    addresses: DataFrame, gazetteer: DataFrame, corrections: Mapping[str, str] | DataFrame = VILLAGE_CORRECTIONS,
    min_count: int = 10, correct_after: bool = False, address_parts: Sequence[str] = ADDRESS_PARTS,
    country: str | None = None, weight: str | None = None,
) -> DataFrame:
    """Counted villages with address text and coordinates; villages without coordinates are dropped.

    The gazetteer is searched by village name. The result is a table, so the join back to the patients knows
    how small it is.
    """
    counted = village_counts(addresses, corrections, min_count, correct_after, weight)
    addressed = counted.withColumn("address", joined_address("city_village", address_parts))
    return staged(drop_incomplete(geocode(addressed, gazetteer, "city_village", country)).select(
        "city_village", "count", "inv_rank", "address", "lon", "lat"
    ))


def shared_coordinates(villages: DataFrame, more_than: int = 1) -> DataFrame:
    """Coordinates that more than ``more_than`` villages have, with their number and patients: a geocoder's fallback."""
    at_point = villages.groupBy("lon", "lat").agg(
        F.count_distinct("city_village").alias("villages"), F.sum("count").alias("patients")
    )
    return at_point.filter(F.col("villages") > more_than)


def repeated_villages(villages: DataFrame) -> DataFrame:
    """Names that a village list has more than once (``correct_after=True`` can), which would repeat patients on a map."""
    return villages.groupBy("city_village").agg(F.count(F.lit(1)).alias("entries")).filter(F.col("entries") > 1)


def patient_map(
    addresses: DataFrame, villages: DataFrame,
    corrections: Mapping[str, str] | DataFrame = VILLAGE_CORRECTIONS,
) -> DataFrame:
    """One row per enrolled address in a mapped village, with the village's rank, address and coordinates."""
    corrected = correct_column(addresses, "city_village", corrections)
    return attach_coords(corrected, villages.drop("count"), "city_village")


def patient_map_export(patients: DataFrame) -> DataFrame:
    """The patient map in the column layout of its file; columns the tables do not have are NULL."""
    source = {"add_personId": "person_id", "voided.x": "voided_x", "voided.y": "voided_y"}
    columns = []
    for field in PATIENT_MAP_SCHEMA:
        name = source.get(field.name, field.name)
        value = F.col(name) if name in patients.columns else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return patients.select(*columns)


def map_points(patients: DataFrame) -> DataFrame:
    """Patients per point and sex, as a table: all that the density, the bounding box and the pie map need."""
    return staged(
        patients.groupBy("lat", "lon", "city_village", "gender").agg(F.count(F.lit(1)).alias("patients"))
    )

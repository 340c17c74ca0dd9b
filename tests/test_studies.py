"""The studies on small tables of the record's own shape."""

import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortlens import operators as op
from cohortlens.plans import StudyTables, diagnosis, labs, regions, villages
from cohortlens.plans.dashboard import dashboard_frames
from cohortlens.sources import read_csv, write_csv
from cohortlens.sources.schemas import PATIENT_MAP_SCHEMA

AS_OF = datetime.date(2016, 12, 31)


def at(text):
    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def t(spark):
    person = [
        (1, "F", datetime.date(2000, 7, 1), 0, at("2015-03-02")),
        (2, "M", datetime.date(1990, 7, 1), 0, at("2016-01-02")),
        (3, "F", datetime.date(1980, 7, 1), 1, at("2016-04-02")),  # voided
        (4, "F", datetime.date(2003, 7, 1), 0, at("2016-05-02")),
    ]
    address = [
        (1, "payal", at("2015-03-02"), 0), (1, "darna", at("2016-02-02"), 0),  # two addresses
        (2, "payal", at("2016-03-05"), 0), (3, "payal", at("2016-04-05"), 0), (4, "kalika", at("2014-12-05"), 0),
        (4, "kalika", at("2016-12-05"), 1),
    ]
    names = [
        (100, "Gastritis", "FULLY_SPECIFIED", "en", 0), (100, "Gastrite", "FULLY_SPECIFIED", "fr", 0),
        (101, "Burn", "FULLY_SPECIFIED", "en", 1), (102, "Fever", "SHORT", "en", 0),
        (200, "Occult Blood Test", "FULLY_SPECIFIED", "en", 0),
        (201, "Helminths parasite/Ova/Cyst/Trophozoites", "FULLY_SPECIFIED", "en", 0),
        (202, "Haemoglobin (Blood)", "FULLY_SPECIFIED", "en", 0), (203, "HbA1c", "FULLY_SPECIFIED", "en", 0),
    ]
    concept = [(100, 4), (101, 4), (102, 7), (200, 26), (201, 26), (202, 26), (203, 26), (204, 26), (5660, 4)]
    # obs_id, person, concept, group, at, coded, numeric, text, voided
    obs = [
        (10, 1, 13, None, at("2015-01-01"), None, None, None, 0),
        (11, 2, 15, None, at("2015-01-01"), None, None, None, 0),
        (12, 1, 99, None, at("2015-01-01"), None, None, None, 0),  # not a diagnosis group
        (20, 1, 50, 10, at("2015-01-05"), 100, None, None, 0),
        (21, 1, 50, 10, at("2015-02-05"), 100, None, None, 1),  # voided, counts in the facts
        (22, 1, 50, 10, at("2015-02-05"), 1, None, None, 0),  # uninteresting answer
        (23, 2, 50, 11, at("2015-02-05"), 101, None, None, 0),  # its name is voided
        (24, 2, 50, 12, at("2015-02-05"), 100, None, None, 0),  # group of another kind
        (25, 3, 50, 11, at("2015-02-05"), 100, None, None, 0),  # voided person
        (26, 2, 50, None, at("2015-03-05"), 5660, None, None, 0),
        (27, 2, 50, None, at("2016-03-05"), 5660, None, None, 0),
        (28, 2, 50, None, at("2016-03-06"), 5660, None, None, 1),
        (30, 1, 200, None, at("2016-01-01"), None, None, "Positive", 0),
        (31, 2, 200, None, at("2016-01-01"), None, None, "Negative", 0),
        (32, 1, 201, None, at("2016-01-01"), None, None, "Seen", 0),
        (33, 2, 201, None, at("2016-01-01"), None, None, "Seen", 0),
        (34, 1, 202, None, at("2016-01-01"), None, 10.0, None, 0),
        (35, 1, 202, None, at("2016-01-02"), None, 11.0, None, 0),
        (36, 1, 203, None, at("2016-01-02"), None, 6.5, None, 0),
        (37, 1, 203, None, at("2016-01-03"), None, 7.5, None, 0),
        (38, 1, 204, None, at("2016-01-03"), None, 1.0, None, 0),  # a test without a name
        (39, 1, 202, None, at("2016-01-03"), None, None, None, 0),  # neither number nor text
        (40, 2, 202, None, at("2016-01-03"), None, 135.0, None, 0),
        (41, 4, 202, None, at("2016-01-03"), None, 12.5, None, 0),
        (42, 4, 202, None, at("2016-01-04"), None, 12.5, None, 0),
    ]
    return StudyTables(
        person=spark.createDataFrame(person, "person_id long, gender string, birthdate date, voided int, date_created timestamp_ntz"),
        person_address=spark.createDataFrame(address, "person_id long, city_village string, date_created timestamp_ntz, voided int"),
        patient=spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "patient_id long, voided int"),
        obs=spark.createDataFrame(
            [(*o[:8], "", o[8]) for o in obs],
            "obs_id long, person_id long, concept_id long, obs_group_id long, obs_datetime timestamp_ntz, "
            "value_coded long, value_numeric double, value_text string, comments string, voided int",
        ),
        concept=spark.createDataFrame(concept, "concept_id long, class_id int"),
        concept_name=spark.createDataFrame(
            names, "concept_id long, name string, concept_name_type string, locale string, voided int"
        ),
    )


def test_fact_by_group(t):
    fact = diagnosis.diagnosis_fact_by_group(t, AS_OF)
    assert rows(fact, "person_id", "diagnosis_id", "diagnosis", "count", "city_village", "age") == [
        (1, 100, "Gastritis", 2, "darna", 16.5), (1, 100, "Gastritis", 2, "payal", 16.5),
        (2, 101, None, 1, "payal", 26.5),
    ]
    live = diagnosis.diagnosis_fact_by_group(t, AS_OF, include_voided=False)
    assert rows(live.filter("person_id = 1").select("count").distinct()) == [(1,)]


def test_fact_of_named_diagnoses(t, no_broadcast):
    for build in (diagnosis.diagnosis_fact_by_group, diagnosis.diagnosis_fact_by_class):
        whole = build(t, AS_OF).filter(F.col("diagnosis") == "Gastritis")
        assert rows(build(t, AS_OF, only=["Gastritis"])) == rows(whole)


def test_fact_by_class(t):
    fact = diagnosis.diagnosis_fact_by_class(t, AS_OF)
    got = rows(fact, "person_id", "diagnosis_id", "diagnosis", "count", "city_village")
    assert got == [
        (1, 100, "Gastritis", 2, "darna"), (1, 100, "Gastritis", 2, "payal"), (2, 100, "Gastritis", 1, "payal"),
        (2, 101, None, 1, "payal"), (2, 5660, None, 3, "payal"),
    ]
    assert "date_enrolled" in fact.columns


def test_rankings_count_rows_and_keep_the_unnamed_group(t):
    fact = diagnosis.diagnosis_fact_by_class(t, AS_OF)
    assert rows(diagnosis.top_diagnoses(fact)) == [("Gastritis", 3, 1), (None, 2, 2)]
    assert rows(diagnosis.top_diagnoses(fact, weight="count")) == [("Gastritis", 5, 1), (None, 4, 2)]
    assert rows(diagnosis.top_by_sex(fact)) == [("Gastritis", "F", 2), ("Gastritis", "M", 1)]
    assert rows(diagnosis.top_by_sex(fact, null_safe=True))[-1] == (None, "M", 2)
    assert rows(diagnosis.top_regions_per_diagnosis(fact)) == [("Gastritis", "darna", 1, 2), ("Gastritis", "payal", 2, 1)]
    assert rows(diagnosis.diagnosis_master(fact)) == [("Gastritis",), (None,)]


def test_rank_restarts_for_every_diagnosis_and_sex(spark):
    # 2 diagnoses x 2 sexes x 3 villages
    cells = [(d, s, v, n) for d in "AB" for s in "FM" for v, n in (("x", 5), ("y", 3), ("z", 3))]
    got = diagnosis.regions_by_sex(spark.createDataFrame(cells, "diagnosis string, gender string, city_village string, facts long"))
    assert sorted(r.reg_rank for r in got.collect()) == [1] * 4 + [2] * 8


def test_disease_frames(t):
    fact = diagnosis.diagnosis_fact_by_class(t, AS_OF)
    ages = diagnosis.disease_ages(fact, "Gastritis")
    assert rows(ages, "person_id", "city_village") == [(1, "darna"), (1, "payal"), (2, "payal")]
    assert diagnosis.disease_age_boxes(ages).agg(F.sum("n")).first()[0] == 3
    assert diagnosis.disease_age_histogram(ages).agg(F.sum("n")).first()[0] == 3
    assert diagnosis.disease_age_outliers(ages).count() == 0
    assert rows(diagnosis.disease_regions(fact, "Gastritis")) == [
        ("darna", "F", 1, 1), ("payal", "F", 1, 2), ("payal", "M", 1, 2)
    ]


def test_code_trend(t):
    assert rows(diagnosis.code_trend(t)) == [(3, 2015, 1), (3, 2016, 1)]
    assert rows(diagnosis.code_trend(t, include_voided=True)) == [(3, 2015, 1), (3, 2016, 2)]


def test_regions(t):
    assert rows(regions.patients_by_region(t)) == [("Payal", 3, 1)]
    # The voided person counts in the total only, so the parts do not add up to 100.
    assert rows(regions.region_sex_share(t)) == [("Payal", "F", 1, 33.33), ("Payal", "M", 1, 33.33)]
    # Names are compared as written unless normalised.
    assert regions.region_share(t).count() == 0
    assert rows(regions.region_share(t, normalise=True)) == [("Payal", "F", 1, 0.5), ("Payal", "M", 1, 0.5)]
    assert rows(regions.patients_by_region(t, distinct_person=True)) == [("Payal", 3, 1)]


def test_cohort_labs(t):
    fact = diagnosis.diagnosis_fact_by_class(t, AS_OF)
    results = labs.cohort_lab_results(t, fact, "Gastritis")
    assert sorted(r.obs_id for r in results.collect()) == [30, 31, 32, 33, 34, 35, 36, 37, 38, 40]
    assert {(r.person_id, r.cohort_rows) for r in results.collect()} == {(1, 2), (2, 1)}
    assert rows(results.filter("obs_id = 38"), "lab_test") == [(None,)]
    listed = labs.cohort_lab_results(t, fact, "Gastritis", fan_out=True)
    assert listed.count() == results.agg(F.sum("cohort_rows")).first()[0]
    assert rows(labs.important_tests(results), "obs_id") == [(30,), (32,)]
    assert rows(labs.followup_of_positive(results), "obs_id") == [(32,)]


def test_paired_results(t):
    fact = diagnosis.diagnosis_fact_by_class(t, AS_OF).filter("city_village = 'payal'")
    results = labs.cohort_lab_results(t, fact, "Gastritis", with_age=True)
    got = labs.paired_lab_results(results)
    assert rows(got, "obs_id", "pairs", "partner_min", "partner_max", "partner_mean", "age") == [
        (36, 2, 10.0, 11.0, 10.5, 16.5), (37, 2, 10.0, 11.0, 10.5, 16.5)
    ]


def test_measures(t):
    measures = labs.measure_by_person(t, AS_OF)
    assert rows(measures, "person_id", "value_numeric", "measure_value", "count", "value_sum") == [
        (1, 10.0, 10.0, 1, 10.0), (1, 11.0, 11.0, 1, 11.0), (2, 135.0, 135.0, 1, 135.0), (4, 12.5, 12.5, 2, 25.0)
    ]
    means = labs.measure_by_person(t, AS_OF, per_person_mean=True)
    assert rows(means, "person_id", "measure_value") == [(1, 10.5), (2, 135.0), (4, 12.5)]
    assert rows(labs.repaired(measures).filter("person_id = 2"), "measure_value") == [(1.35,)]
    assert rows(labs.age_band_summary(measures)) == [("F", 3, 2, 1)]
    trend = {(r.stage, r.gender): r.n for r in labs.repaired_trend(measures).collect()}
    assert trend == {("before", "F"): 3, ("after", "F"): 3, ("before", "M"): 1, ("after", "M"): 1}
    quantile = {r.prob: r.quantile for r in labs.value_quantiles(measures).collect()}
    assert (len(quantile), quantile[0.0], quantile[0.5], quantile[1.0]) == (101, 10.0, 11.75, 135.0)


def test_patient_map(spark, t):
    addresses = villages.enrolled_addresses(t)
    # Registered in 2015-03 or later, month 3 or later: persons 1 and 4; the voided address drops.
    assert rows(addresses, "person_id", "city_village") == [(1, "Darna"), (1, "Payal"), (4, "Kalika")]
    gazetteer = spark.createDataFrame([("Payal", 81.19, 29.17), ("Darna", 81.34, 29.19)], "name string, lon double, lat double")
    found = villages.village_geo(addresses, gazetteer, min_count=1)
    mapped = villages.patient_map(addresses, found)
    assert rows(mapped, "person_id", "city_village", "lon", "voided_x", "voided_y") == [
        (1, "Darna", 81.34, 0, 0), (1, "Payal", 81.19, 0, 0)
    ]
    assert villages.map_points(mapped).agg(F.sum("patients")).first()[0] == 2


def test_patient_map_file(spark, t, tmp_path):
    gazetteer = spark.createDataFrame([("Payal", 81.19, 29.17), ("Darna", 81.34, 29.19)], "name string, lon double, lat double")
    addresses = villages.enrolled_addresses(t)
    mapped = villages.patient_map(addresses, villages.village_geo(addresses, gazetteer, min_count=1))
    path = str(tmp_path / "map")
    write_csv(villages.patient_map_export(mapped), path)
    back = read_csv(spark, path, PATIENT_MAP_SCHEMA)
    assert len(back.columns) == 29
    got = rows(back, "add_personId", "city_village", "`voided.x`", "gender", "date_created", "address", "lat", "uuid")
    assert got == [
        (1, "Darna", 0, "F", at("2015-03-02"), "Darna   Achham   Nepal", 29.19, None),
        (1, "Payal", 0, "F", at("2015-03-02"), "Payal   Achham   Nepal", 29.17, None),
    ]
    pies = op.pie_map(op.add_record_count(back), 1, weight="number_of_records")
    assert pies.agg(F.sum("records")).first()[0] == 2


def test_dashboard(t):
    frames = dashboard_frames(t, AS_OF)
    try:
        counts = {name: frame.count() for name, frame in frames.items()}
    finally:
        frames["fact"].unpersist()
        frames["measures"].unpersist()
    assert len(counts) == 11
    assert counts["measure_lines"] == 4 and counts["teen_points"] == 3 and counts["code_trend"] == 2

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortlens import operators as op
from cohortlens.plans import villages

# Raw spellings with their patients, and what cleaning makes of them.
RAW = [
    ("Sanfebagar municipality", 8350), ("Mangalsen municipality", 3182), ("Sanfebagar Municipality", 2720),
    ("Baradadevi", 2540), ("Barhabis", 2196), ("Mangalsen Municipality", 1179), ("Hattikot", 978),
    ("Hatikot", 1), ("Batulasain", 641), ("tiny, place", 9),
]
CLEAN = [
    ("Barhabis", 2196, 4), ("Baradadivi", 2540, 3), ("Batulasen", 641, 6), ("Hatikot", 979, 5),
    ("Mangalsen Municipality", 4361, 2), ("Sanfebagar Municipality", 11070, 1),
]


@pytest.fixture(scope="module")
def raw(spark):
    from cohortlens.functions import cap_words

    df = spark.createDataFrame(RAW, "city_village string, n long")
    return df.withColumn("city_village", cap_words("city_village"))


def test_village_counts(raw):
    got = villages.village_counts(raw, villages.VILLAGE_CORRECTIONS, weight="n")
    assert sorted(rows(got, "city_village", "count", "inv_rank")) == sorted(CLEAN)


def test_correcting_after_counting_keeps_variants_apart(raw):
    got = villages.village_counts(raw, villages.VILLAGE_CORRECTIONS, correct_after=True, weight="n")
    counts = {r.city_village: r["count"] for r in got.collect()}
    assert counts["Hatikot"] == 978


def test_village_geo_drops_places_without_coordinates(spark, raw):
    gazetteer = spark.createDataFrame(
        [("sanfebagar municipality", "NP", 81.2188355, 29.2105258), ("Hatikot", "NP", 81.25, 29.27),
         ("Hatikot", "IN", 70.0, 20.0), ("", "NP", 1.0, 1.0)],
        "name string, country string, lon double, lat double",
    )
    got = villages.village_geo(raw, gazetteer, country="NP", weight="n")
    assert rows(got) == [
        ("Hatikot", 979, 5, "Hatikot   Achham   Nepal", 81.25, 29.27),
        ("Sanfebagar Municipality", 11070, 1, "Sanfebagar Municipality   Achham   Nepal", 81.2188355, 29.2105258),
    ]


def test_geocode_blank_and_unknown_names_give_null(spark):
    gazetteer = spark.createDataFrame([("A b", 1.0, 2.0), ("a  B ", 0.5, 3.0)], "name string, lon double, lat double")
    df = spark.createDataFrame([("a B",), ("",), ("   ",), (None,), ("nowhere",)], "place string")
    got = op.geocode(df, gazetteer, "place", order=["lon"])
    assert got.count() == 5
    assert rows(got.filter("lon IS NOT NULL")) == [("a B", 0.5, 3.0)]
    assert rows(op.drop_incomplete(got.withColumn("place", F.coalesce("place", F.lit("-"))))) == [("a B", 0.5, 3.0)]


def test_corrections_table_equals_mapping(spark, no_broadcast):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "name string, n int")
    table = spark.createDataFrame([("a", "z")], "wrong string, right string")
    assert rows(op.correct_column(df, "name", table)) == rows(op.correct_column(df, "name", {"a": "z"}))
    twice = spark.createDataFrame([("a", "z"), ("a", "y")], "wrong string, right string")
    with pytest.raises(Exception, match="several corrections for a"):
        op.correct_column(df, "name", twice).collect()


# Sums of a published map: place, sex, patients.
PIES = [
    ("Mangalsen Municipality", "F", 2557), ("Kailashmandau", "F", 621), ("Sanfebagar Municipality", "F", 6356),
    ("Payal", "F", 1060), ("Kalika", "F", 986), ("Baradadivi", "F", 1523), ("Darna", "M", 662), ("Kalika", "M", 607),
]


def test_pie_map(spark):
    extra = [("Payal", "M", 499), ("Kalika", "O", 900)]
    df = spark.createDataFrame([(29.0, 81.0, *p) for p in PIES + extra],
                               "lat double, lon double, city_village string, gender string, n long")
    got = op.pie_map(df, 500, ("F", "M"), weight="n")
    assert sorted(rows(got, "city_village", "gender", "records")) == sorted(PIES)
    shares = {(r.city_village, r.gender): (r.pie_total, r.share) for r in got.collect()}
    assert shares["Kalika", "F"] == (1593, 986 / 1593)
    assert shares["Payal", "F"] == (1060, 1.0)


def test_coordinates(spark):
    df = spark.createDataFrame([(81.123456, 28.82), (81.52, 29.32)], "lon double, lat double")
    assert rows(op.bounding_box(df)) == [(81.123456, 81.52, 28.82, 29.32)]
    assert rows(op.round_coords(df))[0] == (81.1235, 28.82)


def test_attach_coords_spreads_a_large_place(no_broadcast):
    df = no_broadcast.range(1000).select("id", F.when(F.col("id") % 3 < 2, "Big").otherwise("Small").alias("place"))
    places = no_broadcast.createDataFrame([("Big", 1.0, 2.0)], "place string, lon double, lat double")
    assert op.attach_coords(df, places, "place").count() == 667

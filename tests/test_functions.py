import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortlens import functions as fn


def one(spark, value, kind, build):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(build("v")).first()[0]


@pytest.mark.parametrize("text, want", [
    ("sanfebagar municipality", "Sanfebagar Municipality"),
    ("McX aB", "McX AB"),
    ("jhalari-pipaladi town", "Jhalari-pipaladi Town"),
    ("two  spaces", "Two  Spaces"),
    ("tail ", "Tail"),
    ("tail  ", "Tail "),
    (" lead", " Lead"),
    ("", ""),
    (None, None),
])
def test_cap_words(spark, text, want):
    assert one(spark, text, "string", fn.cap_words) == want


def test_correct_values_passes_others_through_and_is_idempotent(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    fixed = df.select(fn.correct_values("v", {"a": "z"}).alias("v"))
    assert rows(fixed) == [("b",), ("z",), (None,)]
    assert rows(fixed.select(fn.correct_values("v", {"a": "z"}))) == rows(fixed)
    assert rows(df.select(fn.correct_values("v", {}))) == rows(df)
    many = df.select(fn.correct_values("v", {"b": "y"} | {str(i): "x" for i in range(1000)}))
    assert rows(many) == [("a",), ("y",), (None,)]


@pytest.mark.parametrize("value, want", [
    (135.0, 1.35), (156.2, 1.562), (6200.0, 6.2), (100.0, 1.0), (999.99, 9.9999), (999.995, 999.995),
    (1000.0, 1.0), (9999.99, 9.99999), (12000.0, 12000.0), (11.5, 11.5), (None, None),
])
def test_rescale_outliers(spark, value, want):
    got = one(spark, value, "double", fn.rescale_outliers)
    assert got == (pytest.approx(want) if want is not None else None)


def test_joined_address_has_three_spaces_and_keeps_null(spark):
    df = spark.createDataFrame([("Payal",), (None,)], "v string")
    got = [r[0] for r in df.select(fn.joined_address("v", ["Achham", "Nepal"])).collect()]
    assert got == ["Payal   Achham   Nepal", None]


@pytest.mark.parametrize("born, day, want", [
    ("2000-02-29", "2000-02-29", 0.0),
    ("2000-02-29", "2001-03-01", 1.0),
    ("2000-02-29", "2004-02-29", 4.0),
    ("2000-02-29", "2003-08-30", 3.5),
    ("1990-07-01", "2016-12-31", 26.5),
    ("2016-12-31", "2016-12-31", 0.0),
])
def test_age_years(spark, born, day, want):
    df = spark.createDataFrame([(datetime.date.fromisoformat(born),)], "b date")
    assert df.select(fn.age_years("b", datetime.date.fromisoformat(day))).first()[0] == want


def test_parsing_bad_text_gives_null(spark):
    df = spark.createDataFrame([("2015-03-01", "2015-03-01 10:20:30", "1.5"), ("junk", "junk", "junk")], "d string, t string, n string")
    got = df.select(fn.parse_date("d"), fn.parse_datetime("t"), fn.cast_numeric("n"))
    assert [tuple(r) for r in got.collect()] == [
        (datetime.date(2015, 3, 1), datetime.datetime(2015, 3, 1, 10, 20, 30), 1.5), (None, None, None)
    ]
    assert dict(got.dtypes)[got.columns[1]] == "timestamp_ntz"


def test_calendar_parts_is_not_a_date_filter(spark):
    months = [(2014, 12), (2015, 2), (2015, 3), (2016, 1), (2016, 3)]
    df = spark.createDataFrame([(datetime.datetime(y, m, 15),) for y, m in months], "t timestamp_ntz")
    by_parts = df.filter(fn.calendar_parts("t", 2015, 3)).select(F.year("t"), F.month("t"))
    assert rows(by_parts) == [(2015, 3), (2016, 3)]
    plain = df.filter(fn.since("t", datetime.date(2015, 3, 1))).select(F.year("t"), F.month("t"))
    assert rows(plain) == [(2015, 3), (2016, 1), (2016, 3)]


def test_none_of_drops_null(spark):
    df = spark.createDataFrame([(None,), (1,), (5660,)], "c long")
    assert rows(df.filter(fn.none_of("c", [1, 2]))) == [(5660,)]


def test_any_present(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, "x"), (3, None, None)], "id int, n double, t string")
    assert rows(df.filter(fn.any_present("n", "t")).select("id")) == [(1,), (2,)]


def test_attr(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "k int, v string")
    assert rows(df.groupBy("k").agg(fn.attr("v"))) == [(1, "a"), (2, "*"), (3, "*")]


def test_labels(spark):
    df = spark.createDataFrame([(1234567, 0.1234)], "n long, s double")
    assert tuple(df.select(fn.comma_label("n"), fn.pct_label("s")).first()) == ("1,234,567", "12.3%")


@pytest.mark.parametrize("dof, want, tolerance", [(1, 12.7062, 1e-4), (2, 4.3027, 1e-4), (30, 2.0423, 1e-4), (31, 2.0395, 1e-4), (1000, 1.9623, 1e-4)])
def test_t_critical(spark, dof, want, tolerance):
    got = spark.createDataFrame([(float(dof),)], "v double").select(fn.t_critical(F.col("v"))).first()[0]
    assert got == pytest.approx(want, abs=tolerance)


def test_several_distinct_counts_copy_no_rows(spark):
    from cohortlens.operators import column_summary

    df = spark.createDataFrame([(1, "a", 1.5, 7), (1, None, 2.5, 8), (2, "b", 2.5, None), (2, "b", None, 9)], "`x.y` int, s string, d double, n long")
    kinds = {"x.y": "count_distinct", "s": "count_distinct", "d": "count_distinct"}
    got = column_summary(df, kinds)
    assert got.columns == ["count_distinct_x.y", "count_distinct_s", "count_distinct_d", "sum_n"]
    assert tuple(got.first()) == (2, 2, 2, 24)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(column_summary(df, {**kinds, "n": "count_distinct"}).first()) == (2, 2, 2, 3)
    assert tuple(column_summary(df.limit(0), kinds).first()) == (0, 0, 0, None)
    assert tuple(column_summary(df, {"s": "count_distinct"}).first()) == (6, 2, 6.5, 24)

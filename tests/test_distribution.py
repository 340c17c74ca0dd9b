import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cohortlens import operators as op
from cohortlens.operators import distribution


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(3)
    data = [("F", round(rng.gauss(12, 2), 2)) for _ in range(400)] + [("M", round(rng.gauss(14, 3), 2)) for _ in range(333)]
    data += [("F", 135.0), ("F", 6200.0), ("M", None)]
    return data, spark.createDataFrame(data, "g string, v double").cache()


def of(data, group):
    return [v for g, v in data if g == group and v is not None]


def test_quantiles_equal_numpy(sample):
    data, df = sample
    probs = [p / 100 for p in range(101)]
    got = {(r.g, r.prob): r.quantile for r in op.quantiles(df, "v", probs, ["g"]).collect()}
    assert len(got) == 202
    for g in "FM":
        for p, want in zip(probs, np.quantile(of(data, g), probs)):
            assert got[g, p] == pytest.approx(want)


def test_weighted_quantiles_equal_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 2)], "v double, w long")
    got = {r.prob: r.quantile for r in op.quantiles(df, "v", [0, 0.25, 0.5, 0.9, 1], weight="w").collect()}
    want = np.quantile([1, 1, 1, 2, 10, 10], [0, 0.25, 0.5, 0.9, 1])
    assert [got[p] for p in (0, 0.25, 0.5, 0.9, 1)] == pytest.approx(list(want))


def test_quantiles_of_one_value(spark):
    df = spark.createDataFrame([(5.0,)], "v double")
    assert {r.quantile for r in op.quantiles(df, "v", [0, 0.5, 1]).collect()} == {5.0}


def test_box_stats(sample):
    data, df = sample
    for r in op.box_stats(df, "v", ["g"]).collect():
        values = of(data, r.g)
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = [v for v in values if low <= v <= high]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, median, q3))
        assert (r.whisker_low, r.whisker_high) == (min(inside), max(inside))
        assert (r.outliers, r.n) == (len(values) - len(inside), len(values))
    outliers = op.box_outliers(df, "v", ["g"])
    assert outliers.agg(F.sum("n")).first()[0] == op.box_stats(df, "v", ["g"]).agg(F.sum("outliers")).first()[0]
    assert {6200.0, 135.0} <= {r.v for r in outliers.collect()}


def test_histogram_counts_every_row(sample):
    data, df = sample
    bars = op.histogram(df, "v", ["g"], 20)
    assert bars.agg(F.sum("n")).first()[0] == len(of(data, "F")) + len(of(data, "M"))
    for r in bars.collect():
        inside = [v for v in of(data, r.g) if r.bin_low - 1e-6 < v <= r.bin_high + 1e-6]
        assert r.n <= len(inside)


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert rows(op.histogram(df, "v")) == [(1, 4.5, 5.5, 2)]


def test_linear_trend_equals_numpy(sample):
    rng = random.Random(5)
    _, df = sample
    points = [("a", float(x), 2 * x + 1 + rng.uniform(-1, 1)) for x in range(30)] + [("b", 1.0, 1.0), ("b", 2.0, 3.0)]
    df = df.sparkSession.createDataFrame(points, "g string, x double, y double")
    trend = {r.g: r for r in op.linear_trend(df, "y", "x", ["g"]).collect()}
    x, y = np.array([p[1] for p in points[:30]]), np.array([p[2] for p in points[:30]])
    slope, intercept = np.polyfit(x, y, 1)
    residual = np.sqrt(((y - slope * x - intercept) ** 2).sum() / 28)
    assert (trend["a"].slope, trend["a"].intercept) == pytest.approx((slope, intercept))
    assert (trend["a"].residual_se, trend["a"].dof) == (pytest.approx(residual), 28)
    assert (trend["b"].slope, trend["b"].residual_se, trend["b"].dof) == (pytest.approx(2.0), None, None)
    band = op.linear_band(df, "y", "x", ["g"], points=5).filter("g = 'a'").orderBy("step").collect()
    assert [r.x for r in band] == pytest.approx([0, 7.25, 14.5, 21.75, 29])
    middle = band[2]
    assert middle.se == pytest.approx(residual * np.sqrt(1 / 30))
    assert middle.upper - middle.fit == pytest.approx(2.0484 * middle.se, rel=1e-3)


def test_linear_trend_guards(spark):
    df = spark.createDataFrame([("one", 1.0, 1.0), ("flat", 2.0, 1.0), ("flat", 2.0, 5.0), ("flat", 2.0, 6.0)],
                               "g string, x double, y double")
    for r in op.linear_trend(df, "y", "x", ["g"]).collect():
        assert r.slope is None and r.residual_se is None


def test_bars(spark):
    df = spark.createDataFrame([("x", "F", 3), ("x", "M", 1), ("y", "F", 9)], "k string, s string, n long")
    assert rows(op.stacked_bar(df, "k", "s", weight="n")) == [("x", "F", 3, 2), ("x", "M", 1, 2), ("y", "F", 9, 1)]
    assert rows(op.filled_bar(df, "k", "s", weight="n")) == [
        ("x", "F", 3, 0.75, 0.75), ("x", "M", 1, 0.25, 1.0), ("y", "F", 9, 1.0, 1.0)
    ]
    assert rows(op.faceted_counts(df, "s", "k", weight="n")) == [("F", "x", 3), ("F", "y", 9), ("M", "x", 1)]


def test_threshold_and_series(spark):
    df = spark.createDataFrame([("F", 11.9, 3.0), ("F", 12.0, 1.0), ("F", None, 2.0)], "g string, v double, x double")
    assert rows(op.threshold_counts(df, "v", 12, ["g"])) == [("F", 1, 1)]
    assert [r.x for r in op.line_series(df, "x", "v", ["g"]).collect()] == [1.0, 3.0]


def test_density_equals_direct_sum(spark):
    rng = random.Random(11)
    pts = [(81 + rng.random(), 29 + rng.random(), rng.randint(1, 9)) for _ in range(40)]
    df = spark.createDataFrame(pts, "lon double, lat double, w long")
    cells = op.density_2d(df, weight="w", grid=(7, 5)).collect()
    assert len(cells) == 35
    x, y, w = (np.array(c, dtype=float) for c in zip(*pts))
    rx, ry = np.repeat(x, w.astype(int)), np.repeat(y, w.astype(int))

    def width(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(statistics.stdev(v), (q3 - q1) / 1.34) * len(v) ** -0.2

    sx, sy = width(rx), width(ry)
    for r in cells:
        assert r.gx == pytest.approx(np.linspace(x.min(), x.max(), 7)[r.ix])
        want = (w * np.exp(-0.5 * ((r.gx - x) / sx) ** 2 - 0.5 * ((r.gy - y) / sy) ** 2)).sum()
        assert r.density == pytest.approx(want / (2 * np.pi * sx * sy * w.sum()))
    bands = op.density_bands(op.density_2d(df, weight="w", grid=(7, 5))).select("band").collect()
    assert max(b.band for b in bands) == 16 and min(b.band for b in bands) >= 1


def test_density_when_most_points_coincide(spark):
    # The interquartile range is 0, so the standard deviation takes over.
    df = spark.createDataFrame([(81.25, 29.04)] * 9 + [(81.5, 29.3)], "lon double, lat double")
    cells = op.density_2d(df, grid=(5, 5)).collect()
    assert len(cells) == 25 and all(np.isfinite(r.density) for r in cells)


def test_density_of_one_point_is_an_error(spark):
    df = spark.createDataFrame([(81.25, 29.04)] * 5, "lon double, lat double")
    with pytest.raises(Exception, match="all points share one value"):
        op.density_2d(df, grid=(5, 5)).collect()


def test_drill_counts_and_summary(spark):
    df = spark.createDataFrame([("NP", "x", 1.0), ("NP", "y", 2.0), ("IN", "x", None)], "c string, s string, v double")
    assert rows(op.drill_counts(df, ["c", "s"])) == [
        ("IN", "x", 1, 0), ("IN", None, 1, 1), ("NP", "x", 1, 0), ("NP", "y", 1, 0), ("NP", None, 2, 1),
        (None, None, 3, 3),
    ]
    summary = op.column_summary(df, {"s": "count_distinct", "v": "avg"}).first().asDict()
    assert summary == {"count_c": 3, "count_distinct_s": 2, "avg_v": 1.5}


@pytest.mark.parametrize("sort_rows", [0, 20])
def test_quantiles_of_odd_values(spark, monkeypatch, sort_rows):
    """Far apart, equal, infinite, not a number; weights of zero; groups without a name."""
    monkeypatch.setattr(distribution, "SORT_ROWS", sort_rows)
    rnd = np.random.default_rng(11)
    values = [*(10.0 ** rnd.uniform(-300, 300, 200)), *(-(10.0 ** rnd.uniform(-12, 12, 100))), 0.0, -0.0, 1.7e308, -1.7e308, 5e-324, *[3.25] * 50]
    data = [("a", float(v), 1 + i % 3) for i, v in enumerate(values)] + [(None, float(i), i % 2) for i in range(9)] + [("b", 1.0, 1), ("b", None, 5)]
    df = spark.createDataFrame(data, "g string, v double, w int").repartition(7)
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    got = {(r.g, r.prob): r.quantile for r in op.quantiles(df, "v", probs, ["g"], weight="w").collect()}
    for g in ("a", None, "b"):
        full = np.array(sorted(v for k, v, w in data if k == g and v is not None for _ in range(w)))
        for p in probs:
            h = (len(full) - 1) * p
            low, high = full[int(np.floor(h))], full[int(np.ceil(h))]
            assert got[g, p] == pytest.approx(low + (high - low) * (h - np.floor(h)), rel=1e-12), (g, p)
    ends = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, float("inf"), float("nan"))], "v double")
    got = {r.prob: r.quantile for r in op.quantiles(ends, "v", [0.25, 0.5]).collect()}
    assert got == {0.25: 1.0, 0.5: 2.0}
    assert op.quantiles(df.limit(0), "v", probs, ["g"]).collect() == []


def test_quantiles_of_very_many_groups_and_no_shuffle_of_values(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id % 40 AS g", "CAST((id * 7919) % 5003 AS DOUBLE) AS v")
    few = {tuple(r) for r in op.quantiles(df, "v", [0.1, 0.5], ["g"]).collect()}
    monkeypatch.setattr(distribution, "MOST_GROUPS", 10)
    assert {tuple(r) for r in op.quantiles(df, "v", [0.1, 0.5], ["g"]).collect()} == few
    monkeypatch.undo()
    monkeypatch.setattr(distribution, "SORT_ROWS", 0)
    assert {tuple(r) for r in op.quantiles(df, "v", [0.1, 0.5], ["g"]).collect()} == few
    found = distribution._needed_positions(df, "v", [0.5], ["g"], None)
    assert found.count() <= 2 * 40
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # tables of single order statistics are left

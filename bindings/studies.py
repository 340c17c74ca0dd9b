"""Chart statistics, places on the map, and the composed studies."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import AS_OF, CODES, PLACE_CORRECTIONS, PLACE_PARTS, ctes
from cohortlens import operators as op
from cohortlens.plans import diagnosis, labs, regions, villages
from cohortlens.sources import literal_frame, read_csv, shared_folder, write_csv

DISEASE = "red widget"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _group_fact(v, only=None):
    return diagnosis.diagnosis_fact_by_group(v.diagnosis_by_group(), AS_OF, CODES, only=only)


def _disease_ages(v):
    return diagnosis.disease_ages(_group_fact(v), DISEASE, rows=_group_fact(v, only=[DISEASE]))


def _measures(v):
    return labs.measure_by_person(v.labs(), AS_OF, ("Click", "Purchase"), CODES)


def _cohort_labs(v, **options):
    return labs.cohort_lab_results(v.labs(), _group_fact(v, only=[DISEASE]), DISEASE, CODES, **options)


def _places(v, columns=("gender", "birthdate", "date_created")):
    return villages.enrolled_addresses(v.places(), columns=columns)


def _villages(v, **options):
    return villages.village_geo(
        _places(v, columns=()), v.gazetteer(), PLACE_CORRECTIONS, address_parts=PLACE_PARTS, country="NP", **options
    )


def _points(v, columns=("gender",)):
    return villages.patient_map(_places(v, columns), _villages(v), PLACE_CORRECTIONS)


# ---- chart statistics

_BARS = "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2"


def _segments(v):
    return v.home().join(v.person().select("person_id", "gender"), "person_id").select(
        F.col("city_village").alias("n_name"), F.col("gender").alias("c_mktsegment")
    )


@query("stacked_bar", f"""WITH bars AS ({_BARS}) SELECT n_name, c_mktsegment, n, category_order FROM bars JOIN
    (SELECT n_name, CAST(row_number() OVER (ORDER BY avg(n) DESC, n_name) AS INTEGER) AS category_order FROM bars
    GROUP BY 1) USING (n_name)""")
def _(v):
    return op.stacked_bar(_segments(v), "n_name", "c_mktsegment")


@query("filled_bar", f"""WITH bars AS ({_BARS}) SELECT n_name, c_mktsegment, n,
    round(n / sum(n) OVER (PARTITION BY n_name), 6) AS share, round(sum(n) OVER (PARTITION BY n_name
    ORDER BY c_mktsegment) / sum(n) OVER (PARTITION BY n_name), 6) AS label_at FROM bars""")
def _(v):
    return _rounded(op.filled_bar(_segments(v), "n_name", "c_mktsegment"), "share", "label_at")


@query("trend_month_year", """SELECT CAST(year(l_shipdate) AS INTEGER) AS obs_year,
    CAST(month(l_shipdate) AS INTEGER) AS obs_month, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(v):
    monthly = diagnosis.month_year_counts(v.coded_obs())
    return op.faceted_counts(monthly, "obs_year", "obs_month", weight="count")


_FENCES = """SELECT event_type, quantile_cont(value, 25e-2) AS q1, quantile_cont(value, 5e-1) AS median,
    quantile_cont(value, 75e-2) AS q3 FROM events GROUP BY 1"""


@query("box_stats", f"""WITH q AS ({_FENCES}) SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median,
    round(q3, 6) AS q3, min(value) FILTER (ok) AS whisker_low, max(value) FILTER (ok) AS whisker_high,
    count(*) FILTER (NOT ok) AS outliers, count(*) AS n FROM (SELECT event_type, value, q1, median, q3,
    value BETWEEN q1 - (q3 - q1) * 15e-1 AND q3 + (q3 - q1) * 15e-1 AS ok FROM events JOIN q USING (event_type))
    GROUP BY event_type, q1, median, q3""")
def _(v):
    return _rounded(op.box_stats(v.table("events"), "value", ["event_type"]), "q1", "median", "q3")


@query("box_outliers", f"""WITH q AS ({_FENCES}) SELECT event_type, value, count(*) AS n FROM events
    JOIN q USING (event_type) WHERE value NOT BETWEEN q1 - (q3 - q1) * 15e-1 AND q3 + (q3 - q1) * 15e-1
    GROUP BY 1, 2""")
def _(v):
    return op.box_outliers(v.table("events"), "value", ["event_type"])


def _histogram_sql(source: str, value: str, by: str, weight: str = "count(*)") -> str:
    return f"""r AS (SELECT min({value}) AS lo, (max({value}) - min({value})) / 19e0 AS w FROM {source}),
    o AS (SELECT lo, w, w / 2 + floor((lo - w / 2) / w) * w AS org FROM r),
    b AS (SELECT {by}, CAST(greatest(ceil(({value} - (SELECT org FROM o)) / (SELECT w FROM o) - 1e-8), 1) AS INTEGER)
    AS bin FROM {source})
    SELECT {by}, bin, round((SELECT org FROM o) + (bin - 1) * (SELECT w FROM o), 6) AS bin_low,
    round((SELECT org FROM o) + bin * (SELECT w FROM o), 6) AS bin_high, count(*) AS n FROM b GROUP BY {by}, bin"""


@query("histogram_20", "WITH " + _histogram_sql("events", "value", "event_type"))
def _(v):
    return _rounded(op.histogram(v.table("events"), "value", ["event_type"], 20), "bin_low", "bin_high")


_REG = """SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n,
    regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
    regr_avgx(l_extendedprice, l_quantity) AS mean_x, regr_sxx(l_extendedprice, l_quantity) AS sxx,
    min(l_quantity) AS min_x, max(l_quantity) AS max_x, count(*) - 2 AS dof,
    sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity)
    * regr_sxy(l_extendedprice, l_quantity)) / (count(*) - 2)) AS residual_se FROM lineitem GROUP BY 1"""


@query("linear_trend", f"""SELECT l_returnflag, n, round(slope, 3) AS slope, round(intercept, 3) AS intercept,
    round(mean_x, 3) AS mean_x, round(sxx, 2) AS sxx, min_x, max_x, dof, round(residual_se, 3) AS residual_se FROM ({_REG})""")
def _(v):
    out = op.linear_trend(v.table("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return _rounded(_rounded(out, "slope", "intercept", "mean_x", "residual_se", digits=3), "sxx", digits=2)


# 97.5 % points of Student's t distribution for 1 to 4 degrees of freedom, from a printed table.
_T_SMALL = "(VALUES (1, 12.706205e0), (2, 4.302653e0), (3, 3.182446e0), (4, 2.776445e0)) k(dof, t)"


@query("linear_band_small", f"""WITH p AS (SELECT o_custkey, o_totalprice AS y,
    CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x FROM orders),
    t AS (SELECT o_custkey, count(*) AS n, avg(x) AS mx, avg(y) AS my, min(x) AS lo, max(x) AS hi, count(*) - 2 AS dof
    FROM p GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6 AND min(x) < max(x)),
    c AS (SELECT o_custkey, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS slope
    FROM p JOIN t USING (o_custkey) GROUP BY 1),
    r AS (SELECT o_custkey, sqrt(sum(pow(y - my - slope * (x - mx), 2)) / any_value(dof)) AS s
    FROM p JOIN t USING (o_custkey) JOIN c USING (o_custkey) GROUP BY 1)
    SELECT o_custkey, step, dof, round(my + slope * (lo + (hi - lo) * step / 2 - mx), 2) AS fit,
    round(my + slope * (lo + (hi - lo) * step / 2 - mx) - k.t * s * sqrt(1e0 / n + pow(lo + (hi - lo) * step / 2 - mx, 2) / sxx), 2) AS lower
    FROM t JOIN c USING (o_custkey) JOIN r USING (o_custkey) JOIN {_T_SMALL} USING (dof), (VALUES (0), (1), (2)) g(step)""")
def _(v):
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))
    orders = v.table("orders").select("o_custkey", "o_totalprice", day.cast("double").alias("day"))
    few = orders.groupBy("o_custkey").agg(F.count("*").alias("_n"), F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    few = few.filter(F.col("_n").between(3, 6) & (F.col("_lo") < F.col("_hi"))).select("o_custkey")
    out = op.linear_band(op.semi_join(orders, few, "o_custkey"), "o_totalprice", "day", ["o_custkey"], points=3)
    return _rounded(out.select("o_custkey", "step", "dof", "fit", "lower"), "fit", "lower", digits=2)


_Z = 1.959964
_T = (
    f"({_Z} + {(_Z**3 + _Z) / 4!r} / dof + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96!r} / pow(dof, 2) "
    f"+ {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384!r} / pow(dof, 3))"
)


@query("linear_band", f"""WITH t AS ({_REG}), g AS (SELECT *, CAST(unnest(range(80)) AS INTEGER) AS step FROM t),
    x AS (SELECT *, min_x + (max_x - min_x) * step / 79e0 AS x FROM g),
    s AS (SELECT *, intercept + slope * x AS fit, residual_se * sqrt(1e0 / n + pow(x - mean_x, 2) / sxx) AS se FROM x)
    SELECT l_returnflag, step, round(x, 4) AS x, round(fit, 3) AS fit, round(se, 3) AS se, dof,
    round(fit - {_T} * se, 3) AS lower, round(fit + {_T} * se, 3) AS upper FROM s""")
def _(v):
    out = op.linear_band(v.table("lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return _rounded(_rounded(out, "fit", "se", "lower", "upper", digits=3), "x", digits=4)


@query("point_series", ctes("lab_obs") + """SELECT concept_id, obs_datetime, value_numeric FROM lab_obs
    WHERE value_numeric IS NOT NULL""")
def _(v):
    return op.point_series(v.lab_obs(), "obs_datetime", "value_numeric", ["concept_id"])


@query("line_series", "SELECT event_type, ts, value FROM events ORDER BY 1, 2")
def _(v):
    return op.line_series(v.table("events"), "ts", "value", ["event_type"])


@query("threshold_counts", """SELECT event_type, count(*) FILTER (value < 12) AS below,
    count(*) FILTER (value >= 12) AS at_or_above FROM events GROUP BY 1""")
def _(v):
    return op.threshold_counts(v.table("events"), "value", 12, ["event_type"])


_DENSITY = """p AS (SELECT lon AS x, lat AS y FROM points),
    s AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
      106e-2 * least(stddev_samp(x), CASE WHEN quantile_cont(x, 75e-2) > quantile_cont(x, 25e-2)
        THEN (quantile_cont(x, 75e-2) - quantile_cont(x, 25e-2)) / 134e-2 ELSE stddev_samp(x) END) * pow(count(*), -2e-1) AS sx,
      106e-2 * least(stddev_samp(y), CASE WHEN quantile_cont(y, 75e-2) > quantile_cont(y, 25e-2)
        THEN (quantile_cont(y, 75e-2) - quantile_cont(y, 25e-2)) / 134e-2 ELSE stddev_samp(y) END) * pow(count(*), -2e-1) AS sy
      FROM p),
    w AS (SELECT x, y, count(*) AS w FROM p GROUP BY 1, 2),
    c AS (SELECT i AS ix, j AS iy FROM range(100) a(i), range(100) b(j)),
    d AS (SELECT ix, iy, x0 + ix * (x1 - x0) / 99e0 AS gx, y0 + iy * (y1 - y0) / 99e0 AS gy,
      sum(w * exp(-5e-1 * pow((x0 + ix * (x1 - x0) / 99e0 - x) / sx, 2) - 5e-1 * pow((y0 + iy * (y1 - y0) / 99e0 - y) / sy, 2)))
      / (2 * pi() * any_value(sx * sy * n)) AS density FROM c, w, s GROUP BY ix, iy, gx, gy)"""


@query("density_2d", ctes("points") + "," + _DENSITY + """ SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy,
    round(gx, 6) AS gx, round(gy, 6) AS gy, round(density, 6) AS density FROM d""")
def _(v):
    return _rounded(op.density_2d(villages.map_points(_points(v)), weight="patients"), "gx", "gy", "density")


@query("density_bands", ctes("points") + "," + _DENSITY + """ SELECT band, count(*) AS cells FROM (SELECT
    CAST(least(floor(density / (SELECT max(density) FROM d) * 16) + 1, 16) AS INTEGER) AS band FROM d) GROUP BY 1""")
def _(v):
    grid = op.density_2d(villages.map_points(_points(v)), weight="patients")
    return op.density_bands(grid).groupBy("band").agg(F.count(F.lit(1)).alias("cells"))


# ---- places


@query("geocode_lookup", ctes("place_rows", "gazetteer") + """SELECT name, customers, lon, lat FROM
    (SELECT city_village AS name, count(*) AS customers FROM place_rows GROUP BY 1)
    LEFT JOIN (SELECT name, min(lon) AS lon, min_by(lat, lon) AS lat FROM gazetteer GROUP BY 1) USING (name)""")
def _(v):
    names = op.correct_column(_places(v, columns=()), "city_village", PLACE_CORRECTIONS)
    counts = op.count_by(names, "city_village", name="customers").withColumnRenamed("city_village", "name")
    return op.geocode(counts, v.gazetteer(), "name", order=["lon"])


@query("round_coords", ctes("home") + "SELECT person_id, round(lon / 7, 4) AS lon, round(lat / 7, 4) AS lat FROM home")
def _(v):
    moved = v.home().select("person_id", (F.col("lon") / 7).alias("lon"), (F.col("lat") / 7).alias("lat"))
    return op.round_coords(moved)


@query("correct_column", """SELECT p_partkey, coalesce(rightname, p_name) AS p_name FROM part LEFT JOIN (VALUES
    ('hot gizmo', 'hot gear'), ('old rod', 'old ring')) t(wrong, rightname) ON wrong = p_name""")
def _(v):
    table = literal_frame(v.spark, [("hot gizmo", "hot gear"), ("old rod", "old ring")], "wrong string, right string")
    return op.correct_column(v.table("part").select("p_partkey", "p_name"), "p_name", table)


@query("patient_points", ctes("points") + """SELECT person_id, city_village, gender, inv_rank, lon, lat FROM points""")
def _(v):
    return _points(v).select("person_id", "city_village", "gender", "inv_rank", "lon", "lat")


@query("pie_map", ctes("home") + """SELECT lat, lon, city_village, gender, records,
    sum(records) OVER (PARTITION BY lat, lon, city_village) AS pie_total,
    round(records / sum(records) OVER (PARTITION BY lat, lon, city_village), 6) AS share FROM
    (SELECT lat, lon, city_village, c_mktsegment AS gender, count(*) AS records FROM home
    JOIN customer ON c_custkey = person_id WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2, 3, 4)
    WHERE records >= 10""")
def _(v):
    people = op.add_record_count(v.home().join(v.person().select("person_id", "gender"), "person_id"))
    pies = op.pie_map(people, 10, ("BUILDING", "MACHINERY"), weight="number_of_records")
    return _rounded(pies, "share")


# ---- diagnoses


@query("diag_fact_group", ctes("fact_group") + "SELECT * FROM fact_group")
def _(v):
    return _group_fact(v)


@query("diag_fact_class", ctes("fact_class") + "SELECT * FROM fact_class")
def _(v):
    return diagnosis.diagnosis_fact_by_class(v.diagnosis_by_class(), AS_OF, CODES)


@query("diag_master", ctes("fact_group") + "SELECT DISTINCT diagnosis FROM fact_group")
def _(v):
    return diagnosis.diagnosis_master(_group_fact(v))


@query("diag_top10", ctes("top10") + "SELECT diagnosis, diag_count, inv_rank FROM top10")
def diag_top10(v):
    return diagnosis.top_diagnoses(_group_fact(v), 10)


@query("diag_top10_by_sex", ctes("top10") + """SELECT diagnosis, gender, count(*) AS diag_sex_count FROM fact_group
    JOIN top10 USING (diagnosis) GROUP BY 1, 2""")
def _(v):
    return diagnosis.top_by_sex(_group_fact(v))


@query("diag_top_regions", ctes("regions") + "SELECT diagnosis, city_village, diag_region_count, reg_rank FROM regions")
def _(v):
    return diagnosis.top_regions_per_diagnosis(_group_fact(v))


@query("diag_regions_by_sex", ctes("regions_sex") + "SELECT * FROM regions_sex")
def _(v):
    return diagnosis.regions_by_sex(_group_fact(v))


@query("disease_regions", ctes("regions_sex") + """, bars AS (SELECT city_village, gender,
    sum(diag_sex_region_count) AS n FROM regions_sex WHERE diagnosis = 'red widget' GROUP BY 1, 2)
    SELECT city_village, gender, CAST(n AS BIGINT) AS n, category_order FROM bars JOIN (SELECT city_village,
    CAST(row_number() OVER (ORDER BY avg(n) DESC, city_village) AS INTEGER) AS category_order FROM bars GROUP BY 1)
    USING (city_village)""")
def _(v):
    return diagnosis.disease_regions(_group_fact(v), DISEASE)


@query("disease_ages", ctes("ages") + """, q AS (SELECT city_village, gender, quantile_cont(age, 25e-2) AS q1,
    quantile_cont(age, 5e-1) AS median, quantile_cont(age, 75e-2) AS q3 FROM ages GROUP BY 1, 2)
    SELECT city_village, gender, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    min(age) FILTER (ok) AS whisker_low, max(age) FILTER (ok) AS whisker_high,
    count(*) FILTER (NOT ok) AS outliers, count(*) AS n FROM (SELECT city_village, gender, age, q1, median, q3,
    age BETWEEN q1 - (q3 - q1) * 15e-1 AND q3 + (q3 - q1) * 15e-1 AS ok FROM ages JOIN q USING (city_village, gender))
    GROUP BY city_village, gender, q1, median, q3""")
def _(v):
    ages = _disease_ages(v)
    return _rounded(diagnosis.disease_age_boxes(ages), "q1", "median", "q3")


@query("disease_age_outliers", ctes("ages") + """, q AS (SELECT city_village, gender, quantile_cont(age, 25e-2) AS q1,
    quantile_cont(age, 75e-2) AS q3 FROM ages GROUP BY 1, 2)
    SELECT city_village, gender, age, count(*) AS n FROM ages JOIN q USING (city_village, gender)
    WHERE age NOT BETWEEN q1 - (q3 - q1) * 15e-1 AND q3 + (q3 - q1) * 15e-1 GROUP BY 1, 2, 3""")
def _(v):
    return diagnosis.disease_age_outliers(_disease_ages(v))


@query("disease_age_histogram", ctes("ages") + ", " + _histogram_sql("ages", "age", "city_village, gender"))
def _(v):
    out = diagnosis.disease_age_histogram(_disease_ages(v))
    return _rounded(out, "bin_low", "bin_high")


@query("code_trend", """SELECT CAST(month(l_shipdate) AS INTEGER) AS obs_month,
    CAST(year(l_shipdate) AS INTEGER) AS obs_year, count(*) AS count FROM lineitem
    WHERE l_linestatus = 'F' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name = 'red widget') GROUP BY 1, 2""")
def _(v):
    codes = v.table("part").filter(F.col("p_name") == DISEASE).select(F.col("p_partkey").alias("value_coded"))
    obs = v.coded_obs().filter(F.col("voided") == 0)
    return diagnosis.month_year_counts(op.semi_join(obs, codes, "value_coded"))


@query("code_trend_coded", """SELECT CAST(month(l_shipdate) AS INTEGER) AS obs_month,
    CAST(year(l_shipdate) AS INTEGER) AS obs_year, count(*) AS count FROM lineitem
    WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY 1, 2""")
def _(v):
    flags = v.coded_obs().withColumn("value_coded", F.col("value_text"))
    return diagnosis.code_trend(replace(v.diagnosis_by_group(), obs=flags), ["R"], CODES)


# ---- regions


@query("patients_by_region", ctes("top_villages") + "SELECT city_village, patient_count, inv_rank FROM top_villages")
def _(v):
    return regions.patients_by_region(v.enrolments(), 10, 1998, 3)


@query("region_sex_share", ctes("top_villages", "person") + """SELECT city_village, gender, count(*) AS pat_count,
    round(count(*) / any_value(patient_count) * 100, 2) AS percentage FROM enrolled e JOIN person p
    ON p.person_id = e.person_id AND p.voided = 0 JOIN top_villages USING (city_village) GROUP BY 1, 2""")
def _(v):
    return regions.region_sex_share(v.enrolments(), 10, 1998, 3)


@query("region_share", ctes("top_villages", "person") + """, x AS (SELECT city_village, gender, count(*) AS n
    FROM enrolment e JOIN patient q ON q.patient_id = e.person_id AND q.voided = 0
    JOIN person p ON p.person_id = e.person_id AND p.voided = 0 JOIN top_villages USING (city_village) GROUP BY 1, 2)
    SELECT city_village, gender, n, round(n / (SELECT sum(n) FROM x), 6) AS share FROM x""")
def _(v):
    return _rounded(regions.region_share(v.enrolments(), 10, 1998, 3), "share")


# ---- laboratory results


@query("cohort_labs", ctes("cohort_labs") + """SELECT obs_id, person_id, gender, concept_id, lab_test, value_numeric,
    value_text, comments, obs_datetime, cohort_rows FROM cohort_labs""")
def _(v):
    return _cohort_labs(v)


@query("important_tests", ctes("cohort_labs") + """SELECT obs_id, person_id, lab_test, value_numeric, value_text,
    cohort_rows FROM cohort_labs WHERE gender = 'MACHINERY' AND lab_test IN ('Click', 'Error', 'Purchase')""")
def _(v):
    rows = labs.important_tests(_cohort_labs(v), "MACHINERY", ("Click", "Error", "Purchase"))
    return rows.select("obs_id", "person_id", "lab_test", "value_numeric", "value_text", "cohort_rows")


@query("followup_of_positive", ctes("cohort_labs") + """SELECT obs_id, person_id, lab_test, value_numeric, cohort_rows
    FROM cohort_labs WHERE lab_test = 'Click' AND person_id IN
    (SELECT person_id FROM cohort_labs WHERE lab_test = 'Error' AND value_text = 'Positive')""")
def _(v):
    rows = labs.followup_of_positive(_cohort_labs(v), "Error", "Positive", "Click")
    return rows.select("obs_id", "person_id", "lab_test", "value_numeric", "cohort_rows")


@query("paired_lab_results", ctes("cohort_labs") + """SELECT obs_id, a.person_id, gender, age, lab_test, value_numeric,
    cohort_rows, pairs, partner_min, partner_max, round(partner_mean, 6) AS partner_mean, 'Error' AS partner_test
    FROM cohort_labs a JOIN (SELECT person_id, sum(cohort_rows) AS pairs, min(value_numeric) AS partner_min,
      max(value_numeric) AS partner_max, sum(value_numeric * cohort_rows) / sum(cohort_rows) AS partner_mean
      FROM cohort_labs WHERE lab_test = 'Error' AND value_numeric <= 11 GROUP BY 1) b ON a.person_id = b.person_id
    WHERE lab_test = 'Purchase'""")
def _(v):
    rows = labs.paired_lab_results(_cohort_labs(v, with_age=True), "Error", 11.0, "Purchase")
    return _rounded(rows, "partner_mean").drop("concept_id", "value_text", "comments", "obs_datetime")


@query("measure_by_person", ctes("measures") + """SELECT person_id, age, gender, birthdate, lab_test, value_numeric,
    round(measure_value, 6) AS measure_value, count, round(value_sum, 4) AS value_sum FROM measures""")
def _(v):
    return _rounded(_rounded(_measures(v), "measure_value"), "value_sum", digits=4)


@query("measure_quantiles", ctes("measures") + """SELECT p / 100e0 AS prob, round(quantile, 6) AS quantile FROM (SELECT
    unnest(range(101)) AS p, unnest((SELECT quantile_cont(measure_value, list_transform(range(101), lambda i: i / 100e0))
    FROM measures)) AS quantile)""")
def _(v):
    return _rounded(labs.value_quantiles(_measures(v)), "quantile")


_FIXED = """CASE WHEN measure_value BETWEEN 100 AND 999.99 THEN measure_value / 100
    WHEN measure_value BETWEEN 1000 AND 9999.99 THEN measure_value / 1000 ELSE measure_value END"""


@query("repaired_trend", ctes("measures") + f""", x AS (SELECT 'before' AS stage, gender, CAST(age AS DOUBLE) AS age,
    measure_value AS v FROM measures UNION ALL SELECT 'after', gender, CAST(age AS DOUBLE), {_FIXED} FROM measures)
    SELECT stage, gender, regr_count(v, age) AS n, round(regr_slope(v, age), 5) AS slope,
    round(regr_intercept(v, age), 4) AS intercept, round(regr_avgx(v, age), 5) AS mean_x,
    round(regr_sxx(v, age), 3) AS sxx, min(age) FILTER (v IS NOT NULL) AS min_x, max(age) FILTER (v IS NOT NULL) AS max_x,
    regr_count(v, age) - 2 AS dof, round(sqrt((regr_syy(v, age) - regr_slope(v, age) * regr_sxy(v, age))
    / (regr_count(v, age) - 2)), 4) AS residual_se FROM x GROUP BY 1, 2""")
def _(v):
    out = labs.repaired_trend(_measures(v))
    out = _rounded(out, "slope", "mean_x", digits=5)
    return _rounded(_rounded(out, "intercept", "residual_se", digits=4), "sxx", digits=3)


@query("age_band_summary", ctes("measures") + f"""SELECT gender, count(*) AS count,
    count(*) FILTER ({_FIXED} < 12) AS below, count(*) FILTER ({_FIXED} >= 12) AS at_or_above
    FROM measures WHERE age BETWEEN 12 AND 18 GROUP BY 1""")
def _(v):
    return labs.age_band_summary(_measures(v))


@query("age_band_points", ctes("measures") + f"""SELECT gender, age, round({_FIXED}, 6) AS measure_value FROM measures
    WHERE age BETWEEN 12 AND 18 AND measure_value IS NOT NULL""")
def _(v):
    points = op.point_series(labs.age_band(_measures(v)), "age", "measure_value", ["gender"])
    return _rounded(points, "measure_value")


@query("age_band_persons", ctes("measures") + f"""SELECT gender, count(DISTINCT person_id) AS persons,
    count(DISTINCT person_id) FILTER ({_FIXED} < 12) AS persons_below,
    count(DISTINCT person_id) FILTER ({_FIXED} >= 12) AS persons_at_or_above
    FROM measures WHERE age BETWEEN 12 AND 18 GROUP BY 1""")
def _(v):
    return labs.age_band_persons(_measures(v))


# ---- villages


@query("shared_coordinates", ctes("village_geo") + """SELECT lon, lat, count(DISTINCT city_village) AS villages,
    CAST(sum(count) AS BIGINT) AS patients FROM village_geo GROUP BY 1, 2 HAVING count(DISTINCT city_village) > 1""")
def _(v):
    return villages.shared_coordinates(_villages(v))


@query("repeated_villages", ctes("place_rows") + """SELECT city_village, count(*) AS entries FROM (SELECT CASE raw_village
    WHEN 'Hot Gizmo' THEN 'Hot Gear' WHEN 'Old Rod' THEN 'Old Ring' WHEN 'Red Plate' THEN 'Red Widget' ELSE raw_village
    END AS city_village FROM place_rows GROUP BY raw_village HAVING count(*) >= 10) GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    counted = villages.village_counts(_places(v, columns=()), PLACE_CORRECTIONS, correct_after=True)
    return villages.repeated_villages(counted)


@query("village_geo", ctes("village_geo") + "SELECT city_village, count, inv_rank, address, lon, lat FROM village_geo")
def _(v):
    return _villages(v)


@query("village_counts_corrected_after", ctes("place_rows") + """SELECT CASE raw_village WHEN 'Hot Gizmo' THEN 'Hot Gear'
    WHEN 'Old Rod' THEN 'Old Ring' WHEN 'Red Plate' THEN 'Red Widget' ELSE raw_village END AS city_village,
    count, inv_rank FROM (SELECT raw_village, count(*) AS count,
    CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank FROM place_rows GROUP BY 1) WHERE count >= 10""")
def _(v):
    return villages.village_counts(_places(v, columns=()), PLACE_CORRECTIONS, correct_after=True)


@query("patient_map", ctes("points") + """SELECT person_id, gender, birthdate, date_created, city_village, inv_rank,
    address, lon, lat FROM points""")
def _(v):
    return _points(v, ("gender", "birthdate", "date_created")).select(
        "person_id", "gender", "birthdate", "date_created", "city_village", "inv_rank", "address", "lon", "lat"
    )


@query("patient_map_file", ctes("points") + """SELECT person_id AS add_personId, gender, birthdate, date_created,
    city_village, CAST(inv_rank AS INTEGER) AS inv_rank, address, lon, lat FROM points""")
def _(v):
    export = villages.patient_map_export(_points(v, ("gender", "birthdate", "date_created")))
    path = f"{shared_folder(v.spark)}/patients-{uuid.uuid4().hex}"
    write_csv(export, path)
    return read_csv(v.spark, path, villages.PATIENT_MAP_SCHEMA).select(
        "add_personId", "gender", "birthdate", "date_created", "city_village", "inv_rank", "address", "lon", "lat"
    )


@query("patient_map_box", ctes("points") + """SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat,
    max(lat) AS max_lat FROM points""")
def _(v):
    return op.bounding_box(_points(v, ()))

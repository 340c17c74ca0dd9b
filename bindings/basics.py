"""Sources, projections, filters, joins, aggregates, ranks, orderings and scalar functions."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from bindings.registry import query
from bindings.views import AGE, AS_OF, PLACE_PARTS, cap_sql, ctes
from cohortlens import functions as fn
from cohortlens import operators as op
from cohortlens.sources import literal_frame, read_csv, shared_folder, write_csv


def _r(c, digits=6, name=None):
    return F.round(c, digits).alias(name or c)


# ---- sources


def _through_csv(v, df):
    """Written as CSV files to the shared folder and read back with the same columns."""
    path = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    write_csv(df, path)
    return read_csv(v.spark, path, df.schema)


@query("csv_round_trip", """SELECT p_partkey, p_name || ', "' || p_type || '"' AS label, p_size, p_retailprice,
    CASE WHEN p_size > 25 THEN p_brand END AS brand FROM part""")
def _(v):
    label = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("label")
    brand = F.when(F.col("p_size") > 25, F.col("p_brand")).alias("brand")
    return _through_csv(v, v.table("part").select("p_partkey", label, "p_size", "p_retailprice", brand))


@query("scan_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def _(v):
    return v.table("orders")


@query("literal_rows", """SELECT o_orderpriority, urgent, count(*) AS orders FROM orders
    JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 1), ('5-LOW', 0)) t(o_orderpriority, urgent) USING (o_orderpriority)
    GROUP BY 1, 2""")
def _(v):
    rows = [("1-URGENT", 1), ("2-HIGH", 1), ("5-LOW", 0)]
    levels = literal_frame(v.spark, rows, "o_orderpriority string, urgent int")
    return v.table("orders").join(levels, "o_orderpriority").groupBy("o_orderpriority", "urgent").agg(
        F.count(F.lit(1)).alias("orders")
    )


# ---- projection and schema


@query("project_columns", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem")
def _(v):
    return op.project(v.table("lineitem"), keep=["l_orderkey", "l_partkey", "l_shipdate"])


@query("project_drop", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def _(v):
    return op.project(v.table("part"), drop=["p_size", "p_retailprice"])


@query("project_rename", "SELECT c_custkey AS person_id, c_nationkey AS place, c_mktsegment AS gender FROM customer")
def _(v):
    return op.project(
        v.table("customer"), keep=["c_custkey", "c_nationkey", "c_mktsegment"],
        rename={"c_custkey": "person_id", "c_nationkey": "place", "c_mktsegment": "gender"},
    )


@query("derive_columns", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
    round(round(l_extendedprice * (1 - l_discount), 4) * l_tax, 7) AS tax, CAST(year(l_shipdate) AS INTEGER) AS ship_year
    FROM lineitem""")
def _(v):
    return (
        v.table("lineitem")
        .withColumns({
            "net": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4), "ship_year": F.year("l_shipdate"),
        })
        .withColumns({"tax": F.round(F.col("net") * F.col("l_tax"), 7)})
        .select("l_orderkey", "l_linenumber", "net", "tax", "ship_year")
    )


@query("join_suffixes", """SELECT person_id, c.voided AS voided_x, c.gender, p.voided AS voided_y, p.name FROM
    (SELECT c_custkey AS person_id, CAST(c_acctbal < 0 AS INTEGER) AS voided, c_mktsegment AS gender FROM customer) c
    JOIN (SELECT p_partkey AS person_id, CAST(p_size > 40 AS INTEGER) AS voided, p_name AS name FROM part) p
    USING (person_id)""")
def _(v):
    parts = v.table("part").select(
        F.col("p_partkey").alias("person_id"), (F.col("p_size") > 40).cast("int").alias("voided"),
        F.col("p_name").alias("name"),
    )
    return op.suffix_join(v.person().select("person_id", "voided", "gender"), parts, "person_id")


# ---- filters


@query("filter_equal", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(v):
    return v.table("orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@query("filter_and", """SELECT l_orderkey, l_linenumber FROM lineitem
    WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 10""")
def _(v):
    keep = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 10)
    return v.table("lineitem").filter(keep).select("l_orderkey", "l_linenumber")


@query("filter_or", "SELECT event_id, event_type, value FROM events WHERE event_type = 'error' OR value > 100")
def _(v):
    keep = (F.col("event_type") == "error") | (F.col("value") > 100)
    return v.table("events").filter(keep).select("event_id", "event_type", "value")


@query("filter_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'click')")
def _(v):
    return v.table("events").filter(F.col("event_type").isin("error", "click")).select("event_id", "event_type")


@query("filter_not_in", """SELECT l_orderkey, l_linenumber, code FROM
    (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS code FROM lineitem)
    WHERE code NOT IN (1, 2, 17, 18, 20, 21)""")
def _(v):
    coded = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("code")
    )
    return coded.filter(fn.none_of("code", [1, 2, 17, 18, 20, 21]))


@query("filter_any_present", ctes("lab_obs") + """SELECT obs_id, value_numeric, value_text FROM lab_obs
    WHERE value_numeric IS NOT NULL OR value_text IS NOT NULL""")
def _(v):
    return v.lab_obs().filter(fn.any_present("value_numeric", "value_text")).select(
        "obs_id", "value_numeric", "value_text"
    )


@query("filter_range", "SELECT event_id, value FROM events WHERE value BETWEEN 12 AND 18")
def _(v):
    return v.table("events").filter(F.col("value").between(12, 18)).select("event_id", "value")


@query("filter_threshold", "SELECT event_id, value FROM events WHERE value <= 11")
def _(v):
    return v.table("events").filter(F.col("value") <= 11).select("event_id", "value")


@query("filter_calendar_parts", """SELECT o_orderkey, o_orderdate FROM orders
    WHERE year(o_orderdate) >= 1998 AND month(o_orderdate) >= 3""")
def _(v):
    return v.table("orders").filter(fn.calendar_parts("o_orderdate", 1998, 3)).select("o_orderkey", "o_orderdate")


@query("filter_since", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'")
def _(v):
    keep = fn.since("o_orderdate", datetime.date(1998, 3, 1))
    return v.table("orders").filter(keep).select("o_orderkey", "o_orderdate")


@query("having_min_count", "SELECT p_name, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 32")
def _(v):
    return op.having(op.count_by(v.table("part"), "p_name"), F.col("count") >= 32)


@query("drop_incomplete", ctes("lab_obs") + """SELECT obs_id, value_numeric, value_text FROM lab_obs
    WHERE value_numeric IS NOT NULL AND value_text IS NOT NULL""")
def _(v):
    return op.drop_incomplete(v.lab_obs().select("obs_id", "value_numeric", "value_text"))


@query("filter_tuple_set", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, o_orderpriority FROM orders
    GROUP BY 1, 2 HAVING count(*) < (SELECT count(*) FROM orders) / 15)""")
def _(v):
    orders = v.table("orders")
    counts = op.count_by(orders, "o_orderstatus", "o_orderpriority", name="n")
    rare = counts.filter(F.col("n") < orders.agg(F.count(F.lit(1))).scalar() / 15)  # there are 15 combinations
    return op.include_tuples(orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), rare.drop("n"))


@query("filter_level_members", """SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
    WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
    AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9950)""")
def _(v):
    customers = v.table("customer")
    nations = v.table("supplier").filter(F.col("s_acctbal") > 9000).select(F.col("s_nationkey").alias("c_nationkey"))
    segments = customers.filter(F.col("c_acctbal") > 9950)
    return op.include_levels(
        customers.select("c_custkey", "c_nationkey", "c_mktsegment"),
        {"c_nationkey": nations, "c_mktsegment": segments},
    )


# ---- joins


@query("join_inner_same_key", ctes("person") + """SELECT person_id, gender, city FROM person JOIN
    (SELECT p_partkey AS person_id, p_name AS city FROM part) USING (person_id)""")
def _(v):
    places = v.table("part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("city"))
    return v.person().select("person_id", "gender").join(places, "person_id")


@query("join_inner_diff_key", """SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part
    ON l_partkey = p_partkey WHERE p_type = 'ECONOMY'""")
def _(v):
    parts = v.table("part").filter(F.col("p_type") == "ECONOMY").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return op.skew_join(items, parts, "l_partkey").drop("l_partkey")


@query("join_composite_key", """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, items FROM lineitem JOIN
    (SELECT l_returnflag, l_linestatus, count(*) AS items FROM lineitem GROUP BY 1, 2)
    USING (l_returnflag, l_linestatus)""")
def _(v):
    items = v.table("lineitem")
    groups = op.count_by(items, "l_returnflag", "l_linestatus", name="items")
    return op.restrict_to(
        items.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), groups,
        ["l_returnflag", "l_linestatus"],
    )


@query("join_left_outer", ctes("names") + """SELECT l_orderkey, l_linenumber, name FROM lineitem
    LEFT JOIN names ON concept_id = l_partkey""")
def _(v):
    names = v.concept_name().filter(F.col("concept_name_type") == "FULLY_SPECIFIED").select(
        F.col("concept_id").alias("l_partkey"), "name"
    )
    items = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return op.skew_join(items, names, "l_partkey", "left").drop("l_partkey")


@query("join_parent_child", """SELECT l_orderkey AS obs_group_id, l_linenumber AS line, l_partkey AS value_coded,
    o_custkey AS person_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def _(v):
    parents = v.group_rows().filter(F.col("concept_id").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).drop("concept_id")
    children = v.coded_obs().select("obs_group_id", "line", "value_coded")
    return op.group_parent_join(children, parents)


@query("join_semi_membership", """SELECT event_id, user_id, value FROM events WHERE event_type = 'click'
    AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)""")
def _(v):
    events = v.table("events")
    positive = events.filter((F.col("event_type") == "error") & (F.col("value") > 200))
    clicks = events.filter(F.col("event_type") == "click").select("event_id", "user_id", "value")
    return op.semi_join(clicks, positive, "user_id")


@query("restrict_to_top", """SELECT c_custkey, c_nationkey, customers FROM customer JOIN (SELECT * FROM
    (SELECT c_nationkey, count(*) AS customers, rank() OVER (ORDER BY count(*) DESC) AS r FROM customer GROUP BY 1)
    WHERE r <= 5) USING (c_nationkey)""")
def _(v):
    customers = v.table("customer").select("c_custkey", "c_nationkey")
    top = op.top_n(op.count_by(customers, "c_nationkey", name="customers"), 5, "customers")
    return op.restrict_to(customers, top, "c_nationkey")


@query("pair_measures", """SELECT a.event_id, user_id, a.value, pairs, partner_min, partner_max,
    round(partner_mean, 6) AS partner_mean FROM events a JOIN (
      SELECT user_id, count(*) AS pairs, min(value) AS partner_min, max(value) AS partner_max, avg(value) AS partner_mean
      FROM events WHERE event_type = 'error' AND value <= 11 GROUP BY 1) b USING (user_id)
    WHERE event_type = 'purchase'""")
def _(v):
    events = v.table("events")
    low = events.filter((F.col("event_type") == "error") & (F.col("value") <= 11))
    purchases = events.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "value")
    paired = op.pair_measures(purchases, low, on="user_id", value="value")
    return paired.withColumn("partner_mean", F.round("partner_mean", 6))


@query("fact_snowflake", """SELECT r_name, n_name, p_type, count(*) AS items, round(sum(l_quantity), 2) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""")
def _(v):
    owners = v.group_rows().select(F.col("obs_id").alias("obs_group_id"), "person_id")
    homes = v.home().select("person_id", "state_province", "city_village")
    items = v.coded_obs().select("obs_group_id", "line", "value_coded", "value_numeric")
    owned = op.skew_join(items, owners, "obs_group_id")
    # Summed per (person, code) before the dimension joins: a frequent person or code is a few rows by then.
    cells = owned.groupBy("person_id", "value_coded").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_numeric").alias("q")
    )
    named = cells.join(homes, "person_id").join(v.concept().withColumnRenamed("concept_id", "value_coded"), "value_coded")
    return named.groupBy(
        F.col("state_province").alias("r_name"), F.col("city_village").alias("n_name"), F.col("class_id").alias("p_type")
    ).agg(F.sum("n").alias("items"), F.round(F.sum("q"), 2).alias("quantity"))


@query("cohort_join", """SELECT event_id, user_id, event_type, value, cohort_rows FROM events JOIN
    (SELECT o_custkey AS user_id, count(*) AS cohort_rows FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    USING (user_id)""")
def _(v):
    cohort = v.table("orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("user_id"))
    events = v.table("events").select("event_id", "user_id", "event_type", "value")
    return op.cohort_join(events, cohort, "user_id")


# ---- aggregates


@query("count_by_one", "SELECT p_name, count(*) AS count FROM part GROUP BY 1")
def _(v):
    return op.count_by(v.table("part"), "p_name")


@query("count_by_two", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def _(v):
    return op.count_by(v.table("lineitem"), "l_returnflag", "l_linestatus")


@query("count_by_three", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2, 3")
def _(v):
    return op.count_by(v.table("lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("agg_mean_count_sum", """SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity, l_discount, l_tax,
    round(avg(l_extendedprice), 7) AS mean_price, count(*) AS items, round(sum(l_extendedprice), 2) AS total_price
    FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6""")
def _(v):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    return v.table("lineitem").groupBy(*keys).agg(
        F.round(F.avg("l_extendedprice"), 7).alias("mean_price"), F.count(F.lit(1)).alias("items"),
        F.round(F.sum("l_extendedprice"), 2).alias("total_price"),
    )


@query("distinct_values", "SELECT DISTINCT p_name FROM part")
def _(v):
    return op.distinct_values(v.table("part"), "p_name")


@query("quantiles_101", """SELECT p / 100e0 AS prob, round(quantile, 6) AS quantile FROM (SELECT
    unnest(range(101)) AS p, unnest((SELECT quantile_cont(value, list_transform(range(101), lambda i: i / 100e0))
    FROM events)) AS quantile)""")
def _(v):
    out = op.quantiles(v.table("events"), "value", [p / 100 for p in range(101)])
    return out.select("prob", _r("quantile"))


@query("quantiles_by_group", """SELECT event_type, 25e-2 AS prob, round(quantile_cont(value, 25e-2), 6) AS quantile
    FROM events GROUP BY 1
    UNION ALL SELECT event_type, 9e-1, round(quantile_cont(value, 9e-1), 6) FROM events GROUP BY 1""")
def _(v):
    return op.quantiles(v.table("events"), "value", [0.25, 0.9], by=["event_type"]).select(
        "event_type", "prob", _r("quantile")
    )


@query("bounding_box", ctes("home") + """SELECT round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon,
    round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat FROM home""")
def _(v):
    box = op.bounding_box(v.home())
    return box.select(*[_r(c) for c in box.columns])


@query("sum_records", "SELECT c_nationkey, c_mktsegment, count(*) AS records FROM customer GROUP BY 1, 2")
def _(v):
    return op.sum_records(op.add_record_count(v.table("customer")), ["c_nationkey", "c_mktsegment"],
                          weight="number_of_records")


@query("column_summary", ctes("person", "home") + """SELECT sum(person_id) AS sum_person_id,
    count(DISTINCT gender) AS count_distinct_gender, count(DISTINCT year(birthdate)) AS years_birthdate,
    sum(voided) AS sum_voided, count(DISTINCT year(date_created)) AS years_date_created,
    count(city_village) AS count_city_village, count(state_province) AS count_state_province,
    round(avg(lon), 6) AS avg_lon, round(avg(lat), 6) AS avg_lat
    FROM person JOIN home USING (person_id)""")
def _(v):
    joined = v.person().join(v.home(), "person_id")
    out = op.column_summary(joined, {"gender": "count_distinct", "lon": "avg", "lat": "avg"})
    return out.withColumns({"avg_lon": F.round("avg_lon", 6), "avg_lat": F.round("avg_lat", 6)})


@query("column_summary_distinct", """SELECT count(DISTINCT l_shipdate) AS count_distinct_l_shipdate,
    count(DISTINCT l_partkey) AS count_distinct_l_partkey, count(DISTINCT l_returnflag) AS count_distinct_l_returnflag,
    count(l_linestatus) AS count_l_linestatus, max(l_linenumber) AS max_l_linenumber FROM lineitem""")
def _(v):
    lines = v.table("lineitem").select("l_shipdate", "l_partkey", "l_returnflag", "l_linestatus", "l_linenumber")
    distinct = dict.fromkeys(("l_shipdate", "l_partkey", "l_returnflag"), "count_distinct")
    return op.column_summary(lines, {**distinct, "l_linenumber": "max"})


@query("attr_single_value", """SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag)
    THEN min(l_returnflag) ELSE '*' END AS flag FROM lineitem GROUP BY 1""")
def _(v):
    return v.table("lineitem").groupBy("l_orderkey").agg(fn.attr("l_returnflag").alias("flag"))


@query("drill_rollup", ctes("home") + """SELECT state_province, city_village, gender, count(*) AS count,
    CAST(grouping(state_province, city_village, gender) AS INTEGER) AS level_id FROM home JOIN
    (SELECT c_custkey AS person_id, c_mktsegment AS gender FROM customer) USING (person_id)
    GROUP BY ROLLUP (state_province, city_village, gender)""")
def _(v):
    rows = v.home().join(v.person().select("person_id", "gender"), "person_id")
    return op.drill_counts(rows, ["state_province", "city_village", "gender"])


# ---- ranks and shares


@query("rank_dense_global", """SELECT l_partkey, count(*) AS count,
    CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank FROM lineitem GROUP BY 1""")
def _(v):
    return op.add_rank(op.count_by(v.table("lineitem"), "l_partkey"), "count")


@query("rank_dense_nan", """SELECT event_id, v, CASE WHEN v IS NOT NULL THEN
    CAST(dense_rank() OVER (ORDER BY v DESC NULLS LAST) AS INTEGER) END AS inv_rank FROM
    (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 11 = 0 THEN NULL
    ELSE value END AS v FROM events)""")
def _(v):
    odd = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(None))
    return op.add_rank(v.table("events").select("event_id", odd.otherwise(F.col("value")).alias("v")), "v")


@query("rank_dense_dates", """SELECT o_orderkey, o_orderdate,
    CAST(dense_rank() OVER (ORDER BY o_orderdate DESC) AS INTEGER) AS inv_rank FROM orders""")
def _(v):
    return op.add_rank(v.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("rank_dense_within", """SELECT l_returnflag, l_partkey, count(*) AS count, CAST(dense_rank() OVER
    (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS INTEGER) AS rank FROM lineitem GROUP BY 1, 2""")
def _(v):
    counts = op.count_by(v.table("lineitem"), "l_returnflag", "l_partkey")
    return op.add_rank(counts, "count", within=["l_returnflag"], name="rank")


@query("topn_global", """SELECT p_name, diag_count, inv_rank FROM (SELECT p_name, count(*) AS diag_count,
    CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank,
    rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE r <= 10""")
def topn_global(v):
    # One row per part before the names come in: no join sees a frequent part more than once.
    per_part = op.count_by(v.table("lineitem"), "l_partkey", name="n")
    names = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    counts = op.count_by(per_part.join(names, "l_partkey"), "p_name", weight="n", name="diag_count")
    return op.top_n(counts, 10, "diag_count", rank="inv_rank")


@query("topn_within", """SELECT l_returnflag, l_suppkey, items, rank FROM (SELECT l_returnflag, l_suppkey,
    count(*) AS items, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS INTEGER) AS rank,
    rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 5""")
def _(v):
    counts = op.count_by(v.table("lineitem"), "l_returnflag", "l_suppkey", name="items")
    return op.top_n(counts, 5, "items", within=["l_returnflag"], rank="rank")


@query("share_of_group", """SELECT p_name, l_returnflag, part_items, round(part_items / items * 100, 2) AS percentage FROM
    (SELECT p_name, l_returnflag, count(*) AS part_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    JOIN (SELECT p_name, count(*) AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (p_name)""")
def _(v):
    per_part = op.count_by(v.table("lineitem"), "l_partkey", "l_returnflag", name="n")
    names = v.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    parts = op.count_by(per_part.join(names, "l_partkey"), "p_name", "l_returnflag", weight="n", name="part_items")
    totals = parts.groupBy("p_name").agg(F.sum("part_items").alias("items"))
    return op.share_of_parent(parts, totals, ["p_name"], "part_items", "items").drop("items")


@query("share_of_total", """SELECT l_returnflag, l_linestatus, count(*) AS n,
    round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1, 2""")
def _(v):
    return op.share_of_total(v.table("lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("share", F.round("share", 6))


@query("share_within", """SELECT l_suppkey, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_suppkey), 6) AS share
    FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def _(v):
    return op.share_within(v.table("lineitem"), "l_suppkey", "l_returnflag").withColumn("share", F.round("share", 6))


@query("first_per_key", """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def _(v):
    orders = v.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return op.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


# ---- orderings and unions


@query("sort_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def _(v):
    return op.sort_desc(v.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("sort_rank_then_key", """SELECT p_name, count(*) AS count,
    CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank FROM part GROUP BY 1""")
def _(v):
    ranked = op.add_rank(op.count_by(v.table("part"), "p_name"), "count")
    return ranked.orderBy(F.asc_nulls_last("inv_rank"), F.asc_nulls_last("p_name"))


@query("category_order", """SELECT p_name, round(mean_measure, 6) AS mean_measure,
    CAST(row_number() OVER (ORDER BY mean_measure DESC, p_name) AS INTEGER) AS category_order FROM
    (SELECT p_name, avg(p_size) AS mean_measure FROM part GROUP BY 1)""")
def _(v):
    out = op.category_order(v.table("part"), "p_name", "p_size")
    return out.withColumn("mean_measure", F.round("mean_measure", 6))


@query("union_lookups", """SELECT key, name FROM (SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL
    SELECT r_regionkey, r_name FROM region UNION ALL SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)""")
def _(v):
    return op.union_all([
        v.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")),
        v.table("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")),
        v.table("customer").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name")).distinct(),
    ])


# ---- scalar functions


@query("cap_words", f"SELECT p_partkey, {cap_sql('p_name')} AS name, {cap_sql('lower(p_brand || chr(32) || p_type)')} AS kind FROM part")
def _(v):
    return v.table("part").select(
        "p_partkey", fn.cap_words("p_name").alias("name"),
        fn.cap_words(F.lower(F.concat_ws(" ", "p_brand", "p_type"))).alias("kind"),
    )


@query("correct_values", """SELECT p_partkey, CASE p_name WHEN 'hot gizmo' THEN 'hot gear' WHEN 'old rod' THEN 'old ring'
    WHEN 'red plate' THEN 'red widget' ELSE p_name END AS name FROM part""")
def _(v):
    mapping = {"hot gizmo": "hot gear", "old rod": "old ring", "red plate": "red widget"}
    return v.table("part").select("p_partkey", fn.correct_values("p_name", mapping).alias("name"))


@query("rescale_outliers", """SELECT event_id, round(CASE WHEN value BETWEEN 100 AND 999.99 THEN value / 100
    WHEN value BETWEEN 1000 AND 9999.99 THEN value / 1000 ELSE value END, 8) AS value FROM
    (SELECT event_id, CASE WHEN event_type = 'error' THEN value * 20 ELSE value END AS value FROM events)""")
def _(v):
    stretched = v.table("events").select(
        "event_id", F.when(F.col("event_type") == "error", F.col("value") * 20).otherwise(F.col("value")).alias("value")
    )
    return stretched.withColumn("value", F.round(fn.rescale_outliers("value"), 8))


@query("build_address", "SELECT p_partkey, p_name || '   Hills   Land' AS address FROM part")
def _(v):
    return v.table("part").select("p_partkey", fn.joined_address("p_name", PLACE_PARTS).alias("address"))


@query("date_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS order_year,
    CAST(month(o_orderdate) AS INTEGER) AS order_month FROM orders""")
def _(v):
    return v.table("orders").withColumns(fn.date_parts("o_orderdate", "order")).select(
        "o_orderkey", "order_year", "order_month"
    )


@query("parse_dates", """SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 HOUR END AS moment FROM orders""")
def _(v):
    text = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    raw = v.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit("not a date")).otherwise(text).alias("text")
    )
    return raw.select(
        "o_orderkey", fn.parse_date("text").alias("day"),
        fn.parse_datetime(F.concat("text", F.lit(" 03:00:00"))).alias("moment"),
    )


@query("age_years", ctes("person") + f"SELECT person_id, birthdate, {AGE} AS age FROM person")
def _(v):
    return v.person().select("person_id", "birthdate", fn.age_years("birthdate", AS_OF).alias("age"))


@query("cast_numeric", """SELECT part_id, number FROM (SELECT p_partkey AS part_id,
    CASE WHEN p_type <> 'PROMO' THEN p_retailprice END AS number FROM part)""")
def _(v):
    text = F.when(F.col("p_type") != "PROMO", F.col("p_retailprice").cast("string")).otherwise(F.lit("n/a"))
    return v.table("part").select(F.col("p_partkey").alias("part_id"), fn.cast_numeric(text).alias("number"))


@query("level_codes", """SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) AS INTEGER) AS level_code
    FROM part""")
def _(v):
    return op.level_codes(v.table("part").select("p_partkey", "p_name"), "p_name")


@query("label_format", """SELECT l_suppkey, format('{:,}', count(*)) AS items, printf('%.1f%%',
    round(100e0 * count(*) FILTER (l_returnflag = 'R') / count(*), 1)) AS returned FROM lineitem GROUP BY 1""")
def _(v):
    counts = v.table("lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r")
    )
    share = F.round(100.0 * F.col("r") / F.col("n"), 1) / 100
    return counts.select("l_suppkey", fn.comma_label("n").alias("items"), fn.pct_label(share).alias("returned"))

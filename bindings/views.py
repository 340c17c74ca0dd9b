"""The star tables seen as a medical record: persons, addresses, observations and concepts.

``Views`` builds the Spark side and ``ctes`` gives the same definitions as SQL.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import cap_words
from cohortlens.operators import skew_join, union_all
from cohortlens.plans import StudyCodes, StudyTables
from cohortlens.sources import TableSource, literal_frame, read_table

AS_OF = datetime.date(2016, 12, 31)
CODES = StudyCodes(
    excluded_answers=(1, 2, 17, 18, 20, 21),
    group_questions=("1-URGENT", "2-HIGH", "3-MEDIUM"),
    diagnosis_class="ECONOMY",
    lab_class="lab",
)
LAB_CONCEPTS = [("click", "lab"), ("error", "lab"), ("purchase", "lab"), ("view", "lab"), ("signup", "visit")]
LAB_NAMES = [
    ("click", "Click", "FULLY_SPECIFIED", "en", 0),
    ("error", "Error", "FULLY_SPECIFIED", "en", 0),
    ("purchase", "Purchase", "FULLY_SPECIFIED", "en", 0),
    ("signup", "Signup", "FULLY_SPECIFIED", "en", 0),
    ("view", "Vue", "FULLY_SPECIFIED", "fr", 0),
]
PLACE_CORRECTIONS = {"Hot Gizmo": "Hot Gear", "Old Rod": "Old Ring", "Red Plate": "Red Widget"}
PLACE_PARTS = ("Hills", "Land")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.source = spark, TableSource(parquet_dir=sf_dir)
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read_table(self.spark, name, self.source)
        return self._tables[name]

    def person(self) -> DataFrame:
        def day(start: str, step: int, span: int):
            return F.date_add(F.lit(start).cast("date"), (F.col("c_custkey") * step % span).cast("int"))

        return self.table("customer").select(
            F.col("c_custkey").alias("person_id"),
            F.col("c_mktsegment").alias("gender"),
            day("1940-01-01", 997, 25000).alias("birthdate"),
            (F.col("c_acctbal") < 0).cast("int").alias("voided"),
            day("2014-01-01", 31, 1800).cast("timestamp_ntz").alias("date_created"),
        )

    def patient(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("patient_id"), (F.col("c_acctbal") >= 9500).cast("int").alias("voided")
        )

    def home(self) -> DataFrame:
        """One address per customer."""
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        ).select(
            F.col("n_nationkey").alias("c_nationkey"),
            F.col("n_name").alias("city_village"),
            F.col("r_name").alias("state_province"),
            (F.col("n_nationkey") * F.lit(0.02) + 81.0).alias("lon"),
            (F.col("n_nationkey") * 7 % 25 * F.lit(0.02) + 28.8).alias("lat"),
        )
        customers = self.table("customer").select(F.col("c_custkey").alias("person_id"), "c_nationkey")
        return customers.join(nation, "c_nationkey").drop("c_nationkey")

    def address(self) -> DataFrame:
        """The home addresses with the village name only."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city_village"))
        customers = self.table("customer").select(F.col("c_custkey").alias("person_id"), "c_nationkey")
        return customers.join(nation, "c_nationkey").drop("c_nationkey")

    def enrolment(self) -> DataFrame:
        """One address row per order: the customer's nation, on the day of the order."""
        orders = self.table("orders").select(
            F.col("o_custkey").alias("person_id"), F.col("o_orderdate").alias("date_created")
        )
        return skew_join(orders, self.address(), "person_id")

    def group_rows(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("obs_id"),
            F.col("o_custkey").alias("person_id"),
            F.col("o_orderpriority").alias("concept_id"),
        )

    def coded_obs(self) -> DataFrame:
        """Line items as observations; the person is known only through the order."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("obs_group_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("value_coded"),
            F.col("l_quantity").alias("value_numeric"),
            F.col("l_returnflag").alias("value_text"),
            F.col("l_shipdate").alias("obs_datetime"),
            (F.col("l_linestatus") == "O").cast("int").alias("voided"),
        )

    def concept(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("class_id"))

    def concept_name(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("concept_id"),
            F.col("p_name").alias("name"),
            F.when(F.col("p_type") != "PROMO", "FULLY_SPECIFIED").otherwise("SHORT").alias("concept_name_type"),
            F.lit("en").alias("locale"),
            F.lit(0).alias("voided"),
        )

    def lab_obs(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("obs_id"),
            F.col("user_id").alias("person_id"),
            F.col("event_type").alias("concept_id"),
            F.when(F.col("value") >= 5, F.col("value")).alias("value_numeric"),
            F.when((F.col("event_type") == "error") & (F.col("value") > 200), "Positive")
            .when(F.col("event_type") == "error", "Negative").alias("value_text"),
            F.col("props").alias("comments"),
            F.col("ts").alias("obs_datetime"),
            (F.col("value") >= 350).cast("int").alias("voided"),
        )

    def place_address(self) -> DataFrame:
        """One address per customer, in the place named by the part with the customer's key."""
        parts = self.table("part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("city_village"))
        return self.table("customer").select(F.col("c_custkey").alias("person_id")).join(parts, "person_id").select(
            "person_id",
            F.lit(None).cast("string").alias("postal_code"),
            "city_village",
            F.lit("NP").alias("country"),
            F.lit(0).alias("voided"),
        )

    def gazetteer(self) -> DataFrame:
        """Two lookups stacked: every place but those named anvil, and a second country for the rods."""
        names = self.table("part").select(cap_words("p_name").alias("name")).distinct()
        letter, size = F.ascii("name"), F.length("name")
        first = names.filter(~F.col("name").endswith("Anvil")).select(
            "name",
            F.lit("NP").alias("country"),
            (size * 7 % 23 / F.lit(50.0) + 81.0).alias("lon"),
            (letter % 10 / F.lit(20.0) + 28.8).alias("lat"),
        )
        second = names.filter(F.col("name").endswith("Rod")).select(
            "name", F.lit("IN").alias("country"), F.lit(70.0).alias("lon"), F.lit(20.0).alias("lat")
        )
        return union_all([first, second])

    # ---- the tables each kind of study reads

    def diagnosis_by_group(self) -> StudyTables:
        return StudyTables(
            person=self.person(), person_address=self.address(), obs=self.coded_obs(), obs_group=self.group_rows(),
            concept=self.concept(), concept_name=self.concept_name(),
        )

    def diagnosis_by_class(self) -> StudyTables:
        owners = self.group_rows().select(F.col("obs_id").alias("obs_group_id"), "person_id")
        owned = skew_join(self.coded_obs(), owners, "obs_group_id")
        return StudyTables(
            person=self.person(), person_address=self.address(), obs=owned, concept=self.concept(),
            concept_name=self.concept_name(),
        )

    def enrolments(self) -> StudyTables:
        return StudyTables(person=self.person(), person_address=self.enrolment(), patient=self.patient())

    def labs(self) -> StudyTables:
        return StudyTables(
            person=self.person(), person_address=self.address(), obs=self.lab_obs(),
            concept=literal_frame(self.spark, LAB_CONCEPTS, "concept_id string, class_id string"),
            concept_name=literal_frame(
                self.spark, LAB_NAMES,
                "concept_id string, name string, concept_name_type string, locale string, voided int",
            ),
        )

    def places(self) -> StudyTables:
        return StudyTables(person=self.person(), person_address=self.place_address())


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _cap(c: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


AGE = (
    "round(date_sub('year', birthdate, DATE '2016-12-31') + date_diff('day', birthdate + to_years("
    "CAST(date_sub('year', birthdate, DATE '2016-12-31') AS INTEGER)), DATE '2016-12-31') / "
    "CAST(date_diff('day', birthdate + to_years(CAST(date_sub('year', birthdate, DATE '2016-12-31') AS INTEGER)), "
    "birthdate + to_years(CAST(date_sub('year', birthdate, DATE '2016-12-31') AS INTEGER) + 1)) AS DOUBLE), 1)"
)

# name -> (definitions it reads, SQL)
_DEFINITIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "person": ((), """SELECT c_custkey AS person_id, c_mktsegment AS gender,
        DATE '1940-01-01' + CAST(c_custkey * 997 % 25000 AS INTEGER) AS birthdate,
        CAST(c_acctbal < 0 AS INTEGER) AS voided,
        CAST(DATE '2014-01-01' + CAST(c_custkey * 31 % 1800 AS INTEGER) AS TIMESTAMP) AS date_created FROM customer"""),
    "patient": ((), "SELECT c_custkey AS patient_id, CAST(c_acctbal >= 9500 AS INTEGER) AS voided FROM customer"),
    "home": ((), """SELECT c_custkey AS person_id, n_name AS city_village, r_name AS state_province,
        n_nationkey * 2e-2 + 81e0 AS lon, n_nationkey * 7 % 25 * 2e-2 + 288e-1 AS lat
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "enrolment": (("home",), """SELECT person_id, city_village, o_orderdate AS date_created
        FROM orders JOIN home ON o_custkey = person_id"""),
    "coded_obs": ((), """SELECT l_orderkey AS obs_group_id, l_linenumber AS line, l_partkey AS value_coded,
        l_quantity AS value_numeric, l_returnflag AS value_text, l_shipdate AS obs_datetime,
        CAST(l_linestatus = 'O' AS INTEGER) AS voided FROM lineitem"""),
    "names": ((), "SELECT p_partkey AS concept_id, p_name AS name FROM part WHERE p_type <> 'PROMO'"),
    "fact_group": (("person", "home", "coded_obs", "names"), f"""SELECT e.person_id, gender,
        e.value_coded AS diagnosis_id, name AS diagnosis, e.cnt AS count, city_village, birthdate, {AGE} AS age FROM (
          SELECT o_custkey AS person_id, value_coded, count(*) AS cnt FROM coded_obs
          JOIN orders ON obs_group_id = o_orderkey
          WHERE value_coded NOT IN (1, 2, 17, 18, 20, 21) AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
          GROUP BY 1, 2) e
        JOIN person p ON p.person_id = e.person_id AND p.voided = 0
        JOIN home h ON h.person_id = e.person_id
        LEFT JOIN names n ON n.concept_id = e.value_coded"""),
    "fact_class": (("person", "home", "coded_obs", "names"), f"""SELECT e.person_id, gender,
        e.value_coded AS diagnosis_id, name AS diagnosis, e.cnt AS count, city_village, birthdate, {AGE} AS age FROM (
          SELECT o_custkey AS person_id, value_coded, count(*) AS cnt FROM coded_obs
          JOIN orders ON obs_group_id = o_orderkey JOIN part ON p_partkey = value_coded
          WHERE p_type = 'ECONOMY' GROUP BY 1, 2) e
        JOIN person p ON p.person_id = e.person_id AND p.voided = 0
        JOIN home h ON h.person_id = e.person_id
        LEFT JOIN names n ON n.concept_id = e.value_coded"""),
    "top10": (("fact_group",), """SELECT * FROM (SELECT diagnosis, count(*) AS diag_count,
        CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank,
        rank() OVER (ORDER BY count(*) DESC) AS r FROM fact_group GROUP BY 1) WHERE r <= 10"""),
    "regions": (("fact_group", "top10"), """SELECT * FROM (SELECT diagnosis, city_village, count(*) AS diag_region_count,
        CAST(dense_rank() OVER (PARTITION BY diagnosis ORDER BY count(*) DESC) AS INTEGER) AS reg_rank,
        rank() OVER (PARTITION BY diagnosis ORDER BY count(*) DESC) AS r
        FROM fact_group JOIN top10 USING (diagnosis) GROUP BY 1, 2) WHERE r <= 5"""),
    "regions_sex": (("fact_group", "regions"), """SELECT diagnosis, gender, city_village,
        count(*) AS diag_sex_region_count,
        CAST(dense_rank() OVER (PARTITION BY diagnosis, gender ORDER BY count(*) DESC) AS INTEGER) AS reg_rank
        FROM fact_group JOIN regions USING (diagnosis, city_village) GROUP BY 1, 2, 3"""),
    "ages": (("fact_group", "regions"), """SELECT f.* FROM fact_group f JOIN regions r USING (diagnosis, city_village)
        WHERE diagnosis = 'red widget'"""),
    "lab_obs": ((), """SELECT event_id AS obs_id, user_id AS person_id, event_type AS concept_id,
        CASE WHEN value >= 5 THEN value END AS value_numeric,
        CASE WHEN event_type = 'error' AND value > 200 THEN 'Positive' WHEN event_type = 'error' THEN 'Negative' END
        AS value_text, props AS comments, ts AS obs_datetime, CAST(value >= 350 AS INTEGER) AS voided FROM events"""),
    "lab_rows": (("lab_obs",), f"""SELECT o.*, n.name AS lab_test FROM lab_obs o
        JOIN (VALUES {_values(LAB_CONCEPTS)}) c(concept_id, class_id) ON c.concept_id = o.concept_id AND class_id = 'lab'
        LEFT JOIN (VALUES {_values(LAB_NAMES)}) n(concept_id, name, kind, locale, gone)
        ON n.concept_id = o.concept_id AND kind = 'FULLY_SPECIFIED' AND locale = 'en' AND gone = 0
        WHERE voided = 0 AND (value_numeric IS NOT NULL OR value_text IS NOT NULL)"""),
    "cohort_labs": (("fact_group", "lab_rows"), """SELECT obs_id, person_id, gender, age, concept_id, lab_test,
        value_numeric, value_text, comments, obs_datetime, cohort_rows FROM lab_rows
        JOIN (SELECT person_id, gender, age, count(*) AS cohort_rows FROM fact_group
              WHERE diagnosis = 'red widget' GROUP BY 1, 2, 3) USING (person_id)"""),
    "measures": (("person", "lab_rows"), f"""SELECT person_id, {AGE} AS age, gender, birthdate, lab_test, value_numeric,
        avg(value_numeric) AS measure_value, count(*) AS count, sum(value_numeric) AS value_sum
        FROM lab_rows JOIN (SELECT person_id, gender, birthdate FROM person WHERE voided = 0) USING (person_id)
        WHERE lab_test IN ('Click', 'Purchase') GROUP BY ALL"""),
    "enrolled": (("enrolment", "patient"), f"""SELECT e.person_id, {_cap('city_village')} AS city_village FROM enrolment e
        JOIN patient p ON p.patient_id = e.person_id AND p.voided = 0
        WHERE year(date_created) >= 1998 AND month(date_created) >= 3"""),
    "top_villages": (("enrolled",), """SELECT * FROM (SELECT city_village, count(*) AS patient_count,
        CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank,
        rank() OVER (ORDER BY count(*) DESC) AS r FROM enrolled GROUP BY 1) WHERE r <= 10"""),
    "place_rows": (("person",), f"""SELECT person_id, gender, birthdate, date_created, {_cap('p_name')} AS raw_village,
        CASE {_cap('p_name')} WHEN 'Hot Gizmo' THEN 'Hot Gear' WHEN 'Old Rod' THEN 'Old Ring'
        WHEN 'Red Plate' THEN 'Red Widget' ELSE {_cap('p_name')} END AS city_village
        FROM person JOIN part ON p_partkey = person_id
        WHERE voided = 0 AND year(date_created) >= 2015 AND month(date_created) >= 3"""),
    "gazetteer": ((), f"""SELECT name, 'NP' AS country, length(name) * 7 % 23 / 50e0 + 81e0 AS lon,
        ascii(name) % 10 / 20e0 + 288e-1 AS lat
        FROM (SELECT DISTINCT {_cap('p_name')} AS name FROM part) WHERE name NOT LIKE '%Anvil'
        UNION ALL SELECT name, 'IN', 70e0, 20e0
        FROM (SELECT DISTINCT {_cap('p_name')} AS name FROM part) WHERE name LIKE '%Rod'"""),
    "village_geo": (("place_rows", "gazetteer"), """SELECT city_village, cnt AS count, inv_rank,
        city_village || '   Hills   Land' AS address, lon, lat FROM (
          SELECT city_village, count(*) AS cnt,
          CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS inv_rank FROM place_rows GROUP BY 1)
        JOIN gazetteer ON name = city_village AND country = 'NP' WHERE cnt >= 10"""),
    "points": (("place_rows", "village_geo"), """SELECT person_id, gender, birthdate, date_created, city_village,
        inv_rank, address, lon, lat FROM place_rows JOIN village_geo USING (city_village)"""),
}


def ctes(*names: str) -> str:
    """``WITH ...`` text that defines the named views and all they read."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _DEFINITIONS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_DEFINITIONS[n][1]})" for n in ordered) + "\n"


def cap_sql(c: str) -> str:
    """SQL of ``cap_words``."""
    return _cap(c)

"""The operators bound to the driver's tables: one thin query each, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import exact_dedup, packing, parity_join, quality_rules, repeated_phrases, sampled_pieces, secret_scan, token_alignment, token_counts, token_files, toxicity, treap_search, url_filters
from cohortlens.llm.spark_util import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(read(spark, sf_dir, "documents"))


@query("""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM digests WINDOW w AS (PARTITION BY text_sha256)
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    """The propagation run for 150 rounds: what is left is less than 0.85 to that power, a ten-thousand-millionth."""
    return rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed
), seeds AS (
  SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0 ELSE 0.0 END) AS trust,
    avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0 ELSE 0.0 END) AS distrust
  FROM ruled WHERE host <> '' GROUP BY host
), hrefs AS (
  SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''),
    '(?i)\shref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''>]+)', 1)) AS link FROM parsed
), pairs AS (
  SELECT src, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END,
    '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM hrefs
), under AS (
  SELECT a.host, b.host AS parent FROM seeds a JOIN seeds b ON regexp_extract(a.host, '^[^.]+\.([^.]+\..+)$', 1) = b.host
), links AS (
  SELECT src, dst, sum(n) AS n FROM (
    SELECT src, dst, 1.0 AS n FROM pairs WHERE src <> '' AND dst <> '' AND src <> dst
    UNION ALL SELECT host, parent, {url_filters.PARENT_WEIGHT} FROM under
    UNION ALL SELECT parent, host, {url_filters.PARENT_WEIGHT} FROM under) GROUP BY src, dst
), steps AS (
  SELECT 'trust' AS kind, src, dst, n FROM links UNION ALL SELECT 'distrust', dst, src, n FROM links
), hosts AS (
  SELECT host FROM seeds UNION SELECT src FROM links UNION SELECT dst FROM links
), base AS (
  SELECT k, host, coalesce(CASE WHEN k = 'trust' THEN trust ELSE distrust END, 0.0)::DOUBLE AS seed
  FROM hosts LEFT JOIN seeds USING (host) CROSS JOIN (VALUES ('trust'), ('distrust')) t(k)
), flows AS (
  SELECT kind, src, dst, (n / sum(n) OVER (PARTITION BY kind, src))::DOUBLE AS share FROM steps
), added AS (
  SELECT 0 AS round, k, host, seed AS score FROM base WHERE seed > 0
  UNION ALL
  SELECT round + 1, k, dst, sum({url_filters.PASS_ON} * score * share) FROM added JOIN flows ON kind = k AND src = host
  WHERE round < 150 GROUP BY round, k, dst
), scores AS (
  SELECT host, coalesce(sum(score) FILTER (k = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (k = 'distrust'), 0) AS distrust
  FROM added GROUP BY host
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN distrust > trust AND distrust >= {url_filters.BLOCK_FROM} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN scores USING (host)
"""


@query(_op10_sql())
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(read(spark, sf_dir, "pages")).drop("trust", "distrust")


@query(r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split
), sizes AS (
  SELECT doc_id, count(s) AS n FROM split LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM sizes UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM sizes JOIN reach ON node = doc_id GROUP BY doc_id, n
""")
def op7_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_documents(read(spark, sf_dir, "documents"))


@query(r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20
), later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM starts
  ) WHERE k > 1
), removed AS (SELECT DISTINCT doc_id, i + j AS i FROM later, range(0, 20) r(j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN removed USING (doc_id, i)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.remove_repeats(read(spark, sf_dir, "documents"))


@query()
def op2_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.sample_documents(read(spark, sf_dir, "documents"))


@query(r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t
  FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term
  FROM benchmark
), corpus AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM split WHERE len(t) > 0),
cells AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM split) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM cells, corpus GROUP BY term, n_docs
), lengths AS (SELECT doc_id, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM split, corpus WHERE len(t) > 0),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN cells USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
""")
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.search(treap_search.build_index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


@query()
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(read(spark, sf_dir, "documents"))

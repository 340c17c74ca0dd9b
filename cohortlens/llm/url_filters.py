"""URL verdicts from host and path rules, and from trust that spreads over links between hosts.

A rule names a host (its subdomains belong to it) and a beginning of the path; the longest rule that fits decides. Other
urls get their host's verdict: personalised PageRank starts from trusted hosts and follows links forwards, distrust
starts from blocked hosts and follows links backwards. A host is as much a seed as the share of its pages that rules
allow or block. Hosts pass trust along the links of their pages, and between a host and its parent domain. A host is
blocked where its distrust exceeds both its trust and ``BLOCK_FROM``.

Everything is DataFrame operations. Links are counted per pair of hosts before anything is joined; each round joins that
list with one small row per host and writes what it adds as a table, so a lost executor costs its tasks only. Rows of
a hub host are spread over ``SPREAD`` parts of each join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.spark_util import staged

#: Fixed values: (host and path, verdict) of the driver's rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of a host's score that it passes on in each round.
PASS_ON = 0.85
#: Rounds between two looks at what is still to come, and what may be left out where a verdict is a tie.
ROUNDS = 10
NEGLIGIBLE = 1e-9
#: Distrust from which a host may be blocked; a host with all its pages blocked has at least 1.
BLOCK_FROM = 0.5
#: Weight of the link between a host and its parent domain, in pages.
PARENT_WEIGHT = 1.0
SPREAD = 8


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    out = None
    for text, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{rest}")
        out = F.when(fits, F.lit(text)) if out is None else out.when(fits, F.lit(text))
    return out if out is not None else F.lit(None).cast("string")


def rule_verdict(rule_: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(rule_ == text, F.lit(verdict)).otherwise(out)
    return out


def judged_by_rules(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    parsed = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    ruled = parsed.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    return ruled.withColumn("verdict", rule_verdict(F.col("rule"), rules))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts with their number: ``src, dst, n``."""
    targets = F.regexp_extract_all(
        F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""), F.lit(1)
    )
    links = pages.select(host(F.col(url)).alias("src"), F.explode(targets).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = links.select("src", host(absolute).alias("dst"))
    return pairs.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def parent_links(hosts: DataFrame) -> DataFrame:
    """Links both ways between a host and the domain it lies under, for domains of at least two labels."""
    under = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("parent")).where("parent <> ''")
    known = under.join(hosts.select(F.col("host").alias("parent")), "parent")
    up = known.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
    down = known.select(F.col("parent").alias("src"), F.col("host").alias("dst"))
    return up.unionByName(down).withColumn("n", F.lit(PARENT_WEIGHT))


def seeds(ruled: DataFrame) -> DataFrame:
    """Per host of the table: its share of pages that rules allow (``trust``) and block (``distrust``)."""
    share = lambda verdict: F.avg(F.when(F.col("verdict") == verdict, 1.0).otherwise(0.0))
    return ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))


def propagate(seed: DataFrame, links: DataFrame, pass_on: float = PASS_ON, block_from: float = BLOCK_FROM) -> DataFrame:
    """Scores that settle all verdicts: ``host, trust, distrust``.

    A score is the host's seed and ``pass_on`` times what arrives (personalised PageRank, in units of a seed). ``links``
    (``src, dst, n``) name any hosts; those without pages have no seed. What a host without a link on has stays with it.

    Each round passes on what the round before has added, so scores only grow. All later rounds together add at most
    ``pass_on / (1 - pass_on)`` times the last round's sum to any host. Rounds go on until that cannot change whether a
    host's distrust reaches ``block_from`` and exceeds its trust, or is below ``NEGLIGIBLE``.
    """
    found = links.select(F.col("src").alias("host")).unionByName(links.select(F.col("dst").alias("host"))).distinct()
    start = staged(
        found.join(seed, "host", "full").select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    )
    # trust goes from src to dst, distrust from dst to src
    steps = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out_weight = steps.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    flows = staged(_spread_join(steps, out_weight).withColumn("share", F.col("n") / F.col("total")).drop("n", "total"))
    added = staged(_by_kind(start))
    scores = added
    while True:
        news = []
        for _ in range(ROUNDS):
            moved = _spread_join(flows, added.select("kind", F.col("host").alias("src"), "score").where("score > 0"))
            arrived = moved.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("arrived"))
            added = staged(arrived.select("kind", "host", F.round(pass_on * F.col("arrived"), 15).alias("score")))
            news.append(added)
        every = reduce(DataFrame.unionByName, news, scores)
        scores = staged(every.groupBy("kind", "host").agg(F.round(F.sum("score"), 12).alias("score")))
        to_come = (added.agg(F.sum("score")).first()[0] or 0.0) * pass_on / (1 - pass_on) + NEGLIGIBLE
        pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
        out = scores.groupBy("host").agg(pick("trust"), pick("distrust"))
        blocked = (F.col("distrust") >= block_from) & (F.col("distrust") > F.col("trust") + to_come)
        allowed = (F.col("distrust") + to_come < block_from) | (F.col("distrust") + to_come < F.col("trust"))
        if to_come <= 2 * NEGLIGIBLE or out.where(~blocked & ~allowed).isEmpty():
            return out


def _by_kind(scores: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).alias("score")) for c in ("trust", "distrust")]
    return scores.select("host", F.explode(F.array(*pairs)).alias("p")).select("p.kind", "host", "p.score")


def _spread_join(steps: DataFrame, per_source: DataFrame) -> DataFrame:
    """Join many rows per source with one, each source's rows dealt over ``SPREAD`` parts."""
    parts = per_source.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = steps.withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(SPREAD)).cast("int"))
    return dealt.join(parts, ["kind", "src", "part"]).drop("part")


def url_verdicts(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES,
) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict, trust, distrust``.

    A null url, or one without ``://``, has an empty host and path and is allowed, as are hosts that nothing reaches. A
    null html has no links. Repeated rows get one row each; an empty table gives none; other columns are not read.
    """
    ruled = staged(judged_by_rules(pages, page_id, url, rules))
    seed = staged(seeds(ruled))
    links = staged(
        host_links(pages, url, html).unionByName(parent_links(seed)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    )
    scores = staged(propagate(seed, links))
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= BLOCK_FROM)
    # pages without a rule meet their host's verdict; a host's pages are dealt over parts, so a large host is no hot key
    verdicts = scores.withColumn("by_host", F.when(blocked, "block").otherwise("allow"))
    parts = verdicts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD * 8 - 1))))
    dealt = ruled.withColumn("part", F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD * 8)).cast("int"))
    return dealt.join(parts, ["host", "part"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "by_host", F.lit("allow")).alias("verdict"),
        "trust", "distrust",
    )

"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

RECOMMENDED = {
    # Runtime re-planning: coalesces small shuffles, turns a join into a broadcast join once the
    # real size of a side is known, and splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a skewed join also where a later step must then shuffle its result again.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Naive timestamps everywhere; results must not move with the session zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

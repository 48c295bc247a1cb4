"""The history of strategies as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "ts double, domain string, strategy string, framework string, succeeded boolean, metrics struct<structural: double, density: double, scope: double, passed: boolean>, records int, retries int, failure_mode string, script string"
MAX_SCRIPT_CHARS = 20_000


def read(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """Entries, of one domain if given; lines that aren't JSON are skipped."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows if domain is None else rows.where(F.col("domain") == domain)


def append(entries: DataFrame, path: str) -> None:
    """Add entries; scripts stay only for frameworks that succeeded, and are cut."""
    keep = F.col("succeeded") & F.col("framework").isNotNull()
    entries.withColumn("script", F.when(keep, F.substring("script", 1, MAX_SCRIPT_CHARS))).write.mode("append").json(path)


def cached_script(history: DataFrame, domain: str, framework: str) -> DataFrame:
    """One row: the latest script that worked, or null."""
    found = history.where((F.col("domain") == domain) & (F.col("framework") == framework) & F.col("succeeded") & F.col("script").isNotNull())
    return found.agg(F.max_by("script", "ts").alias("script"))

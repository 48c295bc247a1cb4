"""Pages and events that keep arriving: the same operators over Structured Streaming, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.functions import text as T, urls as U
from docflow.operators import html_record


def read(spark: SparkSession, folder: str, schema: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def first_pages(pages: DataFrame, *, time_col: str, delay: str) -> DataFrame:
    """Pages whose canonical URL hasn't been seen within ``delay``; the watermark bounds what is remembered. Later repeats pass again."""
    keyed = pages.withColumn("canonical", U.canonical_form(F.col("url"))).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["canonical"])


def records(pages: DataFrame) -> DataFrame:
    """Records of a stream of pages (url, html); stateless."""
    return html_record.extract(pages)


def host_activity(pages: DataFrame, *, time_col: str, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Pages and words of each host in tumbling (or, with ``slide``, sliding) windows; rows later than ``delay`` are left out."""
    words = F.size(T.words(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")))
    timed = pages.withWatermark(time_col, delay).select(F.window(time_col, window, slide).alias("w"), U.domain(F.col("url")).alias("host"), words.alias("words"))
    return timed.groupBy("w", "host").agg(F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words")).select("w.start", "w.end", "host", "pages", "words")

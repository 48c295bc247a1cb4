"""Quality of a set of records, and the history of strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as T


def record_words(blocks: Column, codes: Column) -> Column:
    """Words of block texts, list items and code; tables don't count."""
    of = lambda t: F.size(T.words(F.coalesce(t, F.lit(""))))
    block = F.aggregate(blocks, F.lit(0), lambda n, b: n + of(b["text"]) + F.aggregate(F.coalesce(b["items"], F.array().cast("array<string>")), F.lit(0), lambda m, i: m + of(i)))
    return block + F.aggregate(codes, F.lit(0), lambda n, c: n + of(c["text"]))


def is_valid(url: Column, title: Column, words: Column) -> Column:
    """A record with a URL, a title and more than ten words."""
    return (F.coalesce(url, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "") & (words > 10)


def excerpt(blocks: Column, chars: int = 500) -> Column:
    """The beginning of a record's block texts, joined by blanks."""
    texts = F.filter(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), lambda t: t != "")
    return F.substring(F.array_join(texts, " "), 1, chars)


def judge_sample(records: DataFrame, order: str, by: str) -> DataFrame:
    """The first, middle and last record of each group in ``order``, which is unique in it: what a judge is shown."""
    numbered = records.select(by, order).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    size = numbered.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    chosen = numbered.join(size, by).where((F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | (F.col("_i") == F.floor(F.col("_n") / 2)))
    return records.join(chosen.select(by, order), [by, order], "left_semi")


def clean_share(answer: Column) -> Column:
    """Share of CLEAN among the verdicts (CLEAN or JUNK) of a judge's answer; null without one."""
    verdicts = F.regexp_extract_all(F.upper(answer), F.lit(r"\b(CLEAN|JUNK)\b"), F.lit(1))
    return F.when(F.size(verdicts) > 0, F.size(F.filter(verdicts, lambda v: v == "CLEAN")) / F.size(verdicts))


def quality(rows: DataFrame, *by: str, words: str = "words", valid: str = "valid") -> DataFrame:
    """structural, density, scope and passed of all rows, or of each group; no rows give zeros."""
    grouped = rows.groupBy(*by) if by else rows
    out = grouped.agg(
        F.coalesce(F.avg(F.col(valid).cast("double")), F.lit(0.0)).alias("structural"),
        F.coalesce(F.least(F.avg(words) / F.lit(1500.0), F.lit(1.0)), F.lit(0.0)).alias("density"),
        F.least(F.count(F.lit(1)) / F.lit(5.0), F.lit(1.0)).alias("scope"),
    )
    return out.withColumn("passed", (F.col("structural") > 0.95) & (F.col("density") > 0.15) & (F.col("scope") >= 1.0))


def skipped_strategies(history: DataFrame) -> DataFrame:
    """``history`` (domain, strategy, succeeded, pos) -> (domain, strategy): failed twice since its last success, where the
    crawler has succeeded."""
    last = history.groupBy("domain", "strategy").agg(F.max(F.when(F.col("succeeded"), F.col("pos"))).alias("last"))
    since = history.join(last, ["domain", "strategy"]).groupBy("domain", "strategy").agg(F.count_if(~F.col("succeeded") & (F.col("pos") > F.coalesce("last", F.lit(-1)))).alias("failed"))
    crawled = history.where("strategy = 'crawler' and succeeded").select("domain").distinct()
    return since.where("failed >= 2 and strategy <> 'crawler'").join(crawled, "domain", "left_semi").select("domain", "strategy")

"""Markdown documents cut into sections, slugs and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as T

FENCE = r"(?s)```(\w+)?\n(.*?)```"


def at_headings(text: Column, level: int) -> Column:
    """Text before the first heading of a level (if not blank), then a section for each; nothing without headings."""
    parts = F.transform(F.split(text, rf"(?m)(?=^#{{{level}}}\s+)"), T.strip)
    return F.when(text.rlike(rf"(?m)^#{{{level}}}\s+\S"), F.filter(parts, lambda s: s != "")).otherwise(F.array().cast("array<string>"))


def sections(text: Column) -> Column:
    """By second-level headings; few and very long ones by third-level headings, if there are ten."""
    long = lambda s: (F.length(s) > 6000) & (F.size(F.split(s, r"(?U)\s+")) > 3000)  # noqa: E731  3001 words have 3000 blanks between them

    def chosen(two: Column) -> Column:
        finer = T.once(at_headings(text, 3), lambda three: F.when(F.size(three) >= 10, three).otherwise(two))
        return F.when((F.size(two) <= 10) & F.exists(two, long), finer).otherwise(two)

    return T.once(at_headings(text, 2), chosen)


def slug(title: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))


def unique_slugs(rows: DataFrame, owner: str, position: str, title: str) -> DataFrame:
    """``rows`` with ``slug``: the k-th repeat within an owner gets ``-k``."""
    base = slug(F.col(title))
    nth = F.row_number().over(Window.partitionBy(owner, base).orderBy(position))
    return rows.withColumn("slug", F.when(nth == 1, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))))


def prose_blocks(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, FENCE), T.strip), lambda s: s != "")


def code_blocks(text: Column) -> Column:
    language = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    body = F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))
    return F.zip_with(language, body, lambda a, b: F.struct(F.nullif(a, F.lit("")).alias("language"), T.strip(b).alias("text")))

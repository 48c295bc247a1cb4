"""Records of llms text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import text as T, urls as U
from docflow.operators import parsers, sections
from docflow.schema import BLOCK, block


def needs_refetch(url: Column, content: Column) -> Column:
    """Whether a probed file may have been cut: a full one, or one of 60 KiB."""
    return F.lower(U.path(url)).endswith("llms-full.txt") | (F.octet_length(content) >= 60 * 1024)


def parsed(text: Column) -> tuple[Column, Column]:
    """Paragraph blocks and code blocks of a text with fences."""
    return F.transform(sections.prose_blocks(text), lambda p: block("paragraph", text=p)).cast(f"array<{BLOCK}>"), sections.code_blocks(text)


def _heading_text(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.btrim(T.unescaped(line)), r"^\s{0,3}#{1,6}\s+", ""))


def full_records(sources: DataFrame) -> DataFrame:
    """``sources`` (url, content), full files -> (source_url, order_index, url, title, content_blocks, code_blocks).

    The pages of a bundle are records at their own URL; a file without them is cut at its headings, each section with a body being a record at
    an anchor, which repeats of a title number. A null or empty content has none."""
    named = sources.select(F.col("url").alias("source_url"), F.coalesce("content", F.lit("")).alias("content"))
    base = F.regexp_replace("source_url", "#.*$", "")
    marked = F.col("content").contains("<page")
    pages = parsers.bundle_pages(named.where(marked), "source_url", "content")
    number = (F.col("pos") + 1).cast("string")
    heading = _heading_text(F.regexp_extract("body", r"(?m)^\s{0,3}#{1,6}\s+.+?$", 0))
    place = F.when(F.col("url") != "", F.col("url")).when(F.col("path") != "", U.resolve(base, F.col("path"))).otherwise(F.concat(base, F.lit("#page-"), number))
    title = F.when(F.col("title") != "", F.btrim(T.unescaped(F.col("title")))).when(heading != "", heading).otherwise(F.concat(F.lit("Page "), number))
    body = T.strip(F.when(F.col("description") != "", F.concat("description", F.lit("\n\n"), "body")).otherwise(F.col("body")))
    bundled = pages.where(body != "").select("source_url", F.col("pos").alias("order_index"), place.alias("url"), title.alias("title"), T.unescaped(body).alias("body"))

    cut = T.once(sections.sections(F.col("content")), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(T.strip(F.col("content")))))
    parts = named.where(~(marked & F.col("content").rlike(parsers.BUNDLE))).select("source_url", F.posexplode(cut).alias("order_index", "section"))
    first = F.regexp_extract("section", r"^[^\r\n]*", 0)
    parts = parts.select("source_url", "order_index", _heading_text(first).alias("title"), T.strip(F.substr("section", F.length(first) + 1)).alias("body")).where("body <> ''")
    parts = parts.withColumn("title", F.when(F.col("title") == "", "Untitled").otherwise(F.col("title")))
    parts = sections.unique_slugs(parts.withColumn("_t", F.when(sections.slug(F.col("title")) == "", "section").otherwise(F.col("title"))), "source_url", "order_index", "_t")
    cut_up = parts.select("source_url", "order_index", F.concat(F.regexp_replace(base, "/+$", ""), F.lit("#"), "slug").alias("url"), "title", "body")

    blocks, codes = parsed(F.col("body"))
    return bundled.unionByName(cut_up).select("source_url", "order_index", "url", "title", blocks.alias("content_blocks"), codes.alias("code_blocks"))

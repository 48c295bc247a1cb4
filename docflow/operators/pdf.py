"""PDF layout as tables: spans and detected tables of pages to blocks, and blocks to records.

``spans``: doc, page, block, line, span, text, font, size, box array<double> (of the block: x0, y0, x1, y1).
``tables``: doc, page, table, rows array<array<string>>, box. Everything is native; a group is one page or one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.functions import text as T
from docflow.operators.parsers import font_heading_level

#: Fonts that mean code, and the body size of a page without text.
MONO_FONTS = ("courier", "consolas", "monaco", "mono", "code", "inconsolata", "jetbrains")
DEFAULT_SIZE = 12.0
_ROWS = "array<array<string>>"


def overlaps(box: Column, boxes: Column) -> Column:
    """Whether a rectangle meets one of ``boxes``; touching counts."""
    return F.exists(boxes, lambda b: ~((box[2] < b[0]) | (b[2] < box[0]) | (box[3] < b[1]) | (b[3] < box[1])))


def page_blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, page, pos, type, level, text, rows): a page's tables, then its text blocks outside tables in their order.

    Code by font; headings by size against the page's upper median; other text is a paragraph. Blank spans count for nothing."""
    words = spans.withColumn("text", T.strip("text")).where("text <> ''")
    body = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list("size")).alias("s")).select("doc", "page", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("body"))
    mono = F.lit(False)
    for hint in MONO_FONTS:
        mono = mono | F.lower(F.coalesce("font", F.lit(""))).contains(hint)
    parts = F.array_sort(F.collect_list(F.struct("line", "span", "text")))
    blocks = words.groupBy("doc", "page", "block").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.max("size").alias("size"), F.max(mono).alias("mono"), F.min("box").alias("box")
    )
    filled = tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))))
    filled = filled.where(F.exists("rows", lambda r: F.exists(r, lambda c: c != "")))
    boxes = filled.groupBy("doc", "page").agg(F.collect_list("box").alias("boxes"))
    placed = blocks.join(body, ["doc", "page"]).join(boxes, ["doc", "page"], "left")
    placed = placed.where(F.col("boxes").isNull() | ~overlaps(F.col("box"), F.col("boxes")))
    level = F.when(~F.col("mono"), font_heading_level(F.col("size"), F.col("body")))
    kind = F.when(F.col("mono"), "code").when(level.isNotNull(), "heading").otherwise("paragraph")
    pos = lambda part, n: F.struct(F.lit(part).alias("part"), F.col(n).cast("int").alias("n")).alias("pos")
    text = placed.select("doc", "page", pos(1, "block"), kind.alias("type"), level.cast("int").alias("level"), "text", F.lit(None).cast(_ROWS).alias("rows"))
    found = filled.select("doc", "page", pos(0, "table"), F.lit("table").alias("type"), F.lit(None).cast("int").alias("level"), F.lit("").alias("text"), F.col("rows").cast(_ROWS).alias("rows"))
    return found.unionByName(text)


def _grouped(blocks: DataFrame, *by: str) -> DataFrame:
    """(by, blocks, content_blocks, code_blocks): blocks in order; code moves to ``code_blocks`` and leaves a marker."""
    ordered = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("page", "pos", "type", "level", "text", "rows"))).alias("b"))
    codes = F.transform(F.filter("b", lambda x: x["type"] == "code"), lambda x: F.struct(F.lit(None).cast("string").alias("language"), x["text"].alias("text")))
    before = lambda i: F.size(F.filter(F.slice("b", 1, i), lambda y: y["type"] == "code"))
    content = F.transform(
        "b",
        lambda x, i: F.struct(
            x["type"].alias("type"), x["level"].alias("level"), F.when(x["type"] == "code", "").otherwise(x["text"]).alias("text"), F.lit(None).cast("array<string>").alias("items"),
            x["rows"].alias("rows"), F.when(x["type"] == "code", before(i)).alias("code_block_index"),
        ),
    )
    return ordered.select(*by, content.alias("content_blocks"), codes.alias("code_blocks"))


def title(url: Column, named: Column) -> Column:
    """The title that a PDF names, else its file name in words."""
    name = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*?([^/?#]*)(?:[?#].*)?$", 1), r"\.pdf$", "")
    spaced = T.title_case(F.translate(name, "-_", "  "))
    return F.coalesce(F.nullif(T.strip(F.coalesce(named, F.lit(""))), F.lit("")), F.nullif(spaced, F.lit("")), url)


def records(documents: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Records of ``documents`` (doc, url, title, density): one (light), one for each section (medium), or one for each page (dense).

    ``links``: doc, uri. A section starts at a heading of level one or two, which is its title and no longer a block, unless nothing stands
    before it. Where a finer form gives nothing, the light one is used. Each code block stays with the section that holds it.
    The first record carries the document's links. -> (doc, url, order_index, title, content_blocks, code_blocks, breadcrumbs, links)
    """
    docs = documents.select("doc", "url", F.col("title").alias("base"), "density")
    kind = docs.select("doc", "density")
    order = Window.partitionBy("doc").orderBy("page", "pos")

    medium = blocks.join(kind.where("density = 'medium'").select("doc"), "doc", "left_semi")
    top = (F.col("type") == "heading") & (F.col("level") <= 2)
    run = medium.withColumn("top", F.coalesce(top, F.lit(False))).withColumn("run", F.sum(F.when(F.col("top"), 0).otherwise(1)).over(order))
    # in a run of top headings every other one starts a section: the one after a start is its content
    nth = F.row_number().over(Window.partitionBy("doc", "run").orderBy("page", "pos"))
    cut = run.withColumn("starts", F.col("top") & (nth % 2 == 0)).withColumn("section", F.sum(F.col("starts").cast("int")).over(order))
    heads = cut.where("starts").select("doc", "section", F.col("text").alias("head"))
    sections = _grouped(cut.where("not starts"), "doc", "section").join(heads, ["doc", "section"], "left")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("section"))
    by_section = sections.withColumn("n", number).join(docs, "doc").select(
        "doc", F.format_string("%s#section-%d", "url", "n").alias("url"), (F.col("n") - 1).alias("order_index"), F.coalesce("head", "base").alias("title"), "content_blocks", "code_blocks",
        F.when(F.coalesce("head", "base") != F.col("base"), F.array("base")).otherwise(F.array().cast("array<string>")).alias("breadcrumbs"),
    )

    pages = _grouped(blocks.join(kind.where("density = 'dense'").select("doc"), "doc", "left_semi"), "doc", "page").join(docs, "doc")
    heading = F.get(F.filter("content_blocks", lambda b: b["type"] == "heading"), F.lit(0))["text"]
    number = F.col("page").cast("int") + 1
    by_page = pages.select(
        "doc", F.concat("url", F.lit("#page="), number.cast("string")).alias("url"), F.col("page").cast("int").alias("order_index"),
        F.coalesce(heading, F.concat("base", F.lit(" — Page "), number.cast("string"))).alias("title"), "content_blocks", "code_blocks", F.array("base").alias("breadcrumbs"),
    )

    finer = by_section.unionByName(by_page)
    rest = docs.join(finer.select("doc").distinct(), "doc", "left_anti")
    whole = _grouped(blocks.join(rest.select("doc"), "doc", "left_semi"), "doc")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)).alias(c)
    light = rest.join(whole, "doc", "left").select(
        "doc", "url", F.lit(0).alias("order_index"), F.col("base").alias("title"), empty("content_blocks"), empty("code_blocks"), F.array().cast("array<string>").alias("breadcrumbs")
    )
    outbound = links.where("uri rlike '^https?://'").groupBy("doc").agg(F.array_sort(F.collect_set("uri")).alias("found"))
    every = finer.unionByName(light).join(outbound, "doc", "left")
    first = F.col("order_index") == 0
    return every.withColumn("links", F.when(first & F.col("found").isNotNull(), F.col("found")).otherwise(F.array().cast("array<string>"))).drop("found")

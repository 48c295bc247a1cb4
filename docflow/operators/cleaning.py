"""Cleaning of whole records: texts, items, cells and code, without empty blocks and repeated prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow import rules
from docflow.functions import text as T

EMPTY_NOTE = "cleaner: empty content after cleaning"


def _composed(blocks: Column) -> Column:
    """Blocks with composed texts, items and cells."""
    items = lambda cells: F.transform(cells, T.nfc)
    fields = {"text": T.nfc, "items": items, "rows": lambda rows: F.transform(rows, items)}
    return F.transform(blocks, lambda b: F.struct(*(fields.get(n, lambda c: c)(b[n]).alias(n) for n in ("type", "level", "text", "items", "rows", "code_block_index"))))


def _prose(text: Column) -> Column:
    return T.clean_prose(F.coalesce(text, F.lit("")), compose=False)


def has_content(block: Column) -> Column:
    """Headings and paragraphs need text, lists an item, tables a cell; anything else stays."""
    kind = block["type"]
    return (
        F.when(kind.isin("heading", "paragraph"), F.coalesce(block["text"], F.lit("")) != "")
        .when(kind == "list", F.size(F.coalesce(block["items"], F.array().cast("array<string>"))) > 0)
        .when(kind == "table", F.exists(F.coalesce(block["rows"], F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != "")))
        .otherwise(True)
    )


def clean_blocks(blocks: Column) -> Column:
    """Blocks with clean texts; empty ones go, and so do later repeats of a long paragraph or list. Code markers stay as they are."""
    none, no_rows = F.array().cast("array<string>"), F.array().cast("array<array<string>>")

    def one(b: Column) -> Column:
        kind = b["type"]
        items = F.when(kind == "list", F.filter(F.transform(F.coalesce(b["items"], none), _prose), lambda i: i != "")).otherwise(b["items"])
        rows = F.when(kind == "table", F.transform(F.coalesce(b["rows"], no_rows), lambda r: F.transform(r, _prose))).otherwise(b["rows"])
        text = F.when(kind.isin("heading", "paragraph", "list", "table"), _prose(b["text"])).otherwise(b["text"])
        return F.struct(kind.alias("type"), b["level"].alias("level"), text.alias("text"), items.alias("items"), rows.alias("rows"), b["code_block_index"].alias("code_block_index"))

    def prose(b: Column) -> Column:
        return F.when(b["type"] == "paragraph", b["text"]).when(b["type"] == "list", F.array_join(b["items"], "\n"))

    # the prose stands at its own position and short or other blocks at one of their own, so that only long prose can repeat
    def first(kept: Column) -> Column:
        keys = F.transform(kept, lambda b, i: F.when(F.length(prose(b)) >= rules.DUPLICATE_PROSE_CHARS, F.concat(b["type"], F.lit(":"), prose(b))).otherwise(i.cast("string")))
        return T.once(keys, lambda k: F.filter(kept, lambda _, i: F.array_position(k, F.get(k, i)) == i + 1))

    return T.once(F.filter(F.transform(blocks, one), has_content), first)


def clean_records(records: DataFrame) -> DataFrame:
    """``records`` (title, content_blocks, code_blocks, errors and more) clean; a record with nothing left gets a note among its errors."""
    kept = [c for c in records.columns if c not in ("title", "content_blocks", "code_blocks", "errors")]
    codes = F.transform("code_blocks", lambda c: F.struct(T.nfc(c["language"]).alias("language"), T.nfc(c["text"]).alias("text")))
    composed = records.withColumns({"title": T.nfc(F.col("title")), "content_blocks": _composed(F.col("content_blocks")), "code_blocks": codes})
    no_codes = F.array().cast(records.schema["code_blocks"].dataType)
    codes = F.transform(
        F.coalesce("code_blocks", no_codes),
        lambda c: F.struct(F.nullif(_prose(c["language"]), F.lit("")).alias("language"), T.clean_code(F.coalesce(c["text"], F.lit("")), compose=False).alias("text")),
    )
    no_blocks = F.array().cast(records.schema["content_blocks"].dataType)
    out = composed.select(*kept, "errors", _prose(F.col("title")).alias("title"), F.coalesce("content_blocks", no_blocks).alias("_b"), codes.alias("code_blocks"))
    out = out.withColumn("content_blocks", clean_blocks(F.col("_b"))).drop("_b")
    empty = (F.size("content_blocks") == 0) & (F.size("code_blocks") == 0)
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    return out.withColumn("errors", F.when(empty, F.concat(errors, F.array(F.lit(EMPTY_NOTE)))).otherwise(errors)).select(*records.columns)


def is_sparse(blocks: Column, codes: Column) -> Column:
    """A clean record without blocks and code, whatever else it has."""
    return (F.coalesce(F.size(blocks), F.lit(0)) <= 0) & (F.coalesce(F.size(codes), F.lit(0)) <= 0)


def is_navigation_only(blocks: Column, codes: Column, links: Column, errors: Column) -> Column:
    """A raw record with links and nothing else."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return ~some(blocks) & ~some(codes) & some(links) & ~some(errors)

"""The record of a page: one struct for every source."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCK = "struct<type:string,level:int,text:string,items:array<string>,rows:array<array<string>>,code_block_index:int>"
CODE = "struct<language:string,text:string>"
METADATA = "struct<breadcrumbs:array<string>,source_domain:string,extractor:string,llms_source:string,path:string>"
RECORD = f"struct<url:string,canonical_url:string,depth:int,order_index:int,title:string,content_blocks:array<{BLOCK}>,code_blocks:array<{CODE}>,links:array<string>,metadata:{METADATA},errors:array<string>>"


def block(kind: str, **fields: Column) -> Column:
    """A block with the fields that its kind has, the others null."""
    types = {"level": "int", "text": "string", "items": "array<string>", "rows": "array<array<string>>", "code_block_index": "int"}
    return F.struct(F.lit(kind).alias("type"), *(fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()))


def error_record(url: Column, message: Column) -> Column:
    """Failures are data: a record with the URL as title and one error."""
    empty = lambda t: F.expr(f"cast(array() as {t})")
    return F.struct(
        url.alias("url"), F.lit(None).cast("string").alias("canonical_url"), F.lit(0).alias("depth"), F.lit(0).alias("order_index"), url.alias("title"),
        empty(f"array<{BLOCK}>").alias("content_blocks"), empty(f"array<{CODE}>").alias("code_blocks"), empty("array<string>").alias("links"),
        F.expr(f"cast(null as {METADATA})").alias("metadata"), F.array(message).alias("errors"),
    )

"""Records as Markdown, in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.plans.workspace import Workspace


def heading_text(text: Column) -> Column:
    flat = F.btrim(F.replace(F.coalesce(F.nullif(text, F.lit("")), F.lit("Untitled")), F.lit("\n"), F.lit(" ")))
    return F.coalesce(F.nullif(flat, F.lit("")), F.lit("Untitled"))


def heading_levels(levels: Column) -> Column:
    """Source levels mapped to 3..6: from the first as base, never more than one deeper than the heading before."""
    start = F.struct(F.lit(None).cast("int").alias("base"), F.lit(2).alias("last"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        base = F.coalesce(acc["base"], level)
        now = F.greatest(F.lit(3), F.least(F.lit(6), acc["last"] + 1, F.lit(3) + F.greatest(F.lit(0), level - base)))
        return F.struct(base.alias("base"), now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def block_lines(block: Column, codes: Column, level: Column) -> Column:
    """Lines of one block; ``level``: what a heading is mapped to."""
    rows = F.coalesce(block["rows"], F.array().cast("array<array<string>>"))
    width = F.size(F.get(rows, F.lit(0)))
    bar = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    even = (width > 0) & F.forall(rows, lambda r: F.size(r) == width)
    table = F.when(
        even, F.concat(F.array(bar(rows[0]), bar(F.transform(rows[0], lambda _: F.lit("---")))), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), bar))
    ).otherwise(F.transform(rows, lambda r: F.concat(F.lit("- "), F.array_join(r, " | "))))
    code = F.get(codes, F.coalesce(block["code_block_index"], F.lit(-1)))
    none = F.array().cast("array<string>")
    blank = F.array(F.lit(""))
    return (
        F.when(block["type"] == "heading", F.concat(blank, F.array(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading_text(block["text"]))), blank))
        .when(block["type"] == "paragraph", F.array(F.coalesce(block["text"], F.lit("")), F.lit("")))
        .when(block["type"] == "list", F.concat(F.transform(F.coalesce(block["items"], none), lambda i: F.concat(F.lit("- "), i)), blank))
        .when((block["type"] == "table") & (F.size(rows) > 0), F.concat(blank, table, blank))
        .when(
            (block["type"] == "code") & (F.coalesce(block["code_block_index"], F.lit(-1)) >= 0) & code.isNotNull(),
            F.array(F.lit(""), F.concat(F.lit("```"), F.coalesce(code["language"], F.lit(""))), F.regexp_replace(code["text"], "\n+$", ""), F.lit("```"), F.lit("")),
        )
        .otherwise(none)
    )


def record_section(url: Column, canonical: Column, title: Column, breadcrumbs: Column, blocks: Column, codes: Column, errors: Column) -> Column:
    """A record's lines joined by newlines."""
    none = F.array().cast("array<string>")
    head = F.array(F.lit(""), F.concat(F.lit("## "), heading_text(F.coalesce(F.nullif(title, F.lit("")), F.nullif(url, F.lit("")), F.lit("Untitled Page")))), F.lit(""))
    source = F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(url, F.lit("")))
    source_lines = F.when(source.isNotNull(), F.array(F.concat(F.lit("Source: "), source), F.lit(""))).otherwise(none)
    crumbs = F.when(F.size(breadcrumbs) > 0, F.array(F.concat(F.lit("Breadcrumbs: "), F.array_join(breadcrumbs, " > ")), F.lit(""))).otherwise(none)
    levels = heading_levels(F.transform(F.filter(blocks, lambda b: b["type"] == "heading"), lambda b: F.coalesce(b["level"], F.lit(1))))
    nth = F.transform(blocks, lambda _, i: F.size(F.filter(F.slice(blocks, 1, i + 1), lambda b: b["type"] == "heading")))
    body = F.flatten(F.zip_with(blocks, F.transform(nth, lambda n: F.coalesce(F.get(levels, n - 1), F.lit(3))), lambda b, level: block_lines(b, codes, level)))
    note = F.array(F.concat(F.lit("Extraction note: "), F.get(errors, F.lit(0))), F.lit(""))
    return F.array_join(F.concat(head, source_lines, crumbs, F.when((F.size(blocks) == 0) & (F.size(errors) > 0), note).otherwise(body)), "\n")


def chunked(rows: DataFrame, arrival: str, pages: int = 50) -> DataFrame:
    """``rows`` with ``chunk`` from 0: slices of ``pages`` rows in the order of arrival.

    Ranks come from one count for each range partition, so that no task sees all rows."""
    if pages <= 0:
        raise ValueError("a chunk needs at least one page")
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), arrival).withColumn("_part", F.spark_partition_id())
    sorted_rows = Workspace(spark, "chunks").save(ranged)  # both uses see the same parts
    counts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = sorted_rows.join(F.broadcast(before), "_part")  # one row for each partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(arrival)) + F.col("_before")
    return ranked.withColumn("chunk", F.floor((rank - 1) / pages)).drop("_part", "_before")


def rendered(rows: DataFrame, order: list[str], section: str, title: str, *by: str) -> DataFrame:
    """One Markdown document of each group of ``by``: sections in order under a title."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(section).alias("_s")))), lambda x: x["_s"]), "\n")
    text = F.concat(F.lit(f"# {title}\n"), body)
    return rows.groupBy(*by).agg(F.concat(F.regexp_replace(text, "\n+$", ""), F.lit("\n")).alias("markdown"))

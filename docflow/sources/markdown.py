"""Markdown output: one document, or chunks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docflow.operators import render


def chunk_documents(rows: DataFrame, *, arrival: str, order: list[str], section: str, title: str, prefix: str, pages: int = 50) -> DataFrame:
    """(name, markdown) of each chunk: slices by arrival, sorted by ``order`` inside; named prefix_part_001_of_004.md and
    titled "(Part 1 of 4)", or prefix.md if one chunk is enough."""
    chunks = render.chunked(rows, arrival, pages)
    count = chunks.agg(F.max("chunk")).first()[0]
    total = 0 if count is None else int(count) + 1
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(section).alias("_s")))), lambda x: x["_s"]), "\n")  # at most ``pages`` rows
    number = F.col("chunk").cast("int") + 1
    one = total <= 1
    heading = F.lit(f"# {title}\n") if one else F.format_string(f"# {title} (Part %d of {total})\n", number)
    name = F.lit(f"{prefix}.md") if one else F.format_string(f"{prefix}_part_%03d_of_{total:03d}.md", number)
    text = F.concat(F.regexp_replace(F.concat(heading, "body"), "\n+$", ""), F.lit("\n"))
    return chunks.groupBy("chunk").agg(body.alias("body")).select(name.alias("name"), text.alias("markdown"))


def write(documents: DataFrame, path: str) -> None:
    """A folder for each document name, in any store that Spark writes to."""
    rows = documents.select("name", F.regexp_replace("markdown", r"\n\z", "").alias("markdown"))  # the writer ends each row with a newline
    rows.write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)

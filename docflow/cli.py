"""Command line: a table of fetched pages in, Markdown documents out.

    python -m docflow.cli START_URL --pages pages.parquet [--output docs.md] [--seed-mode merge] ...
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.operators import dedup, html_record, seeds
from docflow.plans import crawl
from docflow.sources import markdown

CHUNK_PAGES = 50


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="docflow", description="Documentation pages to Markdown.")
    out.add_argument("start_url")
    out.add_argument("--pages", required=True, help="Parquet table with url and html")
    out.add_argument("--max-pages", type=int)
    out.add_argument("--max-depth", type=int)
    out.add_argument("--seed-mode", choices=("single", "merge", "separate"), default="single", help="start page only; seeds in one output; one output for each seed")
    out.add_argument("--max-seeds", type=int, default=8)
    out.add_argument("--chunk-pages", type=int, default=CHUNK_PAGES, help=f"pages in one file, {CHUNK_PAGES} by default")
    out.add_argument("--output", "-o", help="folder of the documents; without it they go to standard output")
    out.add_argument("--include-sparse", action="store_true", help="keep pages that only navigate")
    return out


def seed_name(url: str) -> str:
    """A file name part from a seed's path."""
    path = urlsplit(url).path.strip("/")
    return re.sub("[/.]", "_", path) or "root"


def find_seeds(pages: DataFrame, start_url: str, max_seeds: int) -> list[str]:
    """The start and its best seeds, from the links of the start page; pages of the table count as live. At most ``max_seeds``."""
    spark = pages.sparkSession
    starts = spark.range(1).select(F.lit(start_url).alias("start"))
    home = html_record.extract(pages.where(F.col("url") == start_url)).select(F.lit(start_url).alias("start"), F.explode("links").alias("url"))
    none = spark.createDataFrame([], "start string, url string")
    found = seeds.discover(starts, home, none, pages.select("url"), max_seeds=max_seeds).where("verified").orderBy("rank").limit(max_seeds)
    return [r.url for r in found.select("url").collect()]


def merged(parts: list[DataFrame]) -> DataFrame:
    """Records of several seeds in their order; later ones with the canonical URL or else the URL of an earlier one go."""
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("seed", F.lit(n)).withColumn("path", F.concat(F.array(F.lit(n)), "path"))
        every = part if every is None else every.unionByName(part)
    keyed = every.withColumn("o", F.struct("seed", "depth", "path")).withColumn("_c", F.btrim(F.coalesce("canonical_url", F.lit(""))))
    return dedup.first_of_two_keys(keyed, "o", "_c", "url").where("decision = 'accepted'").drop("o", "_c", "decision")


def documents(records: DataFrame, prefix: str, chunk_pages: int) -> DataFrame:
    """(name, markdown) of the files of some records."""
    rows = crawl.sections(records).withColumn("arrival", F.struct("depth", "path"))
    return markdown.chunk_documents(rows, arrival="arrival", order=["depth", "path"], section="section", title=crawl.document_title(records), prefix=prefix, pages=chunk_pages)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = parser().parse_args(arguments)
    if options.chunk_pages <= 0:
        print("--chunk-pages must be positive", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("docflow").getOrCreate()
    pages = spark.read.parquet(options.pages)
    starts = [options.start_url] if options.seed_mode == "single" else find_seeds(pages, options.start_url, options.max_seeds)
    limits = {"max_pages": options.max_pages, "max_depth": options.max_depth, "include_sparse": options.include_sparse}
    found = [crawl.collect_records(pages, s, **limits).records for s in starts]
    stem = os.path.splitext(os.path.basename((options.output or "docs").rstrip("/")))[0]
    if options.seed_mode == "separate":
        out = None
        for start, records in zip(starts, found, strict=True):
            part = documents(records, f"{stem}_{seed_name(start)}", options.chunk_pages)
            out = part if out is None else out.unionByName(part)
    else:
        out = documents(found[0] if len(found) == 1 else merged(found), stem, options.chunk_pages)
    if options.output:
        markdown.write(out, options.output)
    else:
        for row in out.orderBy("name").toLocalIterator():
            sys.stdout.write(row.markdown)
    return 0


if __name__ == "__main__":
    sys.exit(main())

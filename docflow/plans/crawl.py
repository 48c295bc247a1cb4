"""A crawl as a query: pages of a site's table become records, followed from a start page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from docflow.functions import urls as U
from docflow.operators import cleaning, dedup, html_record, markdown_doc, render
from docflow.plans.workspace import Workspace


@dataclass(frozen=True)
class Crawl:
    """Accepted records, and one row for each page that was visited with its decision."""

    records: DataFrame
    decisions: DataFrame


def visits(edges: DataFrame, starts: list[str], *, max_pages: int | None, max_depth: int | None) -> DataFrame:
    """``edges`` (src, pos, dst) -> (url, depth, path) in breadth-first order: by depth, then by the link positions along the way.

    The order needs no running number: a page's key is the smallest path of positions that leads to it. Later pages than ``max_pages`` can't
    have led to earlier ones, so the limit is taken at the end."""
    spark = edges.sparkSession
    work = Workspace(spark, "visits")
    seeds = spark.createDataFrame([(u, 0, [i]) for i, u in enumerate(starts)], "url string, depth int, path array<int>")
    level = visited = work.save(seeds)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = level.join(edges, F.col("url") == F.col("src")).groupBy("dst").agg(F.min(F.concat("path", F.array("pos"))).alias("path"))
        found = reached.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), "path").join(visited.select("url"), "url", "left_anti")
        level = work.save(found)
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
        if max_pages is not None and visited.count() >= max_pages:
            break
    return visited if max_pages is None else visited.orderBy("depth", "path").limit(max_pages)


def read_pages(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (url, html), each by the reader of its format: Markdown by its path's ending, HTML otherwise. PDF files are no text, and
    have no record here: theirs come from spans (``operators.pdf``)."""
    kind = U.document_format(F.col("url"))
    pages = pages.withColumn("_format", F.coalesce(kind, F.lit("html")))
    return html_record.extract(pages.where("_format = 'html'")).unionByName(markdown_doc.extract(pages.where("_format = 'markdown'"), text_col="html"))


def collect_records(pages: DataFrame, start_url: str, *, max_pages: int | None = None, max_depth: int | None = None, include_sparse: bool = False) -> Crawl:
    """Follow links from ``start_url`` through ``pages`` (url, html). A page that isn't in the table is a record with an error.

    A record is skipped if it only navigates (unless ``include_sparse``), or repeats the canonical URL or else the content of one
    accepted before; the start page is followed whatever it holds."""
    spark = pages.sparkSession
    work = Workspace(spark, "crawl")
    start = spark.range(1).select(U.frontier_form(F.lit(start_url))).first()[0]
    if not start:
        raise ValueError(f"not a web address: {start_url!r}")
    site = pages.withColumn("_u", U.frontier_form(F.col("url"))).where((F.col("_u") == start) | U.is_relevant(F.col("_u"), start))
    first = site.groupBy(F.col("_u").alias("url")).agg(F.min_by("html", F.coalesce("url", F.lit(""))).alias("html"))
    records = work.save(read_pages(first))
    edges = records.select(F.col("url").alias("src"), F.posexplode("links").alias("pos", "to")).select("src", "pos", U.frontier_form(F.col("to")).alias("dst"))
    edges = work.save(edges.where((F.col("dst") != "") & U.is_relevant(F.col("dst"), start)))
    seen = work.save(visits(edges, [start], max_pages=max_pages, max_depth=max_depth))
    missing = F.col("title").isNull()
    blank = lambda c: F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType)).alias(c)
    raw = seen.join(records, "url", "left").select(
        "url", "canonical_url", "depth", "path", F.coalesce("title", "url").alias("title"), *(blank(c) for c in ("content_blocks", "code_blocks", "links", "breadcrumbs")),
        F.when(missing, F.array(F.lit("page not found"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    raw = raw.withColumn("failed", F.size("errors") > 0)
    navigates = cleaning.is_navigation_only(F.col("content_blocks"), F.col("code_blocks"), F.col("links"), F.col("errors"))
    raw = raw.withColumn("navigates", F.lit(False) if include_sparse else navigates)
    clean = work.save(cleaning.clean_records(raw))
    content = dedup.content_hash(F.col("title"), F.col("content_blocks"), F.col("code_blocks"))
    keyed = clean.where("not navigates").select(F.struct("depth", "path").alias("o"), U.canonical_form(F.coalesce("canonical_url", "url")).alias("canonical"), content.alias("content_hash"))
    decided = work.save(dedup.first_of_two_keys(keyed, "o", "canonical", "content_hash").select("o", "decision"))
    joined = clean.withColumn("o", F.struct("depth", "path")).join(decided, "o", "left").withColumn("decision", F.coalesce("decision", F.lit("navigation")))
    out = work.save(joined.drop("o", "navigates"))
    return Crawl(out.where("decision = 'accepted'").drop("decision"), out.select("url", "depth", "path", "decision", "failed", F.size("links").alias("n_links")))


def statistics(crawl: Crawl, *, max_depth: int | None = None) -> DataFrame:
    """One row: pages, max_depth, failed, skipped by reason, and whether the depth limit left links unfollowed."""
    when = lambda test: F.count_if(test)
    accepted = F.col("decision") == "accepted"
    capped = F.lit(False) if max_depth is None else F.coalesce(F.bool_or((F.col("depth") >= max_depth) & (F.col("n_links") > 0)), F.lit(False))
    return crawl.decisions.agg(
        when(accepted).alias("pages"), F.coalesce(F.max(F.when(accepted, F.col("depth"))), F.lit(0)).alias("max_depth"), when(F.col("failed")).alias("failed"),
        when(F.col("decision") == "navigation").alias("skipped_navigation"), when(F.col("decision") == "canonical").alias("skipped_canonical"),
        when(F.col("decision") == "content_hash").alias("skipped_content"), capped.alias("depth_capped"),
    )


def sections(records: DataFrame) -> DataFrame:
    """(depth, path, section): the Markdown of each record."""
    columns = (F.col(c) for c in ("url", "canonical_url", "title", "breadcrumbs", "content_blocks", "code_blocks", "errors"))
    return records.select("depth", "path", "url", render.record_section(*columns).alias("section"))


def document_title(records: DataFrame) -> str:
    """Of the first record: its host's documentation, else its title."""
    first = records.orderBy("depth", "path").select(U.domain(F.col("url")), "title").first()
    if first is None:
        return "Documentation"
    return f"{first[0]} Documentation" if first[0] else first[1] or "Documentation"


def run_pipeline(pages: DataFrame, start_url: str, **limits) -> DataFrame:
    """(markdown): one document of all accepted records in the order of the crawl."""
    found = collect_records(pages, start_url, **limits).records
    return render.rendered(sections(found), ["depth", "path"], "section", document_title(found))

"""The adaptive run of one site: probe, take the best source that it offers, measure, and correct until the records are good or retries end.

Responses are tables, so nothing is fetched: ``responses`` to the probed paths (see ``sources.probe``), ``files`` (url, body: llms files and
sitemaps) and ``pages`` (url, html; Markdown documents too). What models and scripts answer are tables as well: ``reports`` (attempt, text),
``verdicts`` (attempt, text) and ``script_lines`` (attempt, line_no, value). The records stay distributed; the state is one row, which
the decisions of ``operators.adaptive`` map to the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.functions import urls as U
from docflow.operators import adaptive, cleaning, llms, parsers, quality
from docflow.plans import crawl
from docflow.plans.workspace import Workspace
from docflow.schema import BLOCK, block
from docflow.sources import probe, sitemap

STATE = "detection string, failure_mode string, include_sparse boolean, max_depth int, workers int, retries int, exhausted boolean, n_records long, structural double, density double, scope double, passed boolean, words long"
_RECORD = ("url", "canonical_url", "position", "title", "content_blocks", "code_blocks", "links", "errors")


@dataclass
class Outcome:
    """records: those of the last attempt, in the order of ``position``; state: the last one; phases: all that were passed."""

    records: DataFrame
    state: dict
    phases: list[str] = field(default_factory=list)


@dataclass
class _Site:
    spark: SparkSession
    target: str
    tables: dict[str, DataFrame | None]
    max_pages: int | None
    detected: dict | None = None
    seeds: list[str] = field(default_factory=list)


def _shaped(rows: DataFrame) -> DataFrame:
    none = lambda t: F.expr(f"cast(array() as {t})")
    more = {"canonical_url": F.col("url"), "links": none("array<string>"), "errors": none("array<string>")}
    for name, value in more.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    return rows.select(*_RECORD)


def listed_records(urls: DataFrame, pages: DataFrame, include_sparse: bool) -> DataFrame:
    """Records of the pages of ``urls`` (url, position), clean; the first of each URL counts, a page that isn't there is a record with an error,
    and one without text or code goes unless ``include_sparse``."""
    wanted = urls.groupBy("url").agg(F.min("position").alias("position"))
    found = pages.join(wanted.select("url"), "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    rows = wanted.join(crawl.read_pages(found), "url", "left")
    missing = F.col("title").isNull()
    blank = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    raw = rows.select("url", "canonical_url", "position", F.coalesce("title", "url").alias("title"), *(blank(c) for c in ("content_blocks", "code_blocks", "links")), F.when(missing, F.array(F.lit("page not found"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    clean = cleaning.clean_records(raw)
    return _shaped(clean if include_sparse else clean.where((F.size("content_blocks") > 0) | (F.size("code_blocks") > 0)))


def _from_llms(site: _Site, state: dict) -> tuple[str, DataFrame | None]:
    url, body, files = site.detected["url"], site.detected["body"] or "", site.tables["files"]
    own = site.spark.createDataFrame([(url, body)], "url string, content string")
    if body == "" or own.select(llms.needs_refetch(F.col("url"), F.col("content"))).first()[0]:
        again = files.where(F.col("url") == url).agg(F.min("body")).first()[0]
        body = again or ""
        own = site.spark.createDataFrame([(url, body)], "url string, content string")
    if not body:
        return "crawl", None
    every = own.unionByName(files.where(F.col("url") != url).select("url", F.col("body").alias("content")))
    better = parsers.richer_sources(every).where(F.col("url") == url).first()
    if better:
        url = better["full_url"]
        own = every.where(F.col("url") == url).limit(1)
    words, targets = parsers.llms_shape(F.col("content"))
    shape = own.select(words.alias("words"), F.size(targets).alias("links"), parsers.is_full_text(words, F.size(targets)).alias("full")).first()
    if shape["full"]:
        return "measure", _shaped(llms.full_records(own).withColumn("position", F.array("order_index")))
    links = own.select(F.col("url").alias("base"), F.posexplode(targets).alias("pos", "to")).select(F.array("pos").alias("position"), U.resolve(F.col("base"), F.col("to")).alias("url"))
    here = links.where(U.domain(F.col("url")) == U.domain(F.lit(site.target)))
    return "measure", listed_records(links if here.isEmpty() else here, site.tables["pages"], state["include_sparse"])


def _from_sitemap(site: _Site, state: dict) -> tuple[str, DataFrame | None]:
    spark, found = site.spark, site.detected
    files = site.tables["files"].where(F.col("url") != found["url"]).select("url", "body").unionByName(spark.createDataFrame([(found["url"], found["body"])], "url string, body string"))
    targets = spark.createDataFrame([(site.target, found["url"])], "target string, sitemap string")
    urls = Workspace(spark, "adaptive").save(sitemap.expand(targets, files).groupBy("target", "url").agg(F.min("ord").alias("ord")))
    if site.max_pages is not None:
        urls = urls.orderBy("ord").limit(site.max_pages)
    if urls.isEmpty():
        return "crawl", None
    roots = sitemap.all_version_roots(urls).first()["roots"]
    if roots or spark.range(1).select(U.is_sitemap_file(F.lit(site.target))).first()[0]:
        site.seeds = [r["url"] for r in urls.orderBy("ord").select("url").toLocalIterator()]  # each is the start of a crawl
        if len(site.seeds) == 1:
            site.target = site.seeds[0]
        state["detection"] = site.detected = None
        return "crawl", None
    place = F.concat(F.array(F.col("ord.depth")), "ord.path", F.array(F.col("ord.pos")))
    return "measure", listed_records(urls.select("url", place.alias("position")), site.tables["pages"], state["include_sparse"])


def _from_openapi(site: _Site, state: dict) -> tuple[str, DataFrame | None]:
    spec = site.spark.createDataFrame([(site.detected["url"], site.detected["body"])], "spec string, body string")
    each = parsers.api_operations(spec, "spec", "body")
    paragraph = lambda text: F.when(text != "", F.array(block("paragraph", text=text).cast(BLOCK)))
    items = lambda name, xs: F.when(F.size(xs) > 0, F.array(block("list", text=F.lit(name), items=xs).cast(BLOCK)))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("Tags: "), F.array_join("tags", ", "))).otherwise("")
    parts = F.array(paragraph(F.col("description")), paragraph(tags), items("Parameters", F.col("parameters")), items("Responses", F.col("responses")))
    rank = F.array_position(F.array(*map(F.lit, parsers.METHODS)), F.lower(F.substring_index("title", " ", 1))).cast("int")
    rows = each.select(F.concat("spec", F.lit("#"), "anchor").alias("url"), F.array(F.col("order_index"), rank).alias("position"), "title", F.flatten(F.filter(parts, lambda x: x.isNotNull())).alias("content_blocks"), F.expr("cast(array() as array<struct<language:string,text:string>>)").alias("code_blocks"))
    return ("crawl", None) if rows.isEmpty() else ("measure", _shaped(rows))


def _from_script(site: _Site, state: dict) -> tuple[str, DataFrame | None]:
    lines = site.tables["script_lines"]
    rows = None if lines is None else adaptive.script_records(lines.where(F.col("attempt") == state["retries"]))
    if rows is None or rows.isEmpty():
        return "crawl", None  # a script that isn't there or says nothing gives way to the crawler
    return "measure", _shaped(rows.withColumn("position", F.array("order_index")))


def _from_crawl(site: _Site, state: dict) -> tuple[str, DataFrame | None]:
    every = None
    for n, start in enumerate(site.seeds or [site.target]):
        found = crawl.collect_records(site.tables["pages"], start, max_pages=site.max_pages, max_depth=state["max_depth"], include_sparse=state["include_sparse"]).records
        found = _shaped(found.withColumn("position", F.concat(F.array(F.lit(n), "depth"), "path")))
        every = found if every is None else every.unionByName(found)
    return "measure", every


_SOURCES = {"llms": _from_llms, "sitemap": _from_sitemap, "openapi": _from_openapi, "script": _from_script, "crawl": _from_crawl}


def run(
    spark: SparkSession, target: str, *, responses: DataFrame, files: DataFrame, pages: DataFrame, history: DataFrame | None = None, reports: DataFrame | None = None,
    verdicts: DataFrame | None = None, script_lines: DataFrame | None = None, include_sparse: bool = False, max_depth: int | None = None, max_pages: int | None = None, workers: int = 4,
) -> Outcome:
    """All phases of a run. ``history`` (domain, strategy, succeeded, pos): strategies that failed twice where the crawler worked are skipped."""
    work = Workspace(spark, "adaptive")
    site = _Site(spark, target, {"files": files, "pages": pages, "script_lines": script_lines}, max_pages)
    state = {"detection": None, "failure_mode": None, "include_sparse": include_sparse, "max_depth": max_depth, "workers": workers, "retries": 0, "exhausted": False, "n_records": 0}
    phases, records = ["probe"], None
    host, root = spark.range(1).select(U.domain(F.lit(target)), F.regexp_extract(F.lit(target), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)).first()
    found = probe.detect(responses.where(F.col("base") == root)).first()
    if found and history is not None and not quality.skipped_strategies(history).where((F.col("domain") == host) & (F.col("strategy") == found["type"])).isEmpty():
        found = None
    if found:
        site.detected, state["detection"] = found.asDict(), found["type"]
    phase = spark.range(1).select(adaptive.first_phase(F.lit(state["detection"]))).first()[0]

    def answer(table: DataFrame | None) -> str | None:
        row = None if table is None else table.where(F.col("attempt") == state["retries"]).select("text").first()
        return row and row["text"]

    def decided(step) -> str:
        columns = [f.split()[0] for f in STATE.split(", ")]
        row = step(spark.createDataFrame([tuple(state.get(c) for c in columns)], STATE)).first().asDict()
        state.update(row)
        return row["phase"]

    while phase not in ("done", "failed"):
        phases.append(phase)
        if phase in _SOURCES:
            phase, got = _SOURCES[phase](site, state)
            records = work.save(got) if got is not None else records
        elif phase == "measure":
            words = quality.record_words(F.col("content_blocks"), F.col("code_blocks"))
            measured = records.select(words.alias("words"), quality.is_valid(F.col("url"), F.col("title"), words).alias("valid"))
            state.update(quality.quality(measured).first().asDict())
            state["n_records"], state["words"] = measured.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
            if state["passed"] and (verdict := answer(verdicts)):
                share = spark.range(1).select(quality.clean_share(F.lit(verdict))).first()[0]
                state["passed"] = share is None or share >= 0.5
            phase = decided(adaptive.after_quality)
        elif phase == "feedback":
            text = answer(reports)
            report = spark.range(1).select(adaptive.feedback_report(F.lit(text).cast("string")).alias("r")).first()["r"]
            state["failure_mode"] = report and report["failure_mode"]
            phase = decided(adaptive.after_feedback)
        else:  # correct
            phase = decided(adaptive.corrected)
    phases.append(phase)
    return Outcome(records if records is not None else _shaped(listed_records(spark.createDataFrame([], "url string, position array<int>"), pages, True)), state, phases)

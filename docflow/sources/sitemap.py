"""Sitemaps and robots files, as tables of fetched bodies (url, body)."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from docflow import rules
from docflow.functions import html_signals as H, urls as U
from docflow.plans.workspace import Workspace

#: Files read for one target, when sitemaps are the source and when they give seeds; URLs of seeds.
MAX_FILES, MAX_SEED_FILES, MAX_SEED_URLS = 10, 6, 400
_LOC = r"(?i)<loc>\s*(.*?)\s*</loc>"


def _document(body: str | None) -> dict | None:
    try:
        root = ElementTree.fromstring(body or "")
    except (ElementTree.ParseError, ValueError):
        return None
    space = root.tag[: root.tag.index("}") + 1] if root.tag.startswith("{") else ""
    index = "sitemapindex" in root.tag
    found = (e.find(f"{space}loc") for e in root.findall(f"{space}{'sitemap' if index else 'url'}"))
    return {"is_index": index, "locs": [e.text.strip() for e in found if e is not None and e.text]}


@F.pandas_udf(StructType().add("is_index", BooleanType()).add("locs", ArrayType(StringType())))
def _documents(bodies: pd.Series) -> pd.DataFrame:
    read = [_document(b) or {"is_index": None, "locs": None} for b in bodies]
    return pd.DataFrame(read, columns=["is_index", "locs"])


def documents(files: DataFrame) -> DataFrame:
    """``files`` with is_index and locs; null where the XML is malformed, so that one bad body fails no query."""
    return files.withColumn("_d", _documents("body")).select("*", "_d.is_index", "_d.locs").drop("_d")


def expand(targets: DataFrame, files: DataFrame, *, max_files: int | None = None) -> DataFrame:
    """URLs of the sitemaps of ``targets`` (target, sitemap) -> (target, url, ord); repeats stay, ``ord`` sorts by order of arrival.

    Files are read breadth first until none is new, each once for a target; one that is missing or malformed gives nothing, and neither does a null target. ``max_files``
    stops earlier, as a budget of requests would (MAX_FILES is the usual one): the files that come first, by depth, by position, and then by address.
    A URL counts if it has the target's host, is no asset, and lies under the prefix of the target's path.
    """
    work = Workspace(targets.sparkSession, "sitemap")
    read = work.save(documents(files.select(F.col("url").alias("sitemap"), "body")).where("locs is not null").select("sitemap", "is_index", "locs"))
    level = work.save(targets.select("target", "sitemap").dropna().distinct().withColumn("path", F.array(F.lit(0))))
    visited = level
    while not level.isEmpty():
        refs = level.join(read.where("is_index"), "sitemap").select("target", "path", F.posexplode("locs").alias("pos", "sitemap"))
        found = refs.groupBy("target", "sitemap").agg(F.min(F.concat("path", F.array("pos"))).alias("path"))
        level = work.save(found.join(visited.select("target", "sitemap"), ["target", "sitemap"], "left_anti"))
        visited = visited.unionByName(level)
        if max_files is not None:
            # files of a later level come after all of this one, so those beyond the budget here can't be read
            nth = F.row_number().over(Window.partitionBy("target").orderBy(F.size("path"), "path", "sitemap"))
            before = visited
            visited = work.save(before.withColumn("_n", nth).where(F.col("_n") <= max_files).drop("_n"))
            level = level.join(visited.select("target", "sitemap"), ["target", "sitemap"], "left_semi")
    urls = visited.join(read.where("not is_index"), "sitemap").select("target", "path", "sitemap", F.posexplode("locs").alias("pos", "url"))
    low, prefix = F.lower(U.path(F.col("url"))), U.sitemap_prefix(U.path(F.col("target")))
    kept = (U.domain(F.col("url")) == U.domain(F.col("target"))) & ~U.ends_with_any(low, rules.ASSETS) & ((prefix == "/") | low.startswith(prefix))
    return urls.where(kept).select("target", "url", F.struct(F.size("path").alias("depth"), "path", "sitemap", "pos").alias("ord"))


def _parts(url: Column) -> Column:
    return F.filter(F.split(U.path(url), "/"), lambda p: p != "")


def is_version_root(url: Column, target: Column) -> Column:
    """Whether a URL is a sibling of the target: same host and first folder, as deep (two at least), and a folder."""
    mine, theirs = _parts(url), _parts(target)
    same = (U.domain(url) == U.domain(target)) & U.path(url).endswith("/") & (F.size(mine) == F.size(theirs)) & (F.get(mine, F.lit(0)) == F.get(theirs, F.lit(0)))
    return (F.size(theirs) >= 2) & same


def version_roots(body: Column, target: Column) -> Column:
    """The version roots that a sitemap's body lists, each once, in its order."""
    locs = F.transform(F.regexp_extract_all(body, F.lit(_LOC), F.lit(1)), lambda u: H.plain(u))
    return F.array_distinct(F.filter(locs, lambda u: (u != "") & ~U.ends_with_any(F.lower(U.path(u)), rules.ASSETS) & is_version_root(u, target)))


def all_version_roots(urls: DataFrame) -> DataFrame:
    """(target, url) -> (target, roots): whether all URLs of a target are version roots, so that a crawl starts from each."""
    return urls.groupBy("target").agg(F.bool_and(is_version_root(F.col("url"), F.col("target"))).alias("roots"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``robots`` (start, body) -> (start, sitemap): those that the file names on the start's host, and the usual one."""
    root = F.regexp_extract("start", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    named = robots.select("start", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:[ \t]*(.*?)\s*$"), F.lit(1))).alias("raw")).select("start", U.seed_form(F.col("raw")).alias("sitemap"))
    named = named.where((F.col("sitemap") != "") & (U.domain(F.col("sitemap")) == U.domain(F.col("start"))))
    return robots.select("start", F.concat(root, F.lit("/sitemap.xml")).alias("sitemap")).unionByName(named).distinct()


def bulk_urls(locs: DataFrame, host: Column, old: str, new: str) -> DataFrame:
    """``locs`` (pos, url) of a sitemap -> (pos, url): its pages under ``old``, moved to ``new``, each once where it came first."""
    moved = locs.select("pos", U.moved(F.btrim("url"), host, old, new).alias("url")).where("url is not null")
    return moved.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def seed_urls(sitemaps: DataFrame, files: DataFrame, *, max_files: int | None = MAX_SEED_FILES, max_urls: int | None = MAX_SEED_URLS) -> DataFrame:
    """Viable seeds of ``sitemaps`` (start, sitemap) -> (start, url), by a pattern and not by XML; smallest file names first.

    The limits are a feature: seeds are a first choice of pages, and by default there are as many as a crawl starts from. None: no limit."""
    work = Workspace(sitemaps.sparkSession, "seeds")
    locs = files.select(F.col("url").alias("sitemap"), F.explode(F.regexp_extract_all("body", F.lit(_LOC), F.lit(1))).alias("raw"))
    locs = work.save(locs.select("sitemap", U.seed_form(H.plain(F.col("raw"))).alias("loc")).where("loc <> ''").distinct())
    nested = F.col("loc").endswith(".xml") & F.lower("loc").contains("sitemap")
    same = U.domain(F.col("loc")) == U.domain(F.col("start"))
    level = work.save(sitemaps.select("start", "sitemap").dropna().distinct().withColumn("depth", F.lit(0)))
    visited, depth = level, 0
    while not level.isEmpty() and (max_files is None or depth < max_files - 1):
        depth += 1
        found = level.join(locs.where(nested), "sitemap").where(same).select("start", F.col("loc").alias("sitemap")).distinct()
        level = work.save(found.join(visited, ["start", "sitemap"], "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(level)
    if max_files is not None:
        turn = F.row_number().over(Window.partitionBy("start").orderBy("depth", "sitemap"))
        visited = visited.withColumn("turn", turn).where(F.col("turn") <= max_files)
    first = F.min(F.struct("depth", "sitemap")).alias("turn")
    urls = visited.join(locs.where(~nested), "sitemap").where(U.is_viable_seed(F.col("loc"), F.col("start"))).groupBy("start", F.col("loc").alias("url")).agg(first)
    if max_urls is None:
        return urls.select("start", "url")
    nth = F.row_number().over(Window.partitionBy("start").orderBy("turn", "url"))
    return urls.withColumn("n", nth).where(F.col("n") <= max_urls).select("start", "url")

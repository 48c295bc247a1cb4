"""Candidates for the start pages of a crawl: guesses, links, sitemaps and search results, ranked and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow import rules
from docflow.functions import html_signals as H, urls as U

URL = r"https?://[^\s\])\"']+"


def guesses(start: Column) -> Column:
    """Usual documentation paths beside, under and above a start URL."""
    root = F.regexp_extract(start, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.coalesce(F.nullif(U.path(start), F.lit("")), F.lit("/"))
    slashed = F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/"))
    folders = F.array_distinct(F.transform(F.array(path, slashed, U.parent_path(path)), lambda p: F.regexp_replace(p, "[^/]*$", "")))
    suffixes = F.array(*map(F.lit, rules.SEED_SUFFIXES))
    every = F.flatten(F.transform(folders, lambda p: F.transform(suffixes, lambda s: U.seed_form(F.concat(root, p, s)))))
    return F.array_distinct(F.filter(every, lambda u: u != ""))


def urls_in_json(text: Column) -> Column:
    """URLs of a search answer: values of url, link and href at any depth, and URLs inside other strings."""
    pair = r'(?i)"(?:url|link|href)"\s*:\s*"((?:[^"\\]|\\.)*)"'
    plain = lambda s: F.regexp_replace(s, r"\\/", "/")
    return F.array_distinct(F.transform(F.concat(F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(r"https?:(?:\\?/){2}[^\s\])\"'\\]+"), F.lit(0))), plain))


def urls_in_answer(text: Column) -> Column:
    """URLs of a model's answer: a JSON array of strings, or else whatever looks like a URL."""
    trimmed = F.btrim(text)
    listed = F.when(trimmed.startswith("[") & trimmed.endswith("]"), F.from_json(trimmed, "array<string>", {"mode": "PERMISSIVE"}))
    found = F.coalesce(listed, F.regexp_extract_all(trimmed, F.lit(URL), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, lambda u: U.seed_form(F.btrim(u))), lambda u: u != ""))


def urls_in_result_page(html: Column, engine: str) -> Column:
    """Targets of a search engine's result page: of its redirects, and links that leave ``engine``."""
    hrefs = F.transform(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)), lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))
    target = lambda h: F.try_url_decode(F.regexp_extract(h, r"[?&]uddg=([^&#]*)", 1))
    return F.filter(F.transform(hrefs, lambda h: F.when(h.contains("uddg="), target(h)).when(h.rlike("^https?://") & ~h.contains(engine), h)), lambda u: F.coalesce(u, F.lit("")) != "")


def page_context(pages: DataFrame, observed: DataFrame | None = None, key: str = "url") -> DataFrame:
    """What a start page tells of its site: ``pages`` (url, html and more) with title, headings, nav_labels and the sorted URLs of its host:
    internal_links, script_urls, iframe_urls, network_urls, interaction_urls.

    ``observed`` (url, kind, found): what a browser saw on a page, of kind network or interaction; without it both lists are empty. Where several
    pages have one URL, ``key`` names a column of both tables that tells them apart. A page with null html has an empty title and empty lists."""
    url, html = F.col("url"), F.coalesce("html", F.lit(""))
    viable = lambda found: F.filter(found, lambda u: U.is_viable_seed(u, url))
    ours = lambda found: F.filter(found, lambda u: U.domain(u) == U.domain(url))
    out = pages.withColumns({
        "title": H.title(html), "headings": H.headings(html), "nav_labels": H.nav_labels(html), "internal_links": viable(H.attribute_urls(html, "a", "href", url)),
        "script_urls": ours(H.attribute_urls(html, "script", "src", url)), "iframe_urls": ours(H.attribute_urls(html, "iframe", "src", url)),
    })
    none = F.array().cast("array<string>")
    if observed is None:
        return out.withColumns({"network_urls": none, "interaction_urls": none})
    seen = observed.select("url", F.col(key).alias("_key"), "kind", U.seed_form(F.col("found")).alias("found")).where(U.is_viable_seed(F.col("found"), url) & ((F.col("kind") != "network") | ~U.is_asset(F.col("found"))))
    lists = seen.groupBy("_key").agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("found")))).alias(f"{k}_urls") for k in ("network", "interaction")))
    return out.join(lists.withColumnRenamed("_key", key), key, "left").withColumns({f"{k}_urls": F.coalesce(f"{k}_urls", none) for k in ("network", "interaction")})


def ranked(candidates: DataFrame) -> DataFrame:
    """(start, url) -> (start, url, score, rank): each URL once, best first, the start itself left out."""
    scored = candidates.where((F.col("url") != "") & (F.col("url") != F.col("start"))).distinct().withColumn("score", U.seed_score(F.col("url"), F.col("start")))
    best = Window.partitionBy("start").orderBy(F.desc("score"), F.length(U.path(F.col("url"))), "url")
    return scored.withColumn("rank", F.row_number().over(best))


def select_live(candidates: DataFrame, live: DataFrame, *, max_count: int, probes: int = rules.MAX_PROBED, fallback: bool = True) -> DataFrame:
    """Of ``candidates`` (start, url, rank), the first ``max_count`` that are in ``live`` (url) among the first ``probes``; without any,
    the first unverified ones if ``fallback``. -> (start, url, rank, verified)"""
    if max_count <= 0:
        return candidates.select("start", "url", "rank", F.lit(False).alias("verified")).where("false")
    first = candidates.where(F.col("rank") <= max(probes, max_count))
    marked = first.join(live.select("url", F.lit(True).alias("up")).distinct(), "url", "left").withColumn("up", F.col("up").isNotNull() & (F.col("rank") <= probes))
    group = Window.partitionBy("start")
    nth = F.sum(F.col("up").cast("int")).over(group.orderBy("rank"))
    state = marked.withColumn("any", F.max("up").over(group)).withColumn("nth", nth)
    picked = F.col("up") & (F.col("nth") <= max_count)
    if fallback:
        picked = picked | (~F.col("any") & (F.col("rank") <= max_count))
    return state.where(picked).select("start", "url", "rank", F.col("up").alias("verified"))


def discover(starts: DataFrame, links: DataFrame, sitemap_urls: DataFrame, live: DataFrame, *, max_seeds: int = 8) -> DataFrame:
    """(start, url, rank, verified): the start at rank 0, and its best live candidates among guesses, linked pages and sitemap URLs."""
    origin = starts.select(U.seed_form(F.col("start")).alias("start")).where("start <> ''").distinct()
    linked = links.select("start", "url").where(U.is_viable_seed(F.col("url"), F.col("start")))
    every = origin.select("start", F.explode(guesses(F.col("start"))).alias("url")).unionByName(linked).unionByName(sitemap_urls.select("start", "url"))
    chosen = select_live(ranked(every.join(origin, "start", "left_semi")), live, max_count=max_seeds - 1)
    return origin.select("start", F.col("start").alias("url"), F.lit(0).alias("rank"), F.lit(True).alias("verified")).unionByName(chosen)

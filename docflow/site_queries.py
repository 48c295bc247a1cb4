"""Queries of what a site offers and how a run decides, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow import rules, schema
from docflow.functions import html_signals as H, urls as U
from docflow.operators import adaptive, cleaning, llms, markdown_doc, parsers, pdf, quality, render, sections, seeds
from docflow.queries import _EDGES, _MD_LINK, _PLAIN, _SEED_SCORE, _WORDS, _any_of, _sql, query
from docflow.sources import playbook, probe, sitemap

_SEED_FORM = _sql("lower(@part(1)) || '://' || lower(@part(2)) || coalesce(nullif(@part(3), ''), '/')")
_ROOT = _sql("@part(1) || '://' || @part(2)")
_id = lambda name: F.col(name).cast("string")
_root = lambda: F.concat(U.part(F.col("url"), 1), F.lit("://"), U.part(F.col("url"), 2))


def _of(column: str, sql: str) -> str:
    """SQL over ``url`` as SQL over another column."""
    return _sql(sql).replace("(url,", f"({column},")


_SUFFIXES = [*rules.NON_DOC_ASSETS, ".html", "", ".PNG", "/"]


@query("asset_urls", "pages", f"""
WITH u AS (SELECT page_id, url || {_SUFFIXES!r}[(page_id % {len(_SUFFIXES)})::INT + 1] AS u FROM pages)
SELECT page_id, {_any_of(rules.NON_DOC_ASSETS, _of("u", "lower(@part(3))"), "ends_with")} AS asset FROM u""")  # fmt: skip
def asset_urls(pages):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("page_id") % len(_SUFFIXES)).cast("int") + 1)
    return pages.select("page_id", U.is_asset(F.concat("url", suffix)).alias("asset"))


@query("bulk_moved_urls", "pages", f"""
WITH m AS (SELECT page_id, {_ROOT} || '/next/' || substr(@part(3), 5) || @part(4) || @part(5) AS url FROM pages
           WHERE starts_with(@part(3), '/en/') AND NOT {_any_of(rules.BULK_ASSETS, "lower(@part(3))", "ends_with")})
SELECT min(page_id) AS pos, url FROM m GROUP BY url""")  # fmt: skip
def bulk_moved_urls(pages):
    """A sitemap's pages of one version as those of the next, each once."""
    return sitemap.bulk_urls(pages.select(F.col("page_id").alias("pos"), "url"), U.domain(F.col("url")), "/en/", "/next/")


@query("viable_seeds", "pages", f"""
WITH v AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'https://else.example/en/' ELSE {_ROOT} || CASE WHEN page_id % 2 = 0 THEN '/EN/' ELSE '/' END END AS start FROM pages)
SELECT page_id, page_id % 5 <> 0 AND lower(@part(3)) NOT IN ('', '/') AND NOT {_any_of(rules.BLOCKED_SEEDS, "lower(@part(3))", "ends_with")}
 AND ((page_id % 2 = 0 AND starts_with(lower(@part(3)), '/en/')) OR {_any_of(rules.DOC_HINTS, "lower(@part(3))", "contains")}) AS viable FROM v""")  # fmt: skip
def viable_seeds(pages):
    """Which pages may start a crawl of their site's English part, of the whole site, or of another site."""
    start = F.when(F.col("page_id") % 5 == 0, "https://else.example/en/").otherwise(F.concat(_root(), F.when(F.col("page_id") % 2 == 0, "/EN/").otherwise("/")))
    return pages.select("page_id", U.is_viable_seed(F.col("url"), start).alias("viable"))


@query("page_context", "pages", rf"""
WITH {_EDGES}, h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1)) AS x FROM pages),
heads AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT t)), '|') AS headings FROM (SELECT page_id, {_PLAIN.format("x")} AS t FROM h) WHERE t <> '' GROUP BY page_id),
every AS (SELECT page_id, src, url FROM edges UNION ALL SELECT page_id, url, {_ROOT} || '/docs/' || page_id FROM pages),
forms AS (SELECT DISTINCT page_id, {_SEED_FORM} AS u, rtrim(lower({_of("src", "@part(3)")}), '/') AS start, lower({_of("src", "@part(2)")}) AS host FROM every WHERE regexp_matches(url, '^(?i:https?)://')),
ok AS (SELECT page_id, u AS url, start, host FROM forms),
inner_links AS (SELECT page_id, array_to_string(list_sort(list(DISTINCT url)), ' ') AS links FROM ok
                WHERE lower(@part(2)) = host AND lower(@part(3)) NOT IN ('', '/') AND NOT {_any_of(rules.BLOCKED_SEEDS, "lower(@part(3))", "ends_with")}
                  AND ((start <> '' AND starts_with(lower(@part(3)), start || '/')) OR {_any_of(rules.DOC_HINTS, "lower(@part(3))", "contains")}) GROUP BY page_id)
SELECT p.page_id, {_PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, coalesce(headings, '') AS headings, coalesce(links, '') AS links,
       lower(@part(1)) || '://' || lower(@part(2)) || '/js/' || p.page_id || '.js' AS scripts, '' AS iframes,
       CASE WHEN p.page_id % 2 = 0 THEN lower(@part(1)) || '://' || lower(@part(2)) || '/api/' || p.page_id ELSE '' END AS network
FROM pages p LEFT JOIN heads USING (page_id) LEFT JOIN inner_links USING (page_id)""")  # fmt: skip
def page_context(pages):
    """What each page tells of its site; a script, a frame of another host, two links and a browser's observations are added to the test pages."""
    added = (F.lit('<script async src="/js/'), _id("page_id"), F.lit(".js\"></script><iframe src='//else.example/f'></iframe><a href='/docs/"), _id("page_id"), F.lit("#x'></a><a href='/docs/x.pdf'></a>"))
    html = F.concat(*added, F.col("html"))
    at = lambda name: F.concat(_root(), F.lit(name), _id("page_id"))
    seen = pages.where("page_id % 2 = 0").select("page_id", "url", F.lit("network").alias("kind"), F.explode(F.array(at("/api/"), F.concat(at("/api/"), F.lit(".css")), F.lit("https://else.example/docs"))).alias("found"))
    out = seeds.page_context(pages.withColumn("html", html), seen, "page_id")
    joined = lambda c, by=" ": F.array_join(F.array_sort(c), by)
    return out.select("page_id", "title", joined("headings", "|").alias("headings"), joined("internal_links").alias("links"), joined("script_urls").alias("scripts"), joined("iframe_urls").alias("iframes"), joined("network_urls").alias("network"))


_MARKS = [mark for _, mark in probe.FRAMEWORKS]


@query("framework_detect", "pages", f"""
SELECT 'https://d' || page_id AS base, 'https://d' || page_id || '/' AS url, [{", ".join(f"'{name}'" for name, _ in probe.FRAMEWORKS)}, 'readthedocs'][(page_id % 7)::INT + 1] AS framework FROM pages WHERE page_id % 7 <> 6""")  # fmt: skip
def framework_detect(pages):
    """Home pages of which most carry a framework's mark, in the page or in a header."""
    turn = (F.col("page_id") % 7).cast("int")
    body = F.concat(F.coalesce("html", F.lit("")), F.coalesce(F.get(F.array(*map(F.lit, _MARKS)), turn), F.lit("")))
    headers = F.when(turn == len(_MARKS), F.create_map(F.lit("X-ReadTheDocs-Project"), F.lit("x")))
    base = F.concat(F.lit("https://d"), _id("page_id"))
    rows = pages.select(base.alias("base"), F.lit("homepage").alias("key"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), body.alias("body"), headers.alias("headers"))
    return probe.detect(rows).select("base", "url", "framework")


@query("robots_sitemaps", "pages", f"""
SELECT DISTINCT start, sitemap FROM (SELECT url AS start, {_ROOT} || '/sitemap.xml' AS sitemap FROM pages UNION ALL SELECT url, {_SEED_FORM} FROM pages
 UNION ALL SELECT url, lower(@part(1)) || '://' || lower(@part(2)) || '/maps/' || page_id || '.xml' FROM pages)""")  # fmt: skip
def robots_sitemaps(pages):
    body = F.concat(F.lit("User-agent: *\nSitemap: "), "url", F.lit("\n  SITEMAP:"), _root(), F.lit("/maps/"), _id("page_id"), F.lit(".xml\nsitemap: https://else.example/s.xml\nsitemap: /relative.xml\nDisallow: /x\n"))
    return sitemap.robots_sitemaps(pages.select(F.col("url").alias("start"), body.alias("body")))


_FOLDERS = _sql("list_filter(str_split(@part(3), '/'), lambda p: p <> '')")


@query("version_roots", "pages", f"""
SELECT page_id, array_to_string(list_distinct([{_ROOT} || '/en/v' || page_id || '/', {_ROOT} || '/en/v0/']
       || CASE WHEN ends_with(@part(3), '/') AND len({_FOLDERS}) = 2 AND {_FOLDERS}[1] = 'en' THEN [url] ELSE []::VARCHAR[] END).list_sort(), ' ') AS roots FROM pages""")  # fmt: skip
def version_roots(pages):
    """Which URLs of a sitemap are other versions of a target; its page is one if it is a folder beside the target."""
    target = F.concat(_root(), F.lit("/en/v0/"))
    loc = lambda url: F.concat(F.lit("<url><loc> "), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    version = F.concat(_root(), F.lit("/en/v"), _id("page_id"), F.lit("/"))
    others = (F.concat(_root(), F.lit("/en/v1/deep/")), F.concat(_root(), F.lit("/other/v1/")), F.lit("https://else.example/en/v1/"), F.concat(_root(), F.lit("/en/v1")))
    body = F.concat(F.lit("<urlset>"), *map(loc, (version, target, F.col("url"), version, *others)), F.lit("</urlset>"))
    return pages.select("page_id", F.array_join(F.array_sort(sitemap.version_roots(body, target)), " ").alias("roots"))


@query("version_root_hosts", "pages", f"""
SELECT target, bool_and(ends_with(@part(3), '/') AND len({_FOLDERS}) = 2 AND {_FOLDERS}[1] = lang) AS roots
FROM (SELECT *, {_FOLDERS}[1] AS lang, 'https://' || lower(@part(2)) || '/' || {_FOLDERS}[1] || '/' || (page_id % 3) || '/' AS target FROM pages) GROUP BY target""")  # fmt: skip
def version_root_hosts(pages):
    language = F.get(F.filter(F.split(U.path(F.col("url")), "/"), lambda p: p != ""), F.lit(0))
    target = F.concat(F.lit("https://"), U.domain(F.col("url")), F.lit("/"), language, F.lit("/"), (F.col("page_id") % 3).cast("string"), F.lit("/"))
    return sitemap.all_version_roots(pages.select(target.alias("target"), "url"))


@query("sitemap_files", "pages", f"""
WITH u AS (SELECT page_id, rtrim(url, '/') || ['/sitemap.xml', '/Sitemap-2.XML', '/map.xml', '', '/sitemap.xml/x'][(page_id % 5)::INT + 1] AS url FROM pages)
SELECT page_id, ends_with(lower(regexp_extract(@part(3), '[^/]*$')), '.xml') AND contains(lower(regexp_extract(@part(3), '[^/]*$')), 'sitemap') AS is_file FROM u""")  # fmt: skip
def sitemap_files(pages):
    name = F.element_at(F.array(*map(F.lit, ("/sitemap.xml", "/Sitemap-2.XML", "/map.xml", "", "/sitemap.xml/x"))), (F.col("page_id") % 5).cast("int") + 1)
    return pages.select("page_id", U.is_sitemap_file(F.concat(F.regexp_replace("url", "/+$", ""), name)).alias("is_file"))


@query("live_seeds", "pages", f"""
WITH c AS (SELECT DISTINCT 'https://' || lower(@part(2)) || '/en/' AS start, url FROM pages), s AS (SELECT *, {_SEED_SCORE} AS score FROM c WHERE url <> start),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, length(@part(3)), url) AS rank FROM s),
m AS (SELECT *, url IN (SELECT url FROM pages WHERE page_id % 3 = 0) AS up FROM r WHERE rank <= 20),
n AS (SELECT *, bool_or(up) OVER (PARTITION BY start) AS found, sum(up::INT) OVER (PARTITION BY start ORDER BY rank) AS nth FROM m)
SELECT start, url, rank, up AS verified FROM n WHERE (up AND nth <= 3) OR (NOT found AND rank <= 3)""")  # fmt: skip
def live_seeds(pages):
    """The best three answering pages of each host, or three unverified ones where none answers."""
    candidates = pages.select(F.concat(F.lit("https://"), U.domain(F.col("url")), F.lit("/en/")).alias("start"), "url")
    out = seeds.select_live(seeds.ranked(candidates), pages.where("page_id % 3 = 0").select("url"), max_count=3)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("document_responses", "pages", f"""
WITH r AS (SELECT page_id, url, [200, 301, NULL, 404, 500][(page_id % 5)::INT + 1] AS status, [NULL, 'text/html; charset=utf-8', 'Text/Plain', 'image/png', 'application/xhtml+xml', ''][(page_id % 6)::INT + 1] AS type,
                  CASE WHEN page_id % 7 = 0 THEN 'else.example' ELSE lower(@part(2)) END AS host FROM pages)
SELECT page_id, coalesce(status, 0) < 400 AND lower(@part(2)) = host AND (coalesce(type, '') = '' OR {_any_of(rules.DOCUMENT_TYPES, "lower(type)", "contains")}) AS document FROM r""")  # fmt: skip
def document_responses(pages):
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % n).cast("int"))
    start = F.concat(F.lit("https://"), F.when(F.col("page_id") % 7 == 0, "else.example").otherwise(U.domain(F.col("url"))))
    kind = pick(6, None, "text/html; charset=utf-8", "Text/Plain", "image/png", "application/xhtml+xml", "")
    return pages.select("page_id", U.looks_like_document(pick(5, 200, 301, None, 404, 500), F.col("url"), kind, start).alias("document"))


@query("pagination_controls", "pages", f"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]*>(.*?)</a>', 1) || ['Load ' || page_id, 'MORE results', 'Older']) AS x FROM pages)
SELECT page_id, count(*) FILTER (WHERE {_any_of(rules.PAGINATION_HINTS, "lower(x)", "contains")}) AS controls, count(*) AS labels FROM h GROUP BY page_id""")  # fmt: skip
def pagination_controls(pages):
    labels = F.concat(F.regexp_extract_all("html", F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), F.array(F.concat(F.lit("Load "), _id("page_id")), F.lit("MORE results"), F.lit("Older")))
    rows = pages.select("page_id", F.explode(labels).alias("label"))
    return rows.groupBy("page_id").agg(F.count_if(H.is_pagination(F.col("label"))).alias("controls"), F.count(F.lit(1)).alias("labels"))


@query("json_search_urls", "pages", f"""
SELECT DISTINCT page_id, u AS url FROM (SELECT page_id, unnest([url, {_ROOT} || '/deep', 'https://b.example/x' || page_id]) AS u FROM pages)""")  # fmt: skip
def json_search_urls(pages):
    """A search answer names URLs by key, at depth, and inside a sentence."""
    deep = F.struct(F.array(F.struct(F.concat(_root(), F.lit("/deep")).alias("Link"))).alias("items"), F.concat(F.lit("see https://b.example/x"), _id("page_id"), F.lit(" now")).alias("note"))
    return pages.select("page_id", F.explode(seeds.urls_in_json(F.to_json(F.struct("url", deep.alias("more"))))).alias("url"))


@query("answer_urls", "pages", f"""
SELECT DISTINCT page_id, u AS url FROM (SELECT page_id, {_SEED_FORM} AS u FROM pages UNION ALL SELECT page_id, 'https://b.example/y' FROM pages WHERE page_id % 2 = 1)""")  # fmt: skip
def answer_urls(pages):
    """A model's answer: a JSON array, or prose."""
    listed = F.to_json(F.array("url", F.concat(F.lit(" "), "url"), F.lit("no url")))
    prose = F.concat(F.lit("Try "), "url", F.lit(" and (https://b.example/y) too"))
    return pages.select("page_id", F.explode(seeds.urls_in_answer(F.when(F.col("page_id") % 2 == 0, listed).otherwise(prose))).alias("url"))


@query("result_page_urls", "pages", "SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'https://b.example/' || page_id FROM pages")
def result_page_urls(pages):
    """A result page with a redirect, a direct link, and a link of the engine."""
    html = F.concat(F.lit('<a href="//e.example/l/?uddg='), F.url_encode("url"), F.lit('&amp;rut=1">x</a><a href="https://b.example/'), _id("page_id"), F.lit('">y</a><a href="https://e.example/q">z</a><a href="/about">w</a>'))
    return pages.select("page_id", F.explode(seeds.urls_in_result_page(html, "e.example")).alias("url"))


@query("script_output", "documents", r"""
SELECT doc_id AS order_index, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://' || source || '.example/' || doc_id END AS url, CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE 'Page ' || (doc_id + 1) END AS title,
       (doc_id % 5)::INT AS depth, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS prose, source AS code FROM documents WHERE doc_id % 4 <> 3""")  # fmt: skip
def script_output(docs):
    """Lines of a script with whole texts; every fourth is broken."""
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n```\n"), "source", F.lit("\n```\n"))
    url = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("https://"), "source", F.lit(".example/"), _id("doc_id")))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), _id("doc_id")))
    line = F.to_json(F.struct(url.alias("url"), title.alias("title"), content.alias("content"), F.struct((F.col("doc_id") % 5).cast("int").alias("depth")).alias("metadata")))
    broken = F.when(F.col("doc_id") % 8 == 3, F.concat(F.lit("Traceback "), "source")).otherwise("[1, 2]")
    out = adaptive.script_records(docs.select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 4 == 3, broken).otherwise(line).alias("value")))
    texts = lambda c: F.array_join(F.transform(c, lambda b: b["text"]), "|")
    return out.select(F.col("order_index").cast("long").alias("order_index"), "url", "title", "depth", texts("content_blocks").alias("prose"), texts("code_blocks").alias("code"))


@query("cached_script", "events", "SELECT max_by('s' || event_id, event_id) AS script FROM events WHERE user_id % 50 = 7 AND event_type = 'click' AND value > 20")
def cached_script(events):
    history = events.select(
        F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")).alias("domain"), F.col("event_type").alias("framework"), (F.col("value") > 20).alias("succeeded"),
        F.concat(F.lit("s"), _id("event_id")).alias("script"), F.col("event_id").alias("ts"),
    )
    return playbook.cached_script(history, "d7", "click")


@query("render_blocks", "documents", r"""
SELECT doc_id, array_to_string(['', '## ' || doc_id, '', 'Source: u', '', '- ' || replace(coalesce(text, ''), chr(10), chr(10) || '- '), '', '', CASE WHEN doc_id % 2 = 0 THEN '| ' || source || ' | ' || coalesce(lang, '') || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |'
       ELSE '- ' || source || chr(10) || '- ' || coalesce(lang, '') || ' | 2' END, '', '', '### H ' || source, '', '', '```' || coalesce(lang, ''), regexp_replace(coalesce(text, ''), '\n+$', ''), '```', ''], chr(10)) AS section FROM documents""")  # fmt: skip
def render_blocks(docs):
    """A list of a text's lines, an even or uneven table, a heading, and the text as code."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    rows = F.when(F.col("doc_id") % 2 == 0, F.array(F.array("source", lang), F.array(F.lit("1"), F.lit("2")))).otherwise(F.array(F.array("source"), F.array(lang, F.lit("2"))))
    blocks = F.array(
        schema.block("list", items=F.split(text, "\n")), schema.block("table", rows=rows), schema.block("heading", level=F.lit(4), text=F.concat(F.lit("H\n"), "source")), schema.block("code", code_block_index=F.lit(0)),
    ).cast(f"array<{schema.BLOCK}>")
    codes = F.array(F.struct(F.col("lang").alias("language"), F.concat(text, F.lit("\n\n")).alias("text")))
    none = F.array().cast("array<string>")
    return docs.select("doc_id", render.record_section(F.lit("u"), F.lit(None).cast("string"), _id("doc_id"), none, blocks, codes, none).alias("section"))


_WIDE = "replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(9), '    ')"


@query("markdown_documents", "documents", f"""
SELECT 'https://h/d/my-doc_v2x-' || doc_id || '.md' AS url, CASE doc_id % 3 WHEN 0 THEN 'T' || doc_id WHEN 1 THEN 'H' || doc_id ELSE 'My Doc V2X ' || doc_id END AS title, {_WIDE} || chr(10) AS code FROM documents""")  # fmt: skip
def markdown_documents(docs):
    """Whole texts as Markdown documents that hold them twice, as code and as prose; titles from front matter, a heading or the file name."""
    ident, text = _id("doc_id"), F.coalesce("text", F.lit(""))
    front = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('---\nlayout: x\ntitle: "T'), ident, F.lit('"\n---\n'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# H"), ident, F.lit("\n"))).otherwise("")
    body = F.concat(front, F.lit("\n~~~~~~~~py\n"), text, F.lit("\n~~~~~~~~\n\npara "), F.replace(text, F.lit("#"), F.lit("")), F.lit("\n"))
    out = markdown_doc.extract(docs.select(F.concat(F.lit("https://h/d/my-doc_v2x-"), ident, F.lit(".md")).alias("url"), body.alias("text")))
    return out.select("url", "title", F.get("code_blocks", F.lit(0))["text"].alias("code"))


@query("llms_section_choice", "documents", rf"""
WITH d AS (SELECT doc_id, '## A' || chr(10) || repeat(coalesce(text, '') || chr(10), 4) || repeat(chr(10) || '### s' || chr(10) || 'x', (doc_id % 12)::INT) AS md FROM documents),
n AS (SELECT doc_id, {_WORDS.format("md")} AS words, len(regexp_extract_all(md, '(?m)^##\s+')) AS two, len(regexp_extract_all(md, '(?m)^###\s+')) AS three FROM d)
SELECT doc_id, CASE WHEN two <= 10 AND words > 3000 AND three >= 9 THEN three + 1 ELSE two END AS sections FROM n""")  # fmt: skip
def llms_section_choice(docs):
    """Few and very long sections are cut at their third-level headings, where there are enough."""
    md = F.concat(F.lit("## A\n"), F.repeat(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), 4), F.expr("repeat('\n### s\nx', cast(doc_id % 12 as int))"))
    return docs.select("doc_id", F.size(sections.sections(md)).cast("long").alias("sections"))


@query("llms_preferred", "documents", f"""
WITH w AS (SELECT doc_id, {_WORDS.format("regexp_replace('[All](/llms-full.txt) ' || coalesce(text, ''), " + _MD_LINK + ", ' ', 'g')")} AS few,
                  {_WORDS.format("regexp_replace(coalesce(text, '') || ' ' || coalesce(text, ''), " + _MD_LINK + ", ' ', 'g')")} AS many FROM documents)
SELECT 'https://h' || doc_id || '/llms.txt' AS url, 'https://h' || doc_id || '/llms-full.txt' AS full_url FROM w WHERE many > greatest(few, 300)""")  # fmt: skip
def llms_preferred(docs):
    """Each text as an llms file that links a fuller one."""
    text = F.coalesce("text", F.lit(""))
    file = lambda name, content: F.struct(F.concat(F.lit("https://h"), _id("doc_id"), F.lit(name)).alias("url"), content.alias("content"))
    files = F.array(file("/llms.txt", F.concat(F.lit("[All](/llms-full.txt) "), text)), file("/llms-full.txt", F.concat(text, F.lit(" "), text)))
    return parsers.richer_sources(docs.select(F.explode(files).alias("f")).select("f.*"))


@query("llms_refetch", "documents", f"""
WITH d AS (SELECT doc_id, 'https://h/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '/LLMS-full.txt' ELSE '/llms.txt' END AS url, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN repeat(' [a](/b)', 40) ELSE '' END AS t FROM documents),
w AS (SELECT *, {_WORDS.format("regexp_replace(t, " + _MD_LINK + ", ' ', 'g')")} AS words, len(list_filter(regexp_extract_all(t, {_MD_LINK}, 2), lambda u: NOT starts_with(u, '#'))) AS links FROM d)
SELECT doc_id, ends_with(lower(@part(3)), 'llms-full.txt') OR octet_length(encode(t)) >= 61440 AS refetch, words > 300 AND links < words // 10 AS full_text FROM w""")  # fmt: skip
def llms_refetch(docs):
    url = F.concat(F.lit("https://h/"), _id("doc_id"), F.when(F.col("doc_id") % 9 == 0, "/LLMS-full.txt").otherwise("/llms.txt"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, " [a](/b)" * 40).otherwise(""))
    words, links = parsers.llms_shape(text)
    return docs.select("doc_id", llms.needs_refetch(url, text).alias("refetch"), parsers.is_full_text(words, F.size(links)).alias("full_text"))


@query("pdf_blocks", "conversations", r"""
WITH m AS (SELECT conv_id AS doc, turn::INT AS page, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^ | $', '', 'g') AS t, coalesce(role, '') AS role FROM conversations)
SELECT doc, page, 'table' AS type, role || ' ' || page AS text FROM m WHERE page % 2 = 0
UNION ALL SELECT doc, page, 'paragraph', 'in ' || t FROM m WHERE page % 2 = 1 UNION ALL SELECT doc, page, 'paragraph', 'edge' FROM m WHERE page % 2 = 1
UNION ALL SELECT doc, page, CASE WHEN page % 3 = 0 THEN 'code' ELSE 'paragraph' END, 'out ' || role FROM m""")  # fmt: skip
def pdf_blocks(messages):
    """Texts inside and at the edge of a table are the table's; others are blocks of their own."""
    text = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    piece = lambda n, line, span, words, corner, font: F.struct(F.lit(n).alias("block"), F.lit(line).alias("line"), F.lit(span).alias("span"), words.alias("text"), font.alias("font"), F.lit(12.0).alias("size"), F.array(*(F.lit(x) for x in corner)).alias("box"))
    plain, mono = F.lit("Arial"), F.when(F.col("turn") % 3 == 0, "Courier New").otherwise("Arial")
    spans = F.array(
        piece(0, 0, 0, F.lit("in"), (1.0, 1.0, 5.0, 5.0), plain), piece(0, 1, 0, text, (1.0, 1.0, 5.0, 5.0), plain), piece(1, 0, 0, F.lit("edge"), (10.0, 10.0, 20.0, 20.0), plain),
        piece(2, 0, 1, F.coalesce("role", F.lit("")), (11.0, 30.0, 12.0, 32.0), mono), piece(2, 0, 0, F.lit("out"), (11.0, 30.0, 12.0, 32.0), mono),
    )
    at = (F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"))
    found = messages.where("turn % 2 = 0").select(*at, F.lit(0).alias("table"), F.array(F.array(F.coalesce("role", F.lit("")), _id("turn"))).alias("rows"), F.array(*(F.lit(x) for x in (0.0, 0.0, 10.0, 10.0))).alias("box"))
    out = pdf.page_blocks(messages.select(*at, F.explode(spans).alias("s")).select("doc", "page", "s.*"), found)
    return out.select("doc", "page", "type", F.when(F.col("type") == "table", F.array_join(F.flatten("rows"), " ")).otherwise(F.col("text")).alias("text"))


@query("pdf_links", "pages", f"""
WITH {_EDGES}, d AS (SELECT page_id % 20 AS doc, array_to_string(list_sort(list(DISTINCT e.url)), ' ') AS links FROM edges e WHERE regexp_matches(e.url, '^https?://') GROUP BY 1)
SELECT doc, 'My File V2X ' || doc AS title, coalesce(links, '') AS links FROM (SELECT DISTINCT page_id % 20 AS doc FROM pages) LEFT JOIN d USING (doc)""")  # fmt: skip
def pdf_links(pages):
    """PDF files without text: one record each, titled by its file name, with all links of its pages."""
    doc = (F.col("page_id") % 20).alias("doc")
    url = F.concat(F.lit("https://h/my-file_v2x-"), _id("doc"), F.lit(".pdf"))
    docs = pages.select(doc).distinct().select("doc", url.alias("url"), pdf.title(url, F.lit(" ")).alias("title"), F.lit("light").alias("density"))
    blocks = pdf.page_blocks(
        docs.where("false").selectExpr("doc", "0 page", "0 block", "0 line", "0 span", "'' text", "'' font", "1d size", "array(0d) box"),
        docs.where("false").selectExpr("doc", "0 page", "0 table", "array(array('')) rows", "array(0d) box"),
    )
    links = pages.select(doc, "url", F.explode(H.links(F.col("html"))).alias("href")).select("doc", U.resolve(F.col("url"), F.col("href")).alias("uri"))
    return pdf.records(docs, blocks, links).select("doc", "title", F.array_join("links", " ").alias("links"))


@query("record_gate", "documents", rf"""
WITH r AS (SELECT doc_id, doc_id % 4 = 0 AS bare, doc_id % 3 = 0 AS linked, doc_id % 5 = 0 AS failed, doc_id % 7 = 0 AS untitled,
                  regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') = '' AS blank, {_WORDS.format("coalesce(text, '')")} AS words FROM documents)
SELECT doc_id, bare AND linked AND NOT failed AS navigation, bare OR blank AS sparse, NOT untitled AND NOT bare AND words > 10 AS valid FROM r""")  # fmt: skip
def record_gate(docs):
    """Records without content, with links, with errors or without a title: which are navigation, sparse or valid."""
    some = lambda n, item, kind: F.when(F.col("doc_id") % n == 0, F.array(F.lit(item))).otherwise(F.array()).cast(kind)
    blocks = F.when(F.col("doc_id") % 4 != 0, F.array(schema.block("paragraph", text=F.col("text")))).otherwise(F.array()).cast(f"array<{schema.BLOCK}>")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 7 != 0, "t").alias("title"), blocks.alias("content_blocks"), F.array().cast(f"array<{schema.CODE}>").alias("code_blocks"), some(3, "https://h/", "array<string>").alias("links"), some(5, "e", "array<string>").alias("errors"))
    raw = rows.withColumn("navigation", cleaning.is_navigation_only(*(F.col(c) for c in ("content_blocks", "code_blocks", "links", "errors"))))
    clean = cleaning.clean_records(raw)
    words = quality.record_words(F.col("content_blocks"), F.col("code_blocks"))
    return clean.select("doc_id", "navigation", cleaning.is_sparse(F.col("content_blocks"), F.col("code_blocks")).alias("sparse"), quality.is_valid(F.lit("u"), F.col("title"), words).alias("valid"))


@query("adaptive_outcomes", "events", """
WITH s AS (SELECT event_id, (event_id % 4)::INT AS n, event_id % 3 = 0 AS passed, [1.0, 0.95, 0.9][(event_id % 3)::INT + 1] AS structural, CASE WHEN event_id % 2 = 0 THEN 1200 ELSE 1199 END AS words,
                  event_id % 5 = 0 AS detected, event_id % 8 AS retries, event_id % 7 < 4 AS sparse, event_id % 11 < 6 AS unlimited FROM events),
q AS (SELECT *, CASE WHEN passed OR (n = 1 AND structural >= 0.95 AND words >= 1200) THEN 'done' WHEN NOT detected AND retries > 0 AND n <= 1 AND sparse AND unlimited THEN CASE WHEN n > 0 THEN 'done' ELSE 'failed' END ELSE 'feedback' END AS quality_phase FROM s)
SELECT event_id, quality_phase, CASE WHEN quality_phase = 'feedback' AND retries < 3 THEN retries + 1 ELSE retries END::INT AS retries,
       CASE WHEN quality_phase <> 'feedback' OR retries < 3 THEN 'correct' WHEN n > 0 THEN 'done' ELSE 'failed' END AS feedback_phase FROM q""")  # fmt: skip
def adaptive_outcomes(events):
    """States after their records were measured, and after the diagnosis of those that failed."""
    pick = lambda n, *values: F.get(F.array(*map(F.lit, values)), (F.col("event_id") % n).cast("int"))
    turn = lambda n: (F.col("event_id") % n).cast("int")
    states = events.select(
        "event_id", turn(4).alias("n_records"), (turn(3) == 0).alias("passed"), pick(3, 1.0, 0.95, 0.9).alias("structural"), pick(2, 1200, 1199).alias("words"),
        F.when(turn(5) == 0, "sitemap").alias("detection"), turn(8).alias("retries"), (turn(7) < 4).alias("include_sparse"), F.when(turn(11) >= 6, 3).alias("max_depth"),
    )
    measured = adaptive.after_quality(states).withColumn("quality_phase", F.col("phase"))
    return adaptive.after_feedback(measured).select("event_id", "quality_phase", "retries", F.col("phase").alias("feedback_phase"))


@query("model_answers", "conversations", """
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') WHEN 2 THEN coalesce(text, '') || '!' ELSE '' END AS answer FROM conversations""")  # fmt: skip
def model_answers(messages):
    """Whole texts in the shapes that models answer in."""
    text = F.coalesce("text", F.lit(""))
    parts = F.array(F.struct(text.alias("text")), F.struct(F.lit("!").alias("text")))
    shapes = (
        F.struct(F.struct(text.alias("content")).alias("message")), F.struct(text.alias("content")),
        F.struct(F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates")), F.struct(F.lit(1).alias("other")),
    )
    response = F.lit(None).cast("string")
    for n, shape in enumerate(shapes):
        response = F.when(F.col("turn") % 4 == n, F.to_json(shape)).otherwise(response)
    return messages.select("conv_id", "turn", adaptive.answer_text(response).alias("answer"))

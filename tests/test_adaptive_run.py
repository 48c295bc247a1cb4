"""Runs of one site over tables of responses, and what they are built from."""

from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pytest

from docflow import rules
from docflow.functions import text as T, urls as U
from docflow.operators import llms, quality
from docflow.plans import adaptive_run
from docflow.sources import probe
from pyspark.sql import functions as F

RESPONSE = "base string, key string, status int, content_type string, body string, headers map<string,string>"


def filler(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def page(title, words, *links):
    return f"<h1>{title}</h1><p>{filler(title, words)}</p>" + "".join(f"<a href='{x}'>{x}</a>" for x in links)


def run(spark, target="https://h/docs/", responses=(), files=(), pages=(), **more):
    return adaptive_run.run(
        spark, target, responses=spark.createDataFrame([("https://h", *r, None) for r in responses], RESPONSE),
        files=spark.createDataFrame(list(files), "url string, body string"), pages=spark.createDataFrame(list(pages), "url string, html string"), **more,
    )


def rows(outcome):
    return [(r.url, r.title) for r in outcome.records.orderBy("position").collect()]


def test_richer_llms_file(spark):
    short = f"# Site\n\n{filler('a', 350)} [full](/llms-full.txt) [self](#x)"
    full = f"## One\n{filler('b', 420)}\n## Two\n{filler('c', 420)}"
    out = run(spark, responses=[("llms_1", 200, "text/plain", short)], files=[("https://h/llms-full.txt", full)])
    assert rows(out) == [("https://h/llms-full.txt#one", "One"), ("https://h/llms-full.txt#two", "Two")]
    assert out.phases == ["probe", "llms", "measure", "feedback", "correct", "done"] and out.state["retries"] == 1


def test_llms_index_lists_pages(spark):
    index = "# Site\n" + "\n".join(f"- [p{n}](/docs/p{n})" for n in range(6)) + "\n- [else](https://else/x)\n- [guide](/docs/g.md)\n- [gone](/docs/gone)"
    pages = [(f"https://h/docs/p{n}", page(f"P{n}", 300)) for n in range(6)] + [("https://h/docs/g.md", f"# Guide\n\n{filler('g', 300)}\n")]
    out = run(spark, responses=[("llms_1", 200, "text/markdown", index)], pages=pages)
    assert rows(out) == [(f"https://h/docs/p{n}", f"P{n}") for n in range(6)] + [("https://h/docs/g.md", "Guide")]
    assert out.state["passed"] and out.phases == ["probe", "llms", "measure", "done"]


def test_sitemap_list_and_version_roots(spark):
    body = "<urlset>{}</urlset>".format("".join(f"<url><loc>https://h/docs/p{n}</loc></url>" for n in range(6)))
    pages = [(f"https://h/docs/p{n}", page(f"P{n}", 300)) for n in range(6)]
    out = run(spark, responses=[("sitemap_1", 200, "text/xml", body)], pages=pages)
    assert len(rows(out)) == 6 and out.phases == ["probe", "sitemap", "measure", "done"]
    roots = "<urlset><url><loc>https://h/en/v1/</loc></url><url><loc>https://h/en/v2/</loc></url></urlset>"
    pages = [(f"https://h/en/v{n}/{x}", page(f"V{n}{x}", 300, f"/en/v{n}/a", f"/en/v{n}/b")) for n in (1, 2) for x in ("", "a", "b")]
    out = run(spark, "https://h/sitemap.xml", responses=[("sitemap_1", 200, "text/xml", roots)], pages=pages)
    assert out.phases == ["probe", "sitemap", "crawl", "measure", "done"] and len(rows(out)) == 6 and out.state["detection"] is None


def test_crawl_widens_then_accepts(spark):
    pages = [("https://h/docs/", page("Home", 20, "/docs/a")), ("https://h/docs/a", page("A", 20))]
    out = run(spark, pages=pages, max_depth=0, reports=spark.createDataFrame([(1, '{"failure_mode": "empty_content", "confidence_score": 2}')], "attempt int, text string"))
    assert out.phases[:6] == ["probe", "crawl", "measure", "feedback", "correct", "crawl"]
    assert out.phases[-1] == "done" and out.state["include_sparse"] and out.state["max_depth"] is None and len(rows(out)) == 2


def test_openapi_script_judge_and_history(spark):
    spec = '{"openapi": "3", "paths": {"/z": {"get": {"summary": "S", "description": "D", "tags": ["t"], "responses": {"200": {"description": "ok"}}}}}}'
    out = run(spark, responses=[("openapi_1", 200, "application/json", spec)])
    record = out.records.first()
    assert (record.url, record.title) == ("https://h/openapi.json#get-z", "GET /z — S") and [b.type for b in record.content_blocks] == ["paragraph", "paragraph", "list"]
    home = ("homepage", 200, "text/html", '<div id="__docusaurus">')
    lines = [(0, n, '{"url": "https://h/s%d", "title": "S%d", "content": "%s"}' % (n, n, filler("s", 300))) for n in range(5)]
    frame = spark.createDataFrame(lines, "attempt int, line_no int, value string")
    out = run(spark, responses=[home], script_lines=frame)
    assert out.phases == ["probe", "script", "measure", "done"] and len(rows(out)) == 5
    judged = run(spark, responses=[home], script_lines=frame, verdicts=spark.createDataFrame([(0, "1. JUNK 2. junk 3. CLEAN")], "attempt int, text string"))
    assert "feedback" in judged.phases and judged.phases[-1] == "done"
    history = spark.createDataFrame([("h", "framework", False, 1), ("h", "framework", False, 2), ("h", "crawler", True, 3)], "domain string, strategy string, succeeded boolean, pos int")
    out = run(spark, responses=[home], script_lines=frame, history=history, pages=[])
    assert out.phases[1] == "crawl" and out.state["n_records"] == 1


def test_bundle_and_repeated_titles(spark):
    bundle = '<page path="/a" title="A &amp; B"><![CDATA[URL: https://h/x\nDescription: About\n\nBody &lt;1&gt;\n```py\nx\n```]]></page><page path="/b"><![CDATA[# Head\ntext]]></page>'
    frame = spark.createDataFrame([("https://h/f#z", bundle), ("https://h/g", "# T\n\n## One\na\n## One\nb\n## None\n## ???\nc"), ("https://h/n", None), ("https://h/p", "Only\nplain")], "url string, content string")
    got = {(r.source_url, r.order_index): r for r in llms.full_records(frame).collect()}
    assert (got["https://h/f#z", 0].url, got["https://h/f#z", 0].title) == ("https://h/x", "A & B") and got["https://h/f#z", 0].content_blocks[0].text == "About\n\nBody <1>"
    assert (got["https://h/f#z", 1].url, got["https://h/f#z", 1].title) == ("https://h/b", "Head") and got["https://h/f#z", 0].code_blocks[0].language == "py"
    assert sorted(r.url for k, r in got.items() if k[0] == "https://h/g") == ["https://h/g#one", "https://h/g#one-2", "https://h/g#section"]
    assert got["https://h/p", 0].title == "Only" and not any(k[0] == "https://h/n" for k in got)


def test_links_join_as_the_standard_says(spark):
    bases = ["https://h/a/b/c?q#f", "https://h", "https://h/a/", "https://h/a//b/./c"]
    links = ["x", "./x", "../x", "../../../x", "/../x", "/a/./b/../c", "..", ".", "../", "x/../y?z=../w#../v", "/x//y/", "?q", "#f", "", "//k/x/../y", "mailto:a", "http://k/../x", "a;p/../b", "x/.", "/"]
    frame = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in frame.select("b", "x", U.resolve(F.col("b"), F.col("x")).alias("to")).collect():
        if r.x not in ("//k/x/../y", "http://k/../x", "") and not (r.b == "https://h" and r.x[:1] in "?#"):
            assert r.to == urljoin(r.b, r.x), (r.b, r.x)


def test_frontier_form_as_the_standard_library(spark):
    urls = ["https://H/a;p=1/b;q?x=a%20b&y=c+d&z=&w&utm_source=1", "http://h/?a=%7E*%2a&b=ü", "https://h/a//", "https://h/x?ref=1", "ftp://h/x", "https://h/?q=a%2Fb&q=c", "https://h/?%75tm_source=1&a=1"]

    def form(url):
        p = urlparse(url)
        if p.scheme not in ("http", "https"):
            return ""
        kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in rules.TRACKING_KEYS]
        return urlunparse((p.scheme, p.netloc.lower(), p.path.rstrip("/") or "/", "", urlencode(kept), ""))

    out = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.frontier_form(F.col("u")).alias("f")).collect()
    assert {r.u: r.f for r in out} == {u: form(u) for u in urls}
    assert spark.range(1).select(U.is_asset(F.lit("https://h/a.PDF?x")), U.is_asset(F.lit("https://h/a.html"))).first() == (True, False)


@pytest.mark.parametrize("answer, share", [("1. CLEAN 2. junk", 0.5), ("nothing", None), (None, None), ("CLEAN", 1.0)])
def test_clean_share(spark, answer, share):
    assert spark.range(1).select(quality.clean_share(F.lit(answer).cast("string"))).first()[0] == share


def test_unescaped_and_valid(spark):
    got = spark.createDataFrame([("a &amp; b &eacute;",), (None,), ("x",)], "t string").select(T.unescaped(F.col("t"))).collect()
    assert [r[0] for r in got] == ["a & b é", None, "x"] and len(probe.PATHS) == 11
    valid = spark.createDataFrame([("u", "t", 11), ("", "t", 11), ("u", None, 11), ("u", "t", 10)], "u string, t string, w int").select(quality.is_valid(F.col("u"), F.col("t"), F.col("w"))).collect()
    assert [r[0] for r in valid] == [True, False, False, False]

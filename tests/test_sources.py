"""Fixtures for operators that the tables don't exercise."""

import json

import pytest

from docflow import cli
from docflow.operators import adaptive, cleaning, markdown_doc, parsers, pdf, seeds
from docflow.plans import crawl
from docflow.schema import BLOCK, CODE
from docflow.sources import probe, sitemap
from pyspark.sql import functions as F

URLSET = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def _urlset(*urls):
    return URLSET.format("".join(f"<url><loc> {u} </loc></url>" for u in urls))


def test_sitemap_index_within_prefix(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>https://h/a.xml</loc></sitemap><sitemap><loc>https://h/b.xml</loc></sitemap><sitemap><loc>https://h/sitemap.xml</loc></sitemap></sitemapindex>'
    files = [("https://h/sitemap.xml", index), ("https://h/a.xml", _urlset("https://h/docs/x", "https://h/fr/docs/x", "https://other/docs/y", "https://h/docs/i.png")), ("https://h/b.xml", "<broken"), ("https://h/c.xml", None)]
    out = sitemap.expand(spark.createDataFrame([("https://h/docs/home/", "https://h/sitemap.xml"), ("https://h/docs/", "https://h/none.xml")], "target string, sitemap string"), spark.createDataFrame(files, "url string, body string"))
    assert [(r.target, r.url) for r in out.collect()] == [("https://h/docs/home/", "https://h/docs/x")]


def test_sitemaps_without_and_with_a_budget(spark):
    """Forty sitemaps of one site, each an index of one file, which point back at each other; read to their end, or the first files only."""
    at = "https://maps.example/{}.xml".format
    index = "<sitemapindex>{}</sitemapindex>".format
    files = [(at(f"i{n}"), index("".join(f"<sitemap><loc>{at(u)}</loc></sitemap>" for u in (f"a{n}", f"i{(n + 1) % 40}")))) for n in range(40)]
    files += [(at(f"a{n}"), _urlset(f"https://h/p{n}", f"https://h/p{n}")) for n in range(40)] + [(None, "x"), ("https://m/none.xml", None)]
    targets = [("https://h/", at(f"i{n}")) for n in range(0, 40, 10)] + [("https://k/", None), (None, at("i1"))]
    frames = spark.createDataFrame(targets, "target string, sitemap string"), spark.createDataFrame(files, "url string, body string")
    whole = sitemap.expand(*frames).collect()
    assert sorted(r.url for r in whole) == sorted(2 * [f"https://h/p{n}" for n in range(40)])
    # four indexes, then of their children the two by position and name
    some = sorted(sitemap.expand(*frames, max_files=6).collect(), key=lambda r: r.ord)
    assert [r.url for r in some] == ["https://h/p0"] * 2 + ["https://h/p10"] * 2
    assert sitemap.expand(frames[0].limit(0), frames[1]).count() == 0


def test_version_roots(spark):
    body, target = _urlset("https://h/en/latest/", "https://h/en/stable/", "https://h/en/v1/", "https://h/en/v1/x/", "https://h/en/latest/"), "https://h/en/latest/"
    got = spark.createDataFrame([(body, target)], "b string, t string").select(sitemap.version_roots(F.col("b"), F.col("t")).alias("r")).first().r
    assert got == ["https://h/en/latest/", "https://h/en/stable/", "https://h/en/v1/"]
    urls = spark.createDataFrame([(target, u) for u in got] + [("https://h/a/b/", "https://h/a/b/c/")], "target string, url string")
    assert {r.target: r.roots for r in sitemap.all_version_roots(urls).collect()} == {target: True, "https://h/a/b/": False}


def test_robots_and_seed_files(spark):
    robots = spark.createDataFrame([("https://h/docs/", "User-agent: *\n Sitemap: https://h/s/sitemap1.xml\nSITEMAP: https://else/x.xml\n"), ("https://k/", None)], "start string, body string")
    maps = sitemap.robots_sitemaps(robots)
    assert {(r.start, r.sitemap) for r in maps.collect()} == {("https://h/docs/", "https://h/sitemap.xml"), ("https://h/docs/", "https://h/s/sitemap1.xml"), ("https://k/", "https://k/sitemap.xml")}
    files = [("https://h/s/sitemap1.xml", "<loc>https://h/sitemap2.xml</loc><LOC>https://h/docs/a?x=1&amp;y</LOC>"), ("https://h/sitemap2.xml", "<loc>https://h/docs/b.pdf</loc><loc>https://h/guide/c</loc>")]
    got = sitemap.seed_urls(maps, spark.createDataFrame(files, "url string, body string"))
    assert {(r.start, r.url) for r in got.collect()} == {("https://h/docs/", "https://h/docs/a"), ("https://h/docs/", "https://h/guide/c")}


def test_probe_order(spark):
    rows = [
        ("https://a", "sitemap_1", 200, "text/xml", "<urlset>", {}), ("https://a", "llms_2", 200, "text/plain; x", "t", {}), ("https://a", "llms_1", 200, "text/html", "t", {}),
        ("https://b", "openapi_2", 200, "application/json", '{"swagger": 1}', {}), ("https://b", "sitemap_1", 404, "", "<urlset>", {}), ("https://c", "homepage", 200, None, "", {"X-ReadTheDocs-Project": "p"}),
        ("https://d", "homepage", 200, None, '<div id="__docusaurus">', {}), ("https://e", "homepage", 200, None, "<p>", None),
    ]
    frame = spark.createDataFrame(rows, "base string, key string, status int, content_type string, body string, headers map<string,string>")
    got = {r.base: (r.type, r.url, r.framework) for r in probe.detect(frame).collect()}
    assert got == {
        "https://a": ("llms_txt", "https://a/.well-known/llms.txt", None), "https://b": ("openapi", "https://b/swagger.json", None),
        "https://c": ("framework", "https://c/", "readthedocs"), "https://d": ("framework", "https://d/", "docusaurus"),
    }
    assert probe.requests(frame.select("base").distinct()).count() == 55


def test_richer_llms_source(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [("https://h/llms.txt", words(350) + " [Full](/llms-full.txt) [self](#a)"), ("https://h/llms-full.txt", words(840) + " [x](/llms-full.txt#a)"), ("https://k/llms.txt", "[full](https://h/llms-full.txt)"), ("https://h/e.txt", None)]
    got = parsers.richer_sources(spark.createDataFrame(rows, "url string, content string")).collect()
    assert [tuple(r) for r in got] == [("https://h/llms.txt", "https://h/llms-full.txt")]


def test_api_parameters_and_responses(spark):
    spec = {"paths": {"/z": {"get": {"parameters": [{"name": "q", "in": "query", "required": True, "description": "d"}, {"in": "x"}, {"name": "r"}], "responses": {"200": {"description": "ok"}, "x": 1}}}, "/n": 3}}
    got = parsers.api_operations(spark.createDataFrame([(1, json.dumps(spec)), (2, "no"), (3, None)], "k int, body string"), "k", "body").collect()
    assert [(r.k, r.parameters, r.responses) for r in got] == [(1, ["q (query, required): d", "r (, optional)"], ["200: ok"])]


def test_seed_selection(spark):
    rows = [("s", f"u{i}", i) for i in range(1, 31)] + [("t", f"u{i}", i) for i in (21, 22)]
    ranked = spark.createDataFrame(rows, "start string, url string, rank int")
    live = spark.createDataFrame([("u2",), ("u5",), ("u5",), ("u25",)], "url string")
    pick = lambda **k: sorted((r.start, r.rank, r.verified) for r in seeds.select_live(ranked, live, **k).collect())
    assert pick(max_count=5, fallback=False) == [("s", 2, True), ("s", 5, True)]
    assert pick(max_count=1) == [("s", 2, True)] and pick(max_count=0) == []
    assert ("t", 21, False) in pick(max_count=25)


def test_urls_of_answers(spark):
    frame = spark.createDataFrame([('["https://h/a#x", "HTTPS://H/b?c"]', '{"results":[{"url":"https://h/p","n":{"LINK":"rel","t":"see https://k/q."}}]}', '<a href="//e.com/l/?uddg=https%3A%2F%2Fh%2Fd&amp;r=1"><a href="https://engine.com/x"><a href="https://z/">')], "a string, j string, h string")
    got = frame.select(seeds.urls_in_answer(F.col("a")).alias("a"), seeds.urls_in_answer(F.lit("try (https://h/z) now")).alias("f"), seeds.urls_in_json(F.col("j")).alias("j"), seeds.urls_in_result_page(F.col("h"), "engine.com").alias("h")).first()
    assert got.a == ["https://h/a", "https://h/b"] and got.f == ["https://h/z"] and set(got.j) == {"https://h/p", "rel", "https://k/q."} and got.h == ["https://h/d", "https://z/"]


def test_feedback_and_answers(spark):
    report = lambda **k: json.dumps(k)
    rows = [(1, report(failure_mode=" antibot ", confidence_score="1.7", permanent_fix_recommended=True)), (2, report(failure_mode="NEW")), (3, "[1]"), (4, None), (5, report(failure_mode="RATE_LIMITED", confidence_score="x"))]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k int, t string").select("k", adaptive.feedback_report(F.col("t")).alias("f")).collect()}
    assert got[1].failure_mode == "ANTIBOT" and got[1].confidence_score == 1.0 and got[1].permanent_fix_recommended and got[5].confidence_score == 0.0
    assert got[2] is None and got[3] is None and got[4] is None
    answers = ['{"message":{"content":"a"}}', '{"content":"b"}', '{"candidates":[{"content":{"parts":[{"text":"c"},{"text":"d"}]}}]}', "x", None]
    assert [r.t for r in spark.createDataFrame([(a,) for a in answers], "r string").select(adaptive.answer_text(F.col("r")).alias("t")).collect()] == ["a", "b", "cd", "", ""]


def test_script_output(spark):
    rows = [(0, "noise"), (1, '{"url":"https://h/a","content":"x\\n```py\\ny\\n```\\nz","metadata":{"depth":2}}'), (2, "[]"), (3, '{"title":"T"}')]
    got = adaptive.script_records(spark.createDataFrame(rows, "line_no int, value string")).orderBy("order_index").collect()
    assert [(r.order_index, r.title, r.depth, [b.text for b in r.content_blocks], len(r.code_blocks)) for r in got] == [(1, "Page 2", 2, ["x", "z"], 1), (3, "T", 0, [], 0)]


@pytest.mark.parametrize(
    ("state", "expected"),
    [
        (("framework", "SYNTAX_ERROR", False, 3, 4), ("script", "framework", False, 3, 4, True)),
        (("framework", "ANTIBOT", False, 3, 4), ("script", "framework", False, 3, 4, False)),
        (("sitemap", "RATE_LIMITED", False, 3, 4), ("crawl", None, False, 3, 4, False)),
        (("llms_txt", None, False, 3, 4), ("done", "llms_txt", False, 3, 4, False)),
        ((None, "RATE_LIMITED", False, 3, 4), ("crawl", None, False, 3, 1, False)),
        ((None, "EMPTY_CONTENT", False, 3, 4), ("crawl", None, True, 3, 4, False)),
        ((None, None, True, 3, 4), ("crawl", None, True, None, 4, False)),
        ((None, None, False, 3, 4), ("crawl", None, True, 3, 4, False)),
    ],
)
def test_correction(spark, state, expected):
    frame = spark.createDataFrame([state], "detection string, failure_mode string, include_sparse boolean, max_depth int, workers int")
    r = adaptive.corrected(frame).first()
    assert (r.phase, r.detection, r.include_sparse, r.max_depth, r.workers, r.uses_report) == expected


def test_phases_after_quality(spark):
    rows = [(True, 1.0, 5000, 9, None, 0), (False, 1.0, 1300, 1, None, 0), (False, 0.5, 10, 2, None, 0), (False, 0.5, 10, 2, "sitemap", 3), (False, 0.0, 0, 0, None, 1)]
    frame = spark.createDataFrame(rows, "passed boolean, structural double, words int, n_records int, detection string, retries int").withColumns({"include_sparse": F.lit(True), "max_depth": F.lit(None).cast("int")})
    out = adaptive.after_quality(frame)
    assert [(r.phase, r.retries, r.exhausted) for r in out.collect()] == [("done", 0, False), ("done", 0, False), ("feedback", 1, False), ("feedback", 3, True), ("failed", 1, False)]
    assert [r.phase for r in adaptive.after_feedback(out.where("phase = 'feedback'")).collect()] == ["correct", "done"]


def test_clean_records(spark):
    long = "p" * 45
    blocks = [{"type": "paragraph", "text": f" {long}​ "}, {"type": "paragraph", "text": long}, {"type": "paragraph", "text": "ok"}, {"type": "paragraph", "text": "ok"}, {"type": "list", "items": [" ", "e\u0301\n\u0303"]}, {"type": "table", "rows": [["", " "]]}, {"type": "code", "code_block_index": 0}, {"type": "heading", "level": 1}]
    frame = spark.createDataFrame([(1, " T\t", json.dumps(blocks), '[{"language":" ","text":"x\\u200b\\n"}]'), (2, None, "[]", None)], "k int, title string, b string, c string")
    frame = frame.select("k", "title", F.from_json("b", f"array<{BLOCK}>").alias("content_blocks"), F.from_json("c", f"array<{CODE}>").alias("code_blocks"), F.array().cast("array<string>").alias("errors"))
    one, two = cleaning.clean_records(frame).orderBy("k").collect()
    assert [b.type for b in one.content_blocks] == ["paragraph", "paragraph", "paragraph", "list", "code"] and one.content_blocks[3]["items"] == ["\u00e9\n\u0303"]
    assert one.title == "T" and one.code_blocks[0].language is None and one.code_blocks[0].text == "x\n" and one.errors == [] and two.errors == [cleaning.EMPTY_NOTE]


def test_markdown_document(spark):
    text = "---\ntitle: 'F'\n---\n# H *e*\n\np [l](../x \"t\") ![alt](i) `c*`\n\n- a\n  - b\n- c\n\n> q\n\n```py\nx\n```\n\n| a | b |\n|---|:-:|\n| 1 |\n\n<div>h</div>\n\nSet\n---\n"
    got = markdown_doc.extract(spark.createDataFrame([("https://h/d/my-file.md", text), ("https://h/my_file.md", None), (None, "x")], "url string, text string")).collect()
    assert got[0].title == "F" and got[1].title == "My File" and got[2].content_blocks[0].text == "x"
    assert [(b.type, b.text) for b in got[0].content_blocks] == [("heading", "H e"), ("paragraph", "p l alt `c*`"), ("list", ""), ("paragraph", "q"), ("code", ""), ("table", ""), ("paragraph", "h"), ("heading", "Set")]
    assert got[0].content_blocks[2]["items"] == ["a b", "c"] and got[0].content_blocks[5]["rows"] == [["a", "b"], ["1", ""]] and got[0].links == ["https://h/x"]
    assert [(c.language, c.text) for c in got[0].code_blocks] == [("py", "x\n")]


def test_markdown_bytes(spark):
    frame = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r.t for r in frame.select(markdown_doc.decoded("c").alias("t")).collect()] == ["é", "é"]


def _pdf(spark, density):
    box = [0.0, 0.0, 1.0, 1.0]
    rows = []
    for block, (text, font, size) in enumerate([("Intro", "Arial", 10.0), ("Part", "Arial", 25.0), ("Sub", "Arial", 25.0), ("body", "Arial", 10.0), ("x = 1", "Courier", 10.0), ("  ", "Arial", 99.0)]):
        rows.append((1, 0, block, 0, 0, text, font, size, box))
    rows.append((1, 1, 0, 0, 0, "covered", "Arial", 10.0, [5.0, 5.0, 6.0, 6.0]))
    spans = spark.createDataFrame(rows, "doc int, page int, block int, line int, span int, text string, font string, size double, box array<double>")
    tables = spark.createDataFrame([(1, 1, 0, [["a", None]], [4.0, 4.0, 5.0, 5.0]), (1, 0, 0, [["", ""]], box)], "doc int, page int, table int, rows array<array<string>>, box array<double>")
    docs = spark.createDataFrame([(1, "https://h/f.pdf", "F", density), (2, "https://h/g.pdf", "G", density)], "doc int, url string, title string, density string")
    links = spark.createDataFrame([(1, "https://z/"), (1, "mailto:x")], "doc int, uri string")
    return pdf.records(docs, pdf.page_blocks(spans, tables), links).orderBy("doc", "order_index").collect()


def test_pdf_records(spark):
    kinds = lambda r: [b.type for b in r.content_blocks]
    light = _pdf(spark, "light")
    assert len(light) == 2 and kinds(light[0]) == ["paragraph", "heading", "heading", "paragraph", "code", "table"] and light[0].code_blocks[0].text == "x = 1" and light[0].links == ["https://z/"]
    medium = _pdf(spark, "medium")
    assert [(r.title, r.url[-9:], kinds(r), r.breadcrumbs) for r in medium[:2]] == [("F", "section-1", ["paragraph"], []), ("Part", "section-2", ["heading", "paragraph", "code", "table"], ["F"])]
    assert medium[2].url == "https://h/g.pdf" and medium[1].content_blocks[2].code_block_index == 0 and medium[1].links == []
    dense = _pdf(spark, "dense")
    assert [(r.title, r.url[-6:], kinds(r)[-1:]) for r in dense[:2]] == [("Part", "page=1", ["code"]), ("F — Page 2", "page=2", ["table"])]


def test_crawl(spark, tmp_path, capsys):
    page = lambda title, body, *links: f"<title>{title}</title><main><h1>{title}</h1><p>{body}</p></main>" + "".join(f"<nav><a href='{u}'>l</a></nav>" for u in links)
    rows = [("https://h/docs/", page("Home", "start", "/docs/a", "/docs/b", "/docs/gone", "/blog/x")), ("https://h/docs/a", page("A", "one " * 60, "/docs/c")), ("https://h/docs/b", page("B", "two", "/docs/")), ("https://h/docs/c", page("A", "one " * 60)), ("https://h/docs/lone", page("L", "x"))]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = crawl.collect_records(pages, "https://h/docs/")
    assert [r.title for r in got.records.orderBy("depth", "path").collect()] == ["Home", "A", "B", "https://h/docs/gone"]
    s = crawl.statistics(got, max_depth=1).first()
    assert (s.pages, s.max_depth, s.failed, s.skipped_content, s.depth_capped) == (4, 1, 1, 1, True)
    assert crawl.collect_records(pages, "https://h/docs/", max_pages=2).decisions.count() == 2
    text = crawl.run_pipeline(pages, "https://h/docs/", max_depth=0).first().markdown
    assert text.startswith("# h Documentation\n\n## Home\n") and "\nstart\n" in text and "## A" not in text
    pages.write.parquet(str(tmp_path / "pages"))
    assert cli.main(["https://h/docs/", "--pages", str(tmp_path / "pages"), "--chunk-pages", "2", "-o", str(tmp_path / "out")], spark) == 0
    assert sorted(p.name for p in (tmp_path / "out").glob("name=*")) == ["name=out_part_001_of_002.md", "name=out_part_002_of_002.md"]
    assert cli.main(["https://h/docs/", "--pages", str(tmp_path / "pages"), "--seed-mode", "merge"], spark) == 0 and "## B" in capsys.readouterr().out
    assert cli.main(["https://h/", "--pages", "x", "--chunk-pages", "0"], spark) == 2


def test_streams(spark, tmp_path):
    from docflow.streaming import pages as stream

    rows = [("https://h/a", "<p>one two</p>", "2024-01-01 00:00:00"), ("https://h/a#x", "<p>three</p>", "2024-01-01 00:01:00"), ("https://k/b", "<h1>K</h1><p>w</p>", "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "url string, html string, t string").select("url", "html", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    source = lambda: stream.read(spark, str(tmp_path / "in"), "url string, html string, t timestamp", files_per_trigger=100)

    def run(frame, name, mode):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    assert len(run(stream.first_pages(source(), time_col="t", delay="1 hour"), "firsts", "append")) == 2
    assert {r.title for r in run(stream.records(source()), "records", "append")} >= {"K"}
    activity = run(stream.host_activity(source(), time_col="t", window="10 minutes", delay="1 minute"), "activity", "complete")
    assert sorted((r.host, r.pages, r.words) for r in activity) == [("h", 2, 3), ("k", 1, 2)]

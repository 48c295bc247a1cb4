from pyspark.sql import functions as F

from docflow.functions import html_signals as H, text as T, urls as U
from docflow.operators import cleaning, pdf, sections, seeds
from docflow.sources import sitemap


def _one(spark, column, **values):
    names = {k: ("string" if v is None or isinstance(v, str) else "int") for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in names.items())).select(column.alias("x")).first().x


def test_page_context_of_empty_pages(spark):
    rows = [("https://h/docs/", None), ("https://h/docs/e", ""), ("https://h/docs/a", '<A HREF="b?x=1#y">b</A><a href=\'b\'></a><a href="mailto:x@y">m</a><script src=//H/s.js></script><iframe src="/f"></iframe>')]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r.url: r for r in seeds.page_context(pages).collect()}
    assert [(got[u].title, got[u].headings, got[u].internal_links, got[u].network_urls) for u, _ in rows[:2]] == [("", [], [], [])] * 2
    assert (got["https://h/docs/a"].internal_links, got["https://h/docs/a"].script_urls, got["https://h/docs/a"].iframe_urls) == (["https://h/docs/b"], [], ["https://h/f"])


def test_page_context_with_observations(spark):
    pages = spark.createDataFrame([("https://h/docs/", "x"), ("https://h/docs/q", "x")], "url string, html string")
    seen = [("https://h/docs/", "network", "https://h/docs/a.mjs"), ("https://h/docs/", "network", "https://h/docs/b"), ("https://h/docs/", "interaction", "https://h/docs/c.mjs"), ("https://h/docs/", "interaction", None), ("https://h/docs/", "network", "https://else/docs/")]
    got = {r.url: (r.network_urls, r.interaction_urls) for r in seeds.page_context(pages, spark.createDataFrame(seen, "url string, kind string, found string")).collect()}
    assert got == {"https://h/docs/": (["https://h/docs/b"], ["https://h/docs/c.mjs"]), "https://h/docs/q": ([], [])}


def test_bulk_urls_keep_first_place(spark):
    locs = [(0, " https://h/1/b "), (1, "https://h/1/a.PNG"), (2, "https://H/1/a?q#f"), (3, "https://h/1/b"), (4, "https://g/1/c"), (5, "https://h/2/c"), (6, None)]
    got = sitemap.bulk_urls(spark.createDataFrame(locs, "pos int, url string"), F.lit("h"), "/1/", "/2/").collect()
    assert sorted((r.pos, r.url) for r in got) == [(0, "https://h/2/b"), (2, "https://H/2/a?q#f")]


def test_document_responses(spark):
    look = lambda status, url, kind: _one(spark, U.looks_like_document(F.col("s").cast("int"), F.col("u"), F.col("k"), F.lit("https://h/")), s=status, u=url, k=kind)
    assert [look(200, "https://H/a", None), look(None, "http://h/a", "TEXT/HTML"), look(399, "https://h", "text/plain;x"), look(400, "https://h/a", ""), look(200, "https://g/", ""), look(200, None, ""), look(200, "ftp://h/", ""), look(200, "https://h/", "image/png")] == [True] * 3 + [False] * 5


def test_pagination_sparse_and_titles(spark):
    assert [_one(spark, H.is_pagination(F.col("t")), t=t) for t in ("NEXT page", "Previous", None, "")] == [True, False, False, False]
    empty = F.array().cast("array<string>")
    assert [_one(spark, cleaning.is_sparse(*c), t="") for c in ((empty, empty), (F.lit(None).cast("array<string>"), empty), (empty, F.array(F.lit("x"))))] == [True, True, False]
    for text in ("v2x file", "o'neil", "ünder ground", "", "A-b3C"):
        assert _one(spark, T.title_case(F.col("t")), t=text) == text.title()
    assert _one(spark, pdf.title(F.col("u"), F.lit(None).cast("string")), u="https://h/x/my-v2x_file.pdf?q#f") == "My V2X File"


def test_sections_need_a_heading_with_text(spark):
    assert [_one(spark, sections.at_headings(F.col("t"), 2), t=t) for t in ("a\n## ", "", "a\n## b\nc\n## d", "### x")] == [[], [], ["a", "## b\nc", "## d"], []]


def test_page_context_of_pages_with_one_url(spark):
    pages = spark.createDataFrame([(1, "https://h/docs/", "x"), (2, "https://h/docs/", "y")], "id int, url string, html string")
    seen = spark.createDataFrame([(1, "https://h/docs/", "network", "https://h/docs/a"), (3, "https://h/docs/", "network", "https://h/docs/b")], "id int, url string, kind string, found string")
    assert {r.id: r.network_urls for r in seeds.page_context(pages, seen, "id").collect()} == {1: ["https://h/docs/a"], 2: []}


def test_html_extract_of_open_references_and_pages_with_one_url(spark, tmp_path):
    from docflow import queries
    from docflow.operators.html_record import page_record

    rows = [(1, "https://h/a", '<h1>R&amp;D &amp</h1><a href="/x?a=1&copy=2">x</a>'), (2, "https://h/a", '<h1>&quot;S&#x41;</h1><a href="/x?a=1&copy=2">x</a><a href="/y">y</a>'), (3, "https://h/b", "<h1>&ampx; & &</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.url, r.title, r.n_links) for r in queries.QUERIES["html_extract"](spark, str(tmp_path)).collect()}
    assert got == {("https://h/a", "R&D &amp", 2), ("https://h/a", '"SA', 2), ("https://h/b", "&ampx; & &", 0)}
    assert page_record(rows[0][2], "u")["title"] == "R&D &"


def test_render_chunks_of_many_pages_have_the_names_of_the_sql(spark, tmp_path):
    from docflow import queries
    from docflow.sources import markdown

    spark.range(49_951).select(F.col("id").alias("page_id")).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.markdown.split("\n")[0]: r.name for r in queries.QUERIES["render_chunks"](spark, str(tmp_path)).collect()}
    assert len(got) == 1000 and got["# Docs (Part 7 of 1000)"] == "docs_part_007_of_100.md" and got["# Docs (Part 1000 of 1000)"] == "docs_part_100_of_100.md"
    pages = spark.range(1001).select("id", F.lit("x").alias("section"))
    names = [r.name for r in markdown.chunk_documents(pages, arrival="id", order=["id"], section="section", title="T", prefix="p", pages=1).collect()]
    assert len(set(names)) == 1001 and "p_part_1001_of_1001.md" in names


def test_bundle_pages_keep_every_text(spark, tmp_path):
    from docflow import queries
    from docflow.operators import llms

    texts = [None, "", " \n", "\tx\t\n", "a\nURL: b\nDescription: c\nd", "Description: e\n\nf", "url: g", "h]"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.pos): (r.url, r.body) for r in queries.QUERIES["llms_bundle_pages"](spark, str(tmp_path)).collect()}
    assert got == {(n, pos): (f"https://h/{n}", t if t is None else t.strip(" \n")) for n, t in enumerate(texts) for pos in (0, 1)}
    bundle = '<page path="/a"><![CDATA[URL: https://h/x\nDescription: Only this\n]]></page><page path="/b"><![CDATA[URL: https://h/y\n\t\n]]></page>'
    records = llms.full_records(spark.createDataFrame([("https://h/f", bundle)], "url string, content string")).collect()
    assert [(r.url, r.content_blocks[0].text) for r in records] == [("https://h/x", "Only this")]


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_cleaned_without_python(spark, sf):
    from docflow import queries
    from docflow.schema import BLOCK, CODE

    assert "Eval" not in _plan(queries.QUERIES["clean_records"](spark, sf))
    text = "e\u0301" * 45
    block = (None, None, text, [text, None], [[text]], None)
    rows = [("e\u0301", [("paragraph", *block[1:]), ("paragraph", *block[1:]), ("list", *block[1:]), ("table", *block[1:]), ("code", *block[1:])], [("e\u0301", text)], None)]
    got = cleaning.clean_records(spark.createDataFrame(rows, f"title string, content_blocks array<{BLOCK}>, code_blocks array<{CODE}>, errors array<string>")).first()
    whole = "\xe9" * 45
    assert (got.title, got.code_blocks[0].language, got.code_blocks[0].text) == ("\xe9", "\xe9", whole) and [b.type for b in got.content_blocks] == ["paragraph", "list", "table", "code"]
    assert [b.text for b in got.content_blocks] == [whole] * 4 and got.content_blocks[1]["items"] == [whole] and got.content_blocks[2]["rows"] == [[whole]] and got.content_blocks[3]["items"] == [whole, None]


def test_sections_are_cut_once(spark):
    frame = spark.createDataFrame([(None,), ("",), ("## a\nb",), ("## a\n" + "### b\n\n" + "w  " * 2998 + "\n### c" * 7,), ("## a\n### b\n" + "w  " * 2900 + "\n### c" * 10,), ("## a\n" + "### b\n\n" + "w\u2003" * 2998 + "\n### c" * 10,)], "t string")
    out = frame.select(sections.sections(F.col("t")).alias("s"))
    assert [len(r.s) for r in out.collect()] == [0, 0, 1, 1, 1, 12] and _plan(out).count("(?=^#{2}") == 1 and _plan(out).count("(?=^#{3}") == 1


def test_prose_is_cleaned_without_python(spark, sf):
    from docflow import queries

    assert "Eval" not in _plan(queries.QUERIES["clean_prose"](spark, sf))
    texts = [None, "", "a", "e\u0301\x00\t b", "\u1112\u1161\u11ab \u3000"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_prose(F.col("t")).alias("p"), T.clean_code(F.col("t")).alias("c")).collect()
    assert [(r.p, r.c) for r in got] == [(None, None), ("", ""), ("a", "a"), ("\xe9 b", "\xe9\t b"), ("\ud55c", "\ud55c \u3000")]


def test_llms_files_are_cut_once(spark):
    from docflow.operators import llms

    out = llms.full_records(spark.createDataFrame([("u", "## a\nb"), ("v", "x <page y\nz"), ("w", '<page><![CDATA[c]]></page>')], "url string, content string"))
    assert sorted((r.source_url, r.title, [b.text for b in r.content_blocks]) for r in out.collect()) == [("u", "a", ["b"]), ("v", "x <page y", ["z"]), ("w", "Page 1", ["c"])]
    assert _plan(out).count("(?=^#{2}") == 1

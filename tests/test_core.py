import random

import duckdb
import pytest

from docflow import queries as core, site_queries  # noqa: F401  (the second registers its queries with the first)
from docflow.operators import dedup, frontier, render, sections
from pyspark.sql import functions as F

TABLES = ("pages", "documents", "conversations", "events", "labels")


def _rows(frame):
    names = sorted(frame.columns)
    clean = lambda v: None if v is None or v != v else round(v, 9) if isinstance(v, float) else v
    return sorted(repr(tuple(clean(v) for v in row)) for row in frame[names].astype(object).itertuples(index=False, name=None)), names


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"  # the scale at which results are compared, where hosts and sources have several pages
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    assert _rows(core.QUERIES[name](spark, sf).toPandas()) == _rows(con.execute(core.ORACLE_SQL[name]).df())


def test_crawl_records_has_no_depth_limit(spark, tmp_path):
    rows = [(n, core.START if n == 0 else f"{core.START}p{n}", f'<h1>P{n}</h1><p>Text of page {n}.</p><a href="/en/p{n + 1}">next</a>') for n in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.depth for r in core.QUERIES["crawl_records"](spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 4, 5]


def _sequential(rows):
    ones, twos, out = set(), set(), {}
    for order, one, two in sorted(rows):
        if one and one in ones:
            out[order] = "one"
        elif two in twos and two is not None:
            out[order] = "two"
        else:
            out[order] = "accepted"
            twos.add(two)
            if one:
                ones.add(one)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_two_keys_as_row_by_row(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, *"abcdef"]), rng.choice("uvwxyz") + str(rng.randrange(4))) for i in range(60)]
    got = dedup.first_of_two_keys(spark.createDataFrame(rows, "o int, one string, two string"), "o", "one", "two").collect()
    assert {r.o: r.decision for r in got} == _sequential(rows)


@pytest.mark.parametrize("seed", range(3, 6))
def test_two_keys_with_nulls(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["", None, *"abc"]), rng.choice([None, None, *"uvwx"])) for i in range(50)]
    got = dedup.first_of_two_keys(spark.createDataFrame(rows, "o int, one string, two string"), "o", "one", "two").collect()
    out = {r.o: r.decision for r in got}
    assert len(got) == 50 and out == _sequential(rows)


def test_two_keys_repeated_order_and_chain(spark):
    schema = "o int, one string, two string"
    rows = [(1, "a", "x"), (1, "a", "x"), (1, None, None), (None, "b", "y"), (2, "b", "z")]
    got = dedup.first_of_two_keys(spark.createDataFrame(rows, schema), "o", "one", "two").collect()
    assert sorted((r.o or 0, r.decision) for r in got) == [(0, "accepted"), (1, "accepted"), (1, "accepted"), (1, "one"), (2, "one")]
    chain = [(i, f"k{i // 2}", f"h{(i + 1) // 2}") for i in range(12)]
    got = dedup.first_of_two_keys(spark.createDataFrame(chain, schema), "o", "one", "two").collect()
    assert {r.o: r.decision for r in got} == _sequential(chain)
    assert dedup.first_of_two_keys(spark.createDataFrame([], schema), "o", "one", "two").count() == 0


def test_two_keys_counter_example(spark):
    rows = [(1, "c1", "h1"), (2, "c2", "h1"), (3, "c2", "h3"), (4, "c1", "h4"), (5, "c5", "h4")]
    got = dedup.first_of_two_keys(spark.createDataFrame(rows, "o int, one string, two string"), "o", "one", "two").collect()
    assert sorted(r.o for r in got if r.decision == "accepted") == [1, 3, 5]


def test_traversal(spark):
    edges = [(i, j) for i in range(40) for j in ((i + 1) % 40, (i * 7) % 40)] + [(None, 1), (3, None), (50, 51)]
    out = frontier.traverse(spark.createDataFrame([(0,), (0,), (None,)], "node int"), spark.createDataFrame(edges, "src int, dst int")).collect()
    level, depth = {0: 0}, 0
    while True:
        new = {b for a, b in edges if level.get(a) == depth and b is not None and b not in level}
        if not new:
            break
        depth += 1
        level |= dict.fromkeys(new, depth)
    assert len(out) == len(level) and {r.node: r.depth for r in out} == level


def test_composition(spark):
    from docflow.functions import text as T

    rows = [("plain",), ("e\u0301a",), (None,), ("",), ("\u212b",)]
    out = spark.createDataFrame(rows, "t string").select(T.nfc(F.col("t"))).collect()
    assert [r[0] for r in out] == ["plain", "\xe9a", None, "", "\xc5"]


def test_heading_levels(spark):
    got = spark.range(1).select(render.heading_levels(F.array(*map(F.lit, [2, 4, 3, 1]))).alias("x")).first().x
    assert got == [3, 4, 4, 3]


def test_long_sections_fall_to_third_level(spark):
    body = "## a\n\n" + "".join(f"### t{i}\n" + "w " * 420 + "\n" for i in range(10)) + "## b\nend"
    got = spark.createDataFrame([(body,)], "t string").select(F.size(sections.sections(F.col("t"))).alias("n")).first().n
    assert got >= 10


def test_table_and_code_rendering(spark):
    from docflow.schema import BLOCK, CODE

    frame = spark.sql(
        f"""select from_json('[{{"type":"table","rows":[["a","b"],["1","2"]]}},{{"type":"code","code_block_index":0}},{{"type":"code","code_block_index":7}}]', 'array<{BLOCK}>') b,
        from_json('[{{"language":"py","text":"x\\\\n"}}]', 'array<{CODE}>') c"""
    )
    text = frame.select(render.record_section(F.lit("u"), F.lit(None), F.lit("T"), F.array().cast("array<string>"), F.col("b"), F.col("c"), F.array().cast("array<string>")).alias("s")).first().s
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in text and "```py\nx\n```" in text and text.count("```") == 2


def test_page_record(spark):
    from docflow.operators.html_record import extract, page_record

    html = (
        "<title>T</title><link rel=canonical href='/c'><nav class=breadcrumb>Home / Docs</nav><main><h1>Head</h1><p>One <b>two</b><p>Three"
        "<ul><li>a<li>b</ul><table><tr><th>x<th>y<tr><td>1<td>2</table><pre><code class='language-py'>x = 1\n</code></pre><a href='p?q'>next</a></main><footer><p>f</p></footer>"
    )
    got = page_record(html + "<p>outside</p>", "https://h/d/e")
    kinds = [b["type"] for b in got["content_blocks"]]
    assert got["title"] == "Head" and got["canonical_url"] == "https://h/c" and got["links"] == ["https://h/d/p?q"] and got["breadcrumbs"] == ["Home", "Docs"]
    assert kinds[:6] == ["heading", "paragraph", "paragraph", "list", "table", "code"]
    assert got["content_blocks"][3]["items"] == ["a", "b"] and got["content_blocks"][4]["rows"] == [["x", "y"], ["1", "2"]]
    assert got["code_blocks"] == [{"language": "py", "text": "x = 1"}]
    frame = spark.createDataFrame([("https://h/", None), (None, "<div class=content><a href=a>A</a></div>")], "url string, html string")
    rows = extract(frame).collect()
    assert rows[0].title == "https://h/" and [b.type for b in rows[1].content_blocks] == ["heading", "list"]


def test_playbook(spark, tmp_path):
    from docflow.sources import playbook

    path = str(tmp_path / "p")
    rows = [(1.0, "d", "script", "fw", True, None, 3, 0, None, "x" * 30000), (2.0, "d", "script", "fw", False, None, 0, 1, "F", "no")]
    playbook.append(spark.createDataFrame(rows, playbook.SCHEMA), path)
    (tmp_path / "p" / "bad.json").write_text("not json\n")
    assert playbook.read(spark, path, "d").count() == 2 and playbook.read(spark, path, "e").count() == 0
    assert len(playbook.cached_script(playbook.read(spark, path), "d", "fw").first().script) == 20000

"""Main text of web pages, by differencing pages of near URLs.

A page is parsed into lines (blocks of text) with their place: in the article, elsewhere, or in chrome that its tags or names
give away (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Chrome goes at once. What
templates leave in pages without telling names is found by comparison: pages of a host are sorted by path, each page meets
the page before and after it, lines are aligned by longest common subsequence, and shared lines go.

Pages may be copies of each other, and then share their article too. So an alignment only counts if it covers less than
half of either page's lines, and it never takes lines inside an article element (article, main, or their roles), as articles may quote the
same passage; pages that have one are only aligned as neighbours of those that have none.

Lines that are on nearly all pages near each other are templates wherever they stand: a line goes, inside articles too, if it is on
SHARE per cent of the distinct pages of the host, or of the path's folder, and on AT_LEAST of them. Pages are distinct if their two longest
lines differ, so that copies of a page count once however many there are; a passage that articles quote is on fewer.

Hosts may be of any size: (host, path) is range-partitioned and sorted, only hashes of lines take part, and the pages at
the ends of a partition come to their neighbours through a table of two rows for each partition.

Alignment: equal lines are numbered by occurrence, so that a line matches one line of the other page; the longest increasing chain of matches
is the subsequence. It takes n log n steps for any number of lines.

Defined cases: a null or blank html gives an empty text; a null url is a host of its own. Pages that share a url are ordered by id and text.
Repeated rows each keep their result. Broken markup is read as far as it goes. Other columns pass by name.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docflow.llm.workspace import Workspace

#: Elements that hold no prose.
_SILENT = frozenset("head script style noscript template iframe object embed svg math canvas audio video map select option optgroup datalist textarea button dialog input label fieldset form".split())
#: Elements around the article.
_CHROME = frozenset("nav footer aside menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Elements that may be in a head; any other ends it.
_IN_HEAD = frozenset("head title meta link base script style noscript template".split())
#: Whole tokens of class and id that name chrome.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead topbar
    footer footnav copyright colophon sidebar sidenav rail widget widgets related recommended recirc cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
    signin login paywall comment comments commentlist discussion disqus respond replies reviews share sharing social toolbar pagination pager tags tagcloud toc skip search
    site-header page-header main-header global-header site-footer page-footer main-footer global-footer site-nav main-nav top-nav nav-bar nav-menu main-menu side-bar left-sidebar right-sidebar sidebar-left sidebar-right
    cookie-notice cookie-banner cookie-bar cookie-consent ad-banner ad-container ad-slot ad-unit share-buttons social-share social-links related-posts related-articles newsletter-signup comment-list comments-area search-form search-bar skip-link""".split()
)
#: Of these, the ones that never hold the main article, though they may hold articles of their own.
_OTHERS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo related recommended recirc related-posts related-articles comment comments commentlist comment-list comments-area discussion disqus respond replies reviews".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements whose open instance a new one ends, within the given bounds.
_ENDS_ITSELF = {"p": frozenset(), "li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"tr", "table"}), "th": frozenset({"tr", "table"}), "option": frozenset({"select"})}
#: Elements that can't be inside a paragraph.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript")}
_SPACE = re.compile(r"\s+")

ELSEWHERE, ARTICLE, _NAMED = 0, 1, 2
#: Distinct pages, and hundredths of a host's or folder's distinct pages, that make a line a template.
AT_LEAST, SHARE = 10, 90


def _hidden(attrs: dict[str, str]) -> bool:
    if attrs.get("role", "").strip().lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


def _chrome_names(attrs: dict[str, str]) -> set[str]:
    """The whole tokens of class and id that name chrome; camelCase and _ read as -."""
    tokens = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return _NAMES & set(re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", tokens).lower().replace("_", "-").split())


def page_lines(source: str | None, around: frozenset[int] = frozenset()) -> list[tuple[str, int]]:
    """(text, place) of each block outside chrome, in page order. If the page has an article or main element, only what is inside.

    Names are never held against an article, main or body element; if all articles of a page are in elements with such names, the names aren't
    held against these elements either, unless they are those of adverts, comments or related pages. ``around``: where elements begin that are inside
an article and hold another; a page in which they are found is read again with them."""
    source = source or ""
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, in chrome, in article (or one in an element with a name of chrome), in such an element
    buffer: list[str] = []
    within: list[tuple[int, int]] = []  # depth and place of the open named elements inside articles
    holding: set[int] = set()

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            inside = stack[-1][2] if stack else ELSEWHERE
            lines.append((text, inside))

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:  # a tag that never ends
            break
        at = m.end()
        if m["text"] is not None or m["cdata"] is not None:
            if stack and stack[-1][0] == "head" and (m["text"] or "").strip():
                _close(stack, "head", frozenset())
            if not _mute(stack):
                text = m["cdata"] if m["text"] is None else html.unescape(m["text"])
                buffer.append(text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if not m["end"]:
            if tag not in _INLINE:
                flush()
            if tag not in _IN_HEAD:
                _close(stack, "head", frozenset({"svg", "math"}))
            if tag in _VOID:
                if tag == "br":
                    buffer.append(" ")
                continue
            if tag in _ENDS_P:
                _close(stack, "p", frozenset({"article", "section", "div", "table", "td", "li", "blockquote", "main", "body"}))
            if tag in _ENDS_ITSELF and tag != "p":
                _close(stack, tag, _ENDS_ITSELF[tag])
            chrome, article, named = stack[-1][1:] if stack else (False, ELSEWHERE, False)
            attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"])}
            root = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody"
            names = set() if root or m.start() in around or tag in ("html", "body") else _chrome_names(attrs)
            hidden = _hidden(attrs) and tag not in ("html", "body")
            chrome_by_tag = tag in _SILENT or tag in _CHROME or (tag == "header" and not article) or hidden or bool(names & _OTHERS)
            chrome = chrome or chrome_by_tag or bool(names and article)
            named = named or bool(names)
            if tag in _RAW:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if m["attrs"].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            within = [x for x in within if x[0] < len(stack)]
            if names and article and not stack[-1][1] and not chrome_by_tag:
                within.append((len(stack), m.start()))
            if root and within:
                holding.update(start for _, start in within)
            if root and not chrome and not article:
                article = _NAMED if named else ARTICLE
            stack.append((tag, chrome, article, named))
        else:
            if tag not in _INLINE:
                flush()
            if tag == "br":
                buffer.append(" ")
            _close(stack, tag, frozenset())
    if source[at:] and not _mute(stack) and not source[at:].startswith("<"):
        buffer.append(html.unescape(source[at:]))
    flush()
    if holding:
        return page_lines(source, around | holding)
    found = {place for _, place in lines}
    best = next((place for place in (ARTICLE, _NAMED) if place in found), ELSEWHERE)
    return [(text, min(place, ARTICLE)) for text, place in lines if place == best]


def _mute(stack: list[tuple[str, bool, int, bool]]) -> bool:
    return bool(stack) and (stack[-1][1] or (stack[-1][3] and not stack[-1][2]))


def _close(stack: list[tuple[str, bool, int, bool]], tag: str, bounds: frozenset[str]) -> None:
    """Close the innermost open ``tag`` and what is open inside it, unless one of ``bounds`` is between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            del stack[i:]
            return
        if stack[i][0] in bounds:
            return


def shared_lines(one: list[int], other: list[int]) -> set[int]:
    """Positions in ``one`` of a longest common subsequence with ``other``, equal lines matched in order of occurrence."""

    def numbered(xs: list[int]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        out = []
        for x in xs:
            seen[x] = seen.get(x, 0) + 1
            out.append((x, seen[x]))
        return out

    where = {x: i for i, x in enumerate(numbered(other))}
    pairs = [(i, where[x]) for i, x in enumerate(numbered(one)) if x in where]
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            ends.append(n)
        else:
            tails[k], ends[k] = j, n
        before[n] = ends[k - 1] if k else -1
    found, n = set(), ends[-1] if ends else -1
    while n >= 0:
        found.add(pairs[n][0])
        n = before[n]
    return found


def dropped_lines(own: list[int], places: list[int], neighbours: list[list[int]]) -> list[int]:
    """Positions of lines that a neighbour shares, outside article elements."""
    if ELSEWHERE not in places:
        return []
    shared = []
    for other in neighbours:
        found = shared_lines(own, other)
        if found and 2 * len(found) < len(own) and 2 * len(found) < len(other):
            shared.append(found)
    if not shared:
        return []
    return sorted(i for i in set().union(*shared) if places[i] == ELSEWHERE)


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _line_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


_PARSED = "page_id long, url string, host string, path string, row long, lines array<string>, places array<int>, hashes array<long>, folder string, sig long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = page_lines(source)
            texts = [t for t, _ in lines]
            host, path = _host_path(url)
            longest = sorted(set(texts), key=lambda t: (-len(t), t))[:2]
            out.append((page, url, host, path, _line_hash(f"{url}\n{source}"), texts, [p for _, p in lines], [_line_hash(t) for t in texts], path.split("?")[0].rpartition("/")[0], _line_hash("\n".join(longest))))
        types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.string(), pa.int64())
        names = ["page_id", "url", "host", "path", "row", "lines", "places", "hashes", "folder", "sig"]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last page of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first:
        yield first
        yield last


def _differ(edges: list[tuple]):
    """edges: (sort key, hashes) of the first and last page of each partition, in order."""
    import collections

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: collections.deque = collections.deque(maxlen=3)
        out: list[tuple] = []

        def pages() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def settle(before, now, after) -> None:
            neighbours = [x[5] for x in (before, after) if x is not None and x[0] == now[0]]
            drop = dropped_lines(now[5], now[4], neighbours)
            if drop:
                out.append((now[2], now[3], drop))

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            got = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["id", "row", "drop"])
            out.clear()
            return got

        for page in pages():
            if not window:
                window.append(_beside(edges, page, -1))
            window.append(page)
            if len(window) == 3:
                settle(*window)
            if len(out) > 5000:
                yield batch()
        if window:
            settle(window[-2], window[-1], _beside(edges, window[-1], 1))
        yield batch()

    return run


def _sort_key(page: tuple) -> tuple:
    host, path, page_id, row = page[:4]
    return (host.encode(), path.encode(), page_id is not None, page_id or 0, row)


def _beside(edges: list[tuple], page: tuple, step: int) -> tuple | None:
    """The page before (-1) the first, or after (1) the last page of a partition."""
    keys = [e[0] for e in edges]
    at = bisect.bisect_left(keys, _sort_key(page)) - 1 if step < 0 else bisect.bisect_right(keys, _sort_key(page))
    return edges[at][1] if 0 <= at < len(edges) else None


def _templates(parsed: DataFrame, work: Workspace) -> DataFrame:
    """(host, folder, common): hashes of the lines that nearly all distinct pages of the host or folder share."""
    places = F.array(F.xxhash64("host"), F.xxhash64("host", "folder", F.lit(1)))
    rows = parsed.where("host <> '' and size(hashes) > 0").select("host", "folder", F.explode(places).alias("scope"), "sig", "hashes")
    pages = rows.select("scope", "sig").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= AT_LEAST)
    pages = work.save(pages)
    each = rows.join(pages.select("scope"), "scope", "left_semi").select("scope", "sig", F.explode(F.array_distinct("hashes")).alias("hash")).distinct()
    often = each.groupBy("scope", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= AT_LEAST)
    common = often.join(pages, "scope").where(F.col("n") * 100 >= F.col("pages") * SHARE).groupBy("scope").agg(F.collect_list("hash").alias("some"))
    scopes = parsed.select("host", "folder").distinct().select("host", "folder", F.explode(places).alias("scope"))
    return work.save(scopes.join(common, "scope").groupBy("host", "folder").agg(F.array_distinct(F.flatten(F.collect_list("some"))).alias("common")))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_dropped (lines that differencing removed)."""
    spark = pages.sparkSession
    work = Workspace(spark, "pagediff")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = work.save(source.mapInArrow(_parse, _PARSED))

    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = parsed.select("host", "path", "page_id", "row", "places", "hashes")
    keys = ("host", "path", "page_id", "row")
    ordered = work.checkpoint(slim.repartitionByRange(count, *keys).sortWithinPartitions(*keys))
    edges = [tuple(r) for r in ordered.mapInArrow(_ends, ordered.schema).toLocalIterator()]  # two rows a partition
    edges = sorted(((_sort_key(e), e) for e in edges), key=lambda x: x[0])
    drops = work.save(ordered.mapInArrow(_differ(edges), "id long, row long, drop array<int>").dropDuplicates(["id", "row"]))

    # only pages with lines outside articles can lose any by alignment; the saved tables of losses and templates have a known size, by which
    # Spark broadcasts them or shuffles both sides
    whole = ~F.array_contains("places", ELSEWHERE)
    kept = parsed.where(~whole).join(drops.withColumnRenamed("row", "drop_row"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("drop_row")), "left")
    kept = kept.select(*parsed.columns, "drop").union(parsed.where(whole).withColumn("drop", F.lit(None).cast("array<int>")))
    kept = kept.join(_templates(parsed, work), ["host", "folder"], "left")
    stays = F.filter(
        F.arrays_zip("lines", "hashes", F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))).alias("at")),
        lambda x: ~F.coalesce(F.array_contains("drop", x["at"]), F.lit(False)) & ~F.coalesce(F.array_contains("common", x["hashes"]), F.lit(False)),
    )
    remaining = F.when(F.col("drop").isNull() & F.col("common").isNull() | (F.size("lines") == 0), F.col("lines")).otherwise(F.transform(stays, lambda x: x["lines"]))
    kept = kept.select("page_id", "url", "lines", remaining.alias("left"))
    out = kept.select("page_id", "url", F.array_join("left", "\n").alias("text"), (F.size("lines") - F.size("left")).alias("n_dropped"))
    out = out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_dropped")
    return out.withColumnsRenamed({"page_id": id_col, "url": url_col})

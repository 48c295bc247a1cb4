"""Web pages as records: headings, paragraphs, lists, tables and code in page order, with links, canonical URL and breadcrumbs.

A page is read as a stream of tags with html.parser. One capture is open at a time and belongs to the element that opened it;
nested lists add to the outer item. The first reading takes content roots (main, article, content divs) only; a reading of the
whole page replaces it if it found nothing, or if it is sparse and the whole page isn't. Unlike the pipeline that these results
follow, unclosed paragraphs keep their text, and void tags don't disturb nesting.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docflow import rules

#: Fixed lists: chrome, roots, names, void elements.
CHROME = frozenset({"nav", "footer", "aside", "header", "script", "style", "noscript"})
CHROME_HINTS = frozenset({"cookie", "consent", "sidebar", "menu", "navbar", "footer"})
ROOTS = frozenset({"main", "article"})
ROOT_HINTS = frozenset({"content", "main", "docs", "documentation", "markdown", "prose", "readme", "body", "entry", "post"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
TEXT = {"p": "paragraph", "blockquote": "paragraph", "dt": "paragraph", "dd": "paragraph", "figcaption": "paragraph"} | {f"h{n}": "heading" for n in range(1, 7)}
SCHEMA = (
    "url string, canonical_url string, title string, content_blocks array<struct<type string, level int, text string, items array<string>, rows array<array<string>>, code_block_index int>>, "
    "code_blocks array<struct<language string, text string>>, links array<string>, breadcrumbs array<string>"
)

AMPERSAND = re.compile(r"&(?:([A-Za-z][A-Za-z0-9]*;)|#(?:[0-9]+|[xX][0-9A-Fa-f]+);)?")


def _closed_only(html: str) -> str:
    """``html`` in which an ampersand that begins no reference with a semicolon reads as itself."""
    return AMPERSAND.sub(lambda m: m[0] if m[1] in html5 or (m[1] is None and len(m[0]) > 1) else "&amp;" + m[0][1:], html)


def _squash(text: str) -> str:
    return " ".join(text.split())


class _Reader(HTMLParser):
    def __init__(self, url: str, everything: bool):
        super().__init__(convert_charrefs=True)
        self.base, self.everything = url, everything
        self.open: list[tuple[str, bool, bool]] = []  # tag, chrome, root
        self.blocks: list[dict] = []
        self.codes: list[dict] = []
        self.links: set[str] = set()
        self.anchors: dict[str, None] = {}
        self.crumbs: list[str] = []
        self.canonical = self.title = None
        self.capture: tuple[str, dict] | None = None
        self.buffer: list[str] = []
        self.label: tuple[str, list[str]] | None = None
        self.crumb: list[str] | None = None

    def inside(self) -> bool:
        return not self._chrome() and (self.everything or any(root for *_, root in self.open))

    def _chrome(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        names = set(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().replace("-", " ").replace("_", " ").split())
        if tag == "base" and attrs.get("href"):
            self.base = urljoin(self.base, attrs["href"])
        if tag == "link" and "canonical" in attrs.get("rel", "").lower().split() and attrs.get("href"):
            self.canonical = urljoin(self.base, attrs["href"])
        if tag == "a" and attrs.get("href"):
            link = urljoin(self.base, attrs["href"])
            self.links.add(link)
            self.label = (link, [])
        if "breadcrumb" in names or "breadcrumbs" in names or "breadcrumb" in attrs.get("aria-label", "").lower():
            self.crumb = []
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        root = tag in ROOTS or attrs.get("role") == "main" or (tag in ("div", "section") and not names.isdisjoint(ROOT_HINTS))
        chrome = self._chrome() or (not root and (tag in CHROME or not names.isdisjoint(CHROME_HINTS)))
        self.open.append((tag, chrome, root))
        if tag == "title":
            self._start(tag, {})
            return
        if not self.inside():
            return
        if tag in TEXT:
            self._start(tag, {"type": TEXT[tag], **({"level": int(tag[1])} if tag[0] == "h" else {})})
        elif tag == "pre" or (tag == "code" and self.capture and self.capture[0] == "pre"):
            language = next((n.split("-", 1)[1] for n in attrs.get("class", "").split() if n.startswith(("language-", "lang-"))), attrs.get("data-language"))
            if tag == "pre":
                self._start(tag, {"type": "code", "language": language})
            elif language:
                self.capture[1]["language"] = language
        elif tag in ("ul", "ol", "table") and not (self.capture and self.capture[0] in ("ul", "ol", "table")):
            self._start(tag, {"type": "table" if tag == "table" else "list", "depth": 1, "parts": []})
        elif self.capture and tag == self.capture[0]:
            self.capture[1]["depth"] += 1
        elif self.capture and tag in ("li", "td", "th", "tr") and self.capture[0] in ("ul", "ol", "table") and self.capture[1]["depth"] == 1:
            self._part(tag)

    def _part(self, tag: str) -> None:
        """An item, row or cell begins: what was read belongs to the one before."""
        parts = self.capture[1]["parts"]
        text = _squash("".join(self.buffer))
        self.buffer.clear()
        if self.capture[0] == "table":
            if parts and parts[-1] and parts[-1][-1] is None:
                parts[-1][-1] = text
            if tag == "tr" or not parts:
                parts.append([])
            if tag in ("td", "th"):
                parts[-1].append(None)
        else:
            if text and self.capture[1].get("begun"):
                parts.append(text)
            self.capture[1]["begun"] = True

    def _start(self, tag: str, block: dict) -> None:
        self._flush()
        self.capture = (tag, block)

    def _flush(self) -> None:
        if not self.capture:
            return
        tag, block = self.capture
        if tag in ("ul", "ol", "table"):
            self._part("")
        raw = "".join(self.buffer)
        self.buffer.clear()
        self.capture = None
        if tag == "title":
            self.title = self.title or _squash(raw)
        elif block["type"] == "code":
            if raw.strip():
                self.codes.append({"language": block["language"] or None, "text": raw.strip("\n")})
                self.blocks.append({"type": "code", "code_block_index": len(self.codes) - 1})
        elif block["type"] == "list":
            if block["parts"]:
                self.blocks.append({"type": "list", "items": block["parts"]})
        elif block["type"] == "table":
            rows = [[c or "" for c in row] for row in block["parts"] if row]
            if any(c for row in rows for c in row):
                self.blocks.append({"type": "table", "rows": rows})
        elif _squash(raw):
            self.blocks.append({**block, "text": _squash(raw)})

    def handle_endtag(self, tag):
        if tag == "a" and self.label:
            text = _squash("".join(self.label[1]))
            if text:
                self.anchors[f"[{text.replace('[', chr(92) + '[').replace(']', chr(92) + ']')}]({self.label[0]})"] = None
            self.label = None
        if self.crumb is not None and tag in ("nav", "ol", "ul", "div"):
            self.crumbs = self.crumbs or [c for c in (_squash(x) for x in "".join(self.crumb).split("/")) if c]
            self.crumb = None
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if self.capture and tag == self.capture[0]:
            depth = self.capture[1].get("depth", 1) - 1
            self.capture[1]["depth"] = depth
            if depth <= 0:
                self._flush()
        elif self.capture and any(t == self.capture[0] for t, *_ in self.open[at:]):
            self._flush()
        del self.open[at:]

    def handle_data(self, data):
        if self.label:
            self.label[1].append(data)
        if self.crumb is not None:
            self.crumb.append(data)
        if self.capture and (self.capture[0] == "title" or not self._chrome()):
            self.buffer.append(data)

    def done(self) -> _Reader:
        self.close()
        self._flush()
        return self

    def sparse(self) -> bool:
        prose = [x for b in self.blocks if b["type"] != "heading" for x in (b.get("text", ""), *b.get("items", ()), *(c for r in b.get("rows", ()) for c in r))]
        return len(_squash(" ".join([*prose, *(c["text"] for c in self.codes)]))) < rules.SPARSE_CHARS


def _read(html: str, url: str, everything: bool) -> _Reader:
    reader = _Reader(url, everything)
    reader.feed(html)
    return reader.done()


def page_record(html: str | None, url: str, closed_only: bool = False) -> dict:
    """The record of one page, with the fields of SCHEMA. Browsers also decode references without a semicolon; ``closed_only`` leaves these as written."""
    html = _closed_only(html) if closed_only and html else html
    reader = _read(html or "", url, False)
    if reader.sparse():
        whole = _read(html or "", url, True)
        if not reader.blocks or not whole.sparse():
            reader = whole
    blocks = list(reader.blocks)
    heading = next((b["text"] for b in blocks if b["type"] == "heading" and b["level"] == 1), None)
    if reader.sparse() and reader.anchors:
        blocks += [{"type": "heading", "level": 2, "text": "Discovered links"}, {"type": "list", "items": list(reader.anchors)}]
    full = [{k: b.get(k) for k in ("type", "level", "text", "items", "rows", "code_block_index")} for b in blocks]
    return {
        "url": url, "canonical_url": reader.canonical, "title": heading or reader.title or url, "content_blocks": full,
        "code_blocks": reader.codes, "links": sorted(reader.links), "breadcrumbs": reader.crumbs,
    }


def extract(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", closed_only: bool = False) -> DataFrame:
    """One record for each page; a page that can't be read is a record with its URL as title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame([page_record(h, u or "", closed_only) for u, h in zip(part["url"], part["html"], strict=True)])

    source = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInPandas(run, SCHEMA)

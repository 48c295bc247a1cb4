"""Markdown documents to records: front matter, blocks, and inline text.

Block structure needs a parser with state, so a batch of documents goes through Arrow. Reading is line by line and linear in the text; quotes and
lists deeper than ``MAX_NESTING`` are text. Nested list items join their outer item, quotes dissolve into the blocks they hold, raw HTML
becomes a paragraph of its text, and code inside a list item is left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docflow.operators.html_record import SCHEMA

MAX_NESTING = 20
FRONT_MATTER = re.compile(r"\A---\r?\n.*?\r?\n---\r?\n", re.S)
FRONT_TITLE = re.compile(r"(?m)^title:[ \t]*(.+?)[ \t]*\r?$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*)$")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_DIVIDER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|[!?]|/?[A-Za-z][A-Za-z0-9-]*(?:[ \t/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[([^\[\]]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+[\"'(].*)?$")
_INLINE = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)|(?P<image>!)?\[(?P<label>(?:[^\[\]\\]|\\.|!?\[[^\[\]]*\](?:\([^()\s]*\))?)*)\]"
    r"(?:\([ \t]*<?(?P<href>[^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)|\[(?P<ref>[^\[\]]*)\])?"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*)>|(?P<tag></?[A-Za-z][^<>]*>|<!--(?:(?!<!--).)*?-->)|(?P<hard> {2,}\n|\\\n)|(?P<run>\*+|_+|~~)",
    re.S,
)


class _Links:
    def __init__(self, base: str, definitions: dict[str, str]):
        self.base, self.definitions, self.found = base, definitions, set()

    def add(self, href: str) -> None:
        try:
            self.found.add(urljoin(self.base, html.unescape(href)))
        except ValueError:  # not a URL
            pass


def inline_text(text: str, links: _Links, depth: int = 0) -> str:
    """One line of text: emphasis and links give way to their content, code keeps its ticks, images leave their description."""
    parts: list[str] = []
    open_runs: dict[str, list[int]] = {}
    at = 0
    while found := _INLINE.search(text, at):
        parts.append(html.unescape(text[at : found.start()]))
        at = found.end()
        if found["escape"]:
            parts.append(found["escape"][1])
        elif found["ticks"]:
            close = re.compile(rf"(?<!`){found['ticks']}(?!`)").search(text, at)
            if close:
                parts.append(f"`{text[at : close.start()].strip()}`")
                at = close.end()
            else:
                parts.append(found["ticks"])
        elif found["label"] is not None:
            href = found["href"]
            if href is None:
                href = links.definitions.get((found["ref"] or found["label"]).strip().lower())
            if href is None:  # brackets without a target are text
                at = found.start() + (2 if found["image"] else 1)
                parts.append(text[found.start() : at])
            else:
                if href and not found["image"]:
                    links.add(href)
                parts.append(inline_text(found["label"], links, depth + 1) if depth < MAX_NESTING else found["label"])
        elif found["auto"]:
            links.add(found["auto"])
            parts.append(found["auto"])
        elif found["hard"]:
            parts.append(" ")
        elif found["run"]:
            run = found["run"]
            before, after = text[found.start() - 1 : found.start()], text[at : at + 1]
            opens, closes = bool(after.strip()), bool(before.strip())
            if run[0] == "_":
                opens, closes = opens and not before.isalnum(), closes and not after.isalnum()
            waiting = open_runs.setdefault(run, [])
            if closes and waiting:
                parts[waiting.pop()] = ""
                parts.append("")
            else:
                if opens:
                    waiting.append(len(parts))
                parts.append(run)
        # a tag leaves nothing
    parts.append(html.unescape(text[at:]))
    return " ".join("".join(parts).split())


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph before it."""
    fence = _FENCE.match(line)
    item = _ITEM.match(line)
    return bool(
        (fence and not (fence[2][0] == "`" and "`" in fence[3])) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line)
        or (item and line[item.end() :].strip() and (not item[2][0].isdigit() or item[2][:-1] == "1"))
    )


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def _nodes(lines: list[str], definitions: dict[str, str], depth: int = 0) -> list[tuple]:
    """The blocks of some lines: (kind, ...) with raw inline text; lists and quotes hold blocks of their own."""
    out: list[tuple] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif _indent(line) >= 4:
            start = i
            while i < n and (_indent(lines[i]) >= 4 or not lines[i].strip()):
                i += 1
            end = i
            while not lines[end - 1].strip():
                end -= 1
            out.append(("code", "", "\n".join(x[4:] for x in lines[start:end]) + "\n"))
        elif (m := _FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
            close, body, i = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$"), [], i + 1
            while i < n and not close.match(lines[i]):
                body.append(lines[i][min(_indent(lines[i]), len(m[1])) :])
                i += 1
            i += 1
            out.append(("code", m[3].strip(), "".join(x + "\n" for x in body)))
        elif m := _HEADING.match(line):
            out.append(("heading", len(m[1]), re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2])))
            i += 1
        elif _RULE.match(line):
            i += 1
        elif depth < MAX_NESTING and _QUOTE.match(line):
            inner: list[str] = []
            while i < n and lines[i].strip():
                if q := _QUOTE.match(lines[i]):
                    inner.append(lines[i][q.end() :])
                elif inner[-1].strip() and not _starts_block(lines[i]):
                    inner.append(lines[i])
                else:
                    break
                i += 1
            out.append(("quote", _nodes(inner, definitions, depth + 1)))
        elif depth < MAX_NESTING and (m := _ITEM.match(line)):
            kind, items = m[2][-1], []
            while i < n and (m := _ITEM.match(lines[i])) and m[2][-1] == kind and not _RULE.match(lines[i]):
                rest = lines[i][m.end() :]
                pad = len(m[3]) if rest.strip() and len(m[3]) <= 4 else 1
                width = len(m[1]) + len(m[2]) + pad
                inner = [" " * (len(m[3]) - pad) + rest if len(m[3]) > pad else rest]
                i += 1
                while i < n:
                    if not lines[i].strip():
                        following = next((x for x in lines[i + 1 : i + 2]), "")
                        if not following.strip() or _indent(following) < width:
                            break
                        inner.append("")
                    elif _indent(lines[i]) >= width:
                        inner.append(lines[i][width:])
                    elif inner[-1].strip() and not _starts_block(lines[i]) and not _ITEM.match(lines[i]):
                        inner.append(lines[i].lstrip())
                    else:
                        break
                    i += 1
                items.append(_nodes(inner, definitions, depth + 1))
                skip = i
                while skip < n and not lines[skip].strip():
                    skip += 1
                if skip < n and (m := _ITEM.match(lines[skip])) and m[2][-1] == kind and not _RULE.match(lines[skip]):
                    i = skip
            out.append(("list", items))
        elif _HTML.match(line):
            start = i
            comment = line.lstrip().startswith("<!--")
            while i < n and (("-->" not in lines[i]) if comment else bool(lines[i].strip())):
                i += 1
            i = min(n, i + 1) if comment else i
            out.append(("html", "\n".join(lines[start:i])))
        elif "|" in line and i + 1 < n and _DIVIDER.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
            head, rows, i = _cells(line), [], i + 2
            while i < n and lines[i].strip() and not _starts_block(lines[i]):
                cells = _cells(lines[i])
                rows.append((cells + [""] * len(head))[: len(head)])
                i += 1
            out.append(("table", [head, *rows]))
        else:
            start = i
            i += 1
            level = 0
            while i < n and lines[i].strip():
                if u := _UNDERLINE.match(lines[i]):
                    level = 1 if u[1][0] == "=" else 2
                    break
                if _starts_block(lines[i]):
                    break
                i += 1
            text = [x.lstrip() for x in lines[start:i]]
            i += 1 if level else 0
            while text and not level and (d := _DEFINITION.match(text[0])):
                definitions.setdefault(d[1].strip().lower(), d[2])
                text = text[1:]
            if text:
                out.append(("heading", level, "\n".join(text)) if level else ("paragraph", "\n".join(text).rstrip()))
    return out


def _inline_parts(nodes: list[tuple], links: _Links) -> Iterator[str]:
    for node in nodes:
        if node[0] in ("heading", "paragraph"):
            yield inline_text(node[-1], links)
        elif node[0] == "quote":
            yield from _inline_parts(node[1], links)
        elif node[0] == "list":
            for item in node[1]:
                yield from _inline_parts(item, links)
        elif node[0] == "table":
            for row in node[1]:
                for cell in row:
                    yield inline_text(cell, links)


def _without_tags(text: str) -> str:
    end = text.rfind(">") + 1  # after the last one no tag can close
    return re.sub(r"<[^>]+>", " ", text[:end]) + text[end:]


def _emit(nodes: list[tuple], blocks: list[dict], codes: list[dict], links: _Links) -> None:
    for node in nodes:
        kind = node[0]
        if kind in ("heading", "paragraph"):
            if text := inline_text(node[-1], links):
                blocks.append({"type": kind, "text": text} | ({"level": node[1]} if kind == "heading" else {}))
        elif kind == "quote":
            _emit(node[1], blocks, codes, links)
        elif kind == "list":
            items = [" ".join(p for p in _inline_parts(item, links) if p) for item in node[1]]
            if items := [x for x in items if x]:
                blocks.append({"type": "list", "text": "", "items": items})
        elif kind == "table":
            rows = [[inline_text(c, links) for c in row] for row in node[1]]
            if rows := [r for r in rows if any(r)]:
                blocks.append({"type": "table", "text": "", "rows": rows})
        elif kind == "code":
            blocks.append({"type": "code", "text": "", "code_block_index": len(codes)})
            codes.append({"language": node[1].split()[0] if node[1] else None, "text": node[2]})
        elif text := _without_tags(node[1]).strip():
            blocks.append({"type": "paragraph", "text": text})


def file_title(url: str, suffixes: tuple[str, ...] = (".md", ".markdown")) -> str:
    """A title from the file name of a URL."""
    try:
        name = urlsplit(url).path.rsplit("/", 1)[-1] or url
    except ValueError:
        name = url
    for suffix in suffixes:
        name = name.removesuffix(suffix)
    return name.replace("-", " ").replace("_", " ").strip().title() or url


def document_record(text: str | None, url: str) -> dict:
    """The record of one document: title from the front matter, else the first top heading, else the file name."""
    text = text or ""
    title = None
    if front := FRONT_MATTER.match(text):
        named = FRONT_TITLE.search(front[0])
        title = named[1].strip().strip('"').strip("'") if named else None
        text = text[front.end() :]
    definitions: dict[str, str] = {}
    nodes = _nodes([x.replace("\t", "    ") for x in re.split(r"\r\n?|\n", text)], definitions)
    links = _Links(url, definitions)
    blocks: list[dict] = []
    codes: list[dict] = []
    _emit(nodes, blocks, codes, links)
    heading = next((b["text"] for b in blocks if b["type"] == "heading" and b["level"] == 1), None)
    full = [{k: b.get(k) for k in ("type", "level", "text", "items", "rows", "code_block_index")} for b in blocks]
    return {"url": url, "canonical_url": None, "title": title or heading or file_title(url), "content_blocks": full, "code_blocks": codes, "links": sorted(links.found), "breadcrumbs": []}


def decoded(content: str) -> Column:
    """Text of a binary column: UTF-8, or else Latin-1."""
    return F.coalesce(F.expr(f"try_validate_utf8({content})"), F.decode(F.col(content), "ISO-8859-1"))


def extract(documents: DataFrame, *, url_col: str = "url", text_col: str = "text") -> DataFrame:
    """One record for each document, with the columns of a page's record. Null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                yield pd.DataFrame([document_record(t, u or "") for u, t in zip(part["url"], part["text"], strict=True)])

    source = documents.select(F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(run, SCHEMA)

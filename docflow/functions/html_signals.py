"""What seeds need of a page, by patterns only: no parser, no Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docflow import rules
from docflow.functions import text as T, urls as U

#: The five predefined entities and the blank; others stay as written.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain(fragment: Column) -> Column:
    out = F.regexp_replace(fragment, "<[^>]+>", " ")
    for name, value in _ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(value))
    return T.squash(out)


def title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), plain)
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, rules.MAX_HEADINGS)


def nav_labels(html: Column) -> Column:
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), plain)
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & x.rlike(f"(?i){rules.LABEL_HINTS}"))), 1, rules.MAX_NAV_LABELS)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?i)" + rules.LINK_PATTERN), F.lit(1))


def attribute_urls(html: Column, tag: str, attribute: str, base: Column) -> Column:
    """URLs that an attribute of a tag names, in the form of seeds, each once and sorted."""
    pattern = rf"(?i)<{tag}\b[^>]*\b{attribute}=['\"]([^'\"]+)['\"][^>]*>"
    found = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda u: U.seed_form(U.resolve(base, u)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: u != "")))


def is_pagination(label: Column) -> Column:
    """Whether the text of a control promises more content."""
    return U.contains_any(F.lower(F.coalesce(label, F.lit(""))), rules.PAGINATION_HINTS)

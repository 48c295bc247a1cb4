"""URL functions as native columns. A URL is cut by one pattern: scheme, authority, path, query, fragment."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docflow import rules

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
HTTP = r"^(?i:https?)://"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def domain(url: Column) -> Column:
    """Lower-cased authority (with port)."""
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def _http_or_empty(url: Column, value: Column) -> Column:
    return F.when(url.rlike(HTTP), value).otherwise("")


def frontier_form(url: Column) -> Column:
    """Of an absolute URL: scheme and host lower, no trailing slashes, no fragment, no parameters of the last segment (``;x``), no tracking keys.
    Queries are encoded anew, blank values included; a malformed escape stays as it is written."""
    slim = F.regexp_replace(F.regexp_replace(path(url), ";[^/]*$", ""), "/+$", "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    coded = lambda x: F.replace(F.replace(F.url_encode(decoded(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    keys = F.array(*(F.lit(k) for k in rules.TRACKING_KEYS))
    pairs = F.filter(F.split(F.substr(part(url, 4), F.lit(2)), "&"), lambda p: (p != "") & ~F.array_contains(keys, F.lower(decoded(F.regexp_extract(p, "^[^=]*", 0)))))
    pairs = F.transform(pairs, lambda p: F.concat(coded(F.regexp_extract(p, "^[^=]*", 0)), F.lit("="), coded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return _http_or_empty(url, F.concat(F.lower(part(url, 1)), F.lit("://"), domain(url), F.when(slim == "", "/").otherwise(slim), query))


def canonical_form(url: Column) -> Column:
    """Key of deduplication: no query, no fragment, no trailing slashes; empty for null and other schemes."""
    slim = F.regexp_replace(path(url), "/+$", "")
    return F.coalesce(_http_or_empty(url, F.concat(F.lower(part(url, 1)), F.lit("://"), domain(url), F.when(slim == "", "/").otherwise(slim))), F.lit(""))


def seed_form(url: Column) -> Column:
    """Key of seeds: as canonical, but the path as written."""
    return F.coalesce(_http_or_empty(url, F.concat(F.lower(part(url, 1)), F.lit("://"), domain(url), F.when(path(url) == "", "/").otherwise(path(url)))), F.lit(""))


def _join(base_path: Column, link_path: Column) -> Column:
    """The path of a link: its own if it begins with /, else from the base's folder, then without empty segments inside. ``.`` and ``..`` are resolved."""
    rooted = link_path.startswith("/")
    folder = F.when(rooted, F.array().cast("array<string>")).otherwise(F.split(F.regexp_extract(base_path, "^.*/", 0), "/"))
    every = F.concat(folder, F.split(link_path, "/"))
    inner = F.filter(every, lambda x, i: rooted | (x != "") | (i == 0) | (i == F.size(every) - 1))
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    last = F.when(F.element_at(inner, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    joined = F.array_join(F.concat(kept, last), "/")
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve(base: Column, link: Column) -> Column:
    """Absolute URL of a link on a page with an absolute URL. Links with a scheme or a host stay as they are."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    own = F.regexp_extract(link, "^[^?#]*", 0)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(root, path(base), link))
        .when(link.startswith("#"), F.concat(root, path(base), part(base, 4), link))
        .otherwise(F.concat(root, _join(path(base), own), F.substr(link, F.length(own) + 1)))
    )


def parent_path(p: Column) -> Column:
    """Folder of a path, between slashes."""
    pieces = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.when(F.size(pieces) <= 1, "/").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), "/"), F.lit("/")))


def sitemap_prefix(p: Column) -> Column:
    """Path prefix that a sitemap's pages must have, for a start path."""
    pieces = F.filter(F.split(F.lower(F.coalesce(p, F.lit(""))), "/"), lambda x: x != "")
    folders = F.when(F.try_element_at(pieces, F.lit(-1)).contains("."), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    at = F.array_position(folders, "docs").cast("int")
    after = F.get(folders, at)
    stop = (at > 0) & (after.isNull() | after.isin(*rules.PREFIX_STOPS))
    kept = F.when(stop, F.slice(folders, 1, at)).otherwise(folders)
    return F.when((F.size(pieces) == 0) | (F.size(kept) == 0), "/").otherwise(F.concat(F.lit("/"), F.array_join(kept, "/"), F.lit("/")))


def is_sitemap_file(url: Column) -> Column:
    leaf = F.lower(F.regexp_extract(path(url), "[^/]*$", 0))
    return leaf.endswith(".xml") & leaf.contains("sitemap")


def document_format(url: Column) -> Column:
    low = F.lower(path(url))
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".md") | low.endswith(".markdown"), "markdown").otherwise("html")


def is_asset(url: Column) -> Column:
    """Whether a URL's path names a file that is no page of documentation."""
    return ends_with_any(F.lower(path(url)), rules.NON_DOC_ASSETS)


def moved(url: Column, host: Column, old: str, new: str) -> Column:
    """A URL of ``host`` with the beginning ``old`` of its path replaced by ``new``; null for other hosts, other paths and files that are no pages."""
    target = F.concat(F.lit(new), F.substr(path(url), F.lit(len(old) + 1)))
    ours = (domain(url) == F.lower(host)) & path(url).startswith(old) & ~ends_with_any(F.lower(target), rules.BULK_ASSETS)
    return F.when(ours, F.concat(part(url, 1), F.lit("://"), part(url, 2), target, part(url, 4), part(url, 5)))


def ends_with_any(text: Column, suffixes: tuple[str, ...]) -> Column:
    return text.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for x in parts:
        found = found | text.contains(x)
    return found


def is_relevant(url: Column, start_url: str) -> Column:
    """Whether a crawl that starts at ``start_url`` follows ``url`` (both normalised)."""
    from urllib.parse import urlsplit

    start = urlsplit(start_url)
    start_path = start.path or "/"
    low = F.lower(path(url))
    allowed = (domain(url) == start.netloc.lower()) & url.rlike(HTTP) & ~ends_with_any(low, rules.ASSETS) & ~contains_any(low, rules.EXCLUDED_SIGNALS)
    if "/changelog" not in start_path.lower():
        allowed = allowed & ~low.contains("/changelog")
    under = low.isin("", "/") | low.startswith(start_path.rstrip("/") + "/")
    if any(x in start_path.lower() for x in rules.DOC_SIGNALS):
        return allowed & under
    return allowed & (under | contains_any(low, rules.DOC_SIGNALS))


def looks_like_document(status: Column, final_url: Column, content_type: Column, start: Column) -> Column:
    """Whether a response is a page of the start's host: no failure, and a type of text, or none. An unknown status is no failure."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.coalesce(status, F.lit(0)) < 400) & (seed_form(final_url) != "") & F.coalesce(domain(final_url) == domain(start), F.lit(False)) & ((kind == "") | contains_any(kind, rules.DOCUMENT_TYPES))


def is_viable_seed(url: Column, start: Column, blocked: tuple[str, ...] = rules.BLOCKED_SEEDS) -> Column:
    low, start_path = F.lower(path(url)), F.lower(F.regexp_replace(path(start), "/+$", ""))
    under = (start_path != "") & low.startswith(F.concat(start_path, F.lit("/")))
    return url.rlike(HTTP) & (domain(url) == domain(start)) & ~low.isin("", "/") & ~ends_with_any(low, blocked) & (under | contains_any(low, rules.DOC_HINTS))


def seed_score(url: Column, start: Column, blocked: tuple[str, ...] = rules.BLOCKED_SEEDS) -> Column:
    """Higher is better; ties go to the shorter path, then the smaller URL."""
    low, start_path = F.lower(path(url)), F.lower(F.regexp_replace(path(start), "/+$", ""))
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        points((start_path != "") & low.startswith(F.concat(start_path, F.lit("/"))), 6)
        + points(contains_any(low, rules.DOC_HINTS), 4)
        + points(low.endswith(".html"), 2)
        + points(low.endswith("/"), 1)
        - points(ends_with_any(low, blocked), 5)
    )

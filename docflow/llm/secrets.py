"""Secrets in texts: fixed patterns, and windows of high entropy. DataFrame functions only.

Patterns are matched leftmost and without overlap. Spark has no function for the offsets of matches, but a pattern that
never matches the empty string cuts a text into gaps (``split``) and matches (``regexp_extract_all``) that alternate, so running
sums of their lengths are the offsets.

The entropy search takes runs of key-like characters. A window slides over each run of a class (hexadecimal digits, or the
base-64 alphabet with a letter and a digit); counts of the window's characters, and the sum of n log n over them, are updated by the character
that enters and the one that leaves. Sums are of whole numbers (n log2 n in millionths), so that any order of
summing agrees. A run is reported whole if one window reaches the bound of its class and no allow rule
suppresses it: identifiers in UUID form, digests of empty input, placeholders, alphabets in order, words joined by separators.

Defined cases: a null text counts as empty, and a text without secrets has the digest of the empty string. Offsets are in code points, the end
exclusive. A text with n matches takes n ** 1.5 steps at most. A string that a pattern and the entropy search both find is listed under both kinds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed patterns; the value's group and the least length decide which matches count.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a match of AKIA[A-Z0-9]+ is a whole run, so its length can be in the pattern
HEX = r"[0-9a-f]{16,}"
ENTROPY_RUN = r"[A-Za-z0-9+/_=-]{20,}"

WINDOW = 20
#: Counts of up to 31 that a 64-bit word holds.
_PACKED = 12
#: Least entropy of a window, in millionths of a bit for each of its characters.
HEX_BOUND, BASE64_BOUND = 3_000_000, 3_700_000
_HEX_RUN = r"^[0-9a-fA-F]+$"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$",
    r"(?i)(example|placeholder|changeme|your[_-]?(api[_-]?)?key|xxxxx|abcdefghij|0123456789)",
    r"^([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$",
)


def matches(text: Column, pattern: str, kind: str, hint: str | None = None) -> Column:
    """array<struct<start, end, value>> of a pattern's matches; value: the whole match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    cut = F.arrays_zip(whole.alias("value"), F.slice(gaps, 1, F.size(whole)).alias("gap"))

    def placed(both: Column) -> Column:
        struct = lambda x, end: F.struct((end - F.length(x["value"])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.transform(both["cut"], lambda x, i: struct(x, F.get(both["ends"], i)))

    # arrays of one element, so that a text is split once and its sums are made once
    summed = F.transform(F.array(cut), lambda c: F.struct(c.alias("cut"), running_sums(F.transform(c, lambda x: F.length(x["gap"]) + F.length(x["value"]))).alias("ends")))
    none = F.expr("cast(array() as array<struct<start: int, kind: string, end: int, value: string>>)")
    return F.when(text.rlike(hint or pattern), F.transform(summed, placed)[0]).otherwise(none)


def running_sums(values: Column) -> Column:
    """array<int>: the sum of ``values`` up to each.

    Arrays can only grow by a copy, so the n values are summed in chunks of about their root: n ** 1.5 steps in all."""

    def scan(xs: Column, start: Column) -> Column:
        return F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def chunked(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda c: F.slice(xs, c * width + 1, width))

    def whole(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x))
        begun = F.transform(F.array(scan(sums, F.lit(0))), lambda starts: F.transform(chunks, lambda c, i: F.slice(scan(c, F.get(starts, i)), 2, F.size(c))))
        return F.flatten(begun[0])

    one = F.transform(F.array(values), lambda xs: F.when(F.size(xs) > 0, F.transform(F.array(chunked(xs)), whole)[0]).otherwise(F.array().cast("array<int>")))
    return one[0]


def _terms() -> Column:
    """n log2 n in millionths, at n + 1."""
    return F.array(*(F.lit(round(n * math.log2(n) * 1e6) if n else 0).cast("long") for n in range(WINDOW + 1)))


def _count(counts: Column, code: Column) -> Column:
    """How often a character is in the window."""
    return F.call_function("shiftrightunsigned", F.get(counts, F.floor(code / _PACKED).cast("int")), code % _PACKED * 5).bitwiseAND(F.lit(31).cast("long")).cast("int")


def _unit(code: Column, word: Column) -> Column:
    """One of a character in that word of the packed counts, if the character is counted there; 0 for -1."""
    here = F.floor(code / _PACKED).cast("int") == word
    return F.when(here & (code >= 0), F.call_function("shiftleft", F.lit(1).cast("long"), code % _PACKED * 5)).otherwise(F.lit(0).cast("long"))


def window_entropy(run: Column) -> Column:
    """The largest entropy of a window of WINDOW characters, times WINDOW, in millionths; null for shorter runs.

    The state is the count of each character code (packed, _PACKED to a word), the sum of n log2 n over them, and the smallest sum so far."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))

    def slide(both: Column) -> Column:
        steps = F.arrays_zip(both["codes"].alias("enters"), F.concat(F.array_repeat(F.lit(-1), WINDOW), both["codes"]).alias("leaves"))
        none = F.array_repeat(F.lit(0).cast("long"), -(-128 // _PACKED))
        start = F.struct(none.alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("seen"), F.lit(1 << 60).cast("long").alias("least"))

        def step(acc: Column, x: Column) -> Column:
            # of a character that enters and leaves at once, the count stays
            moved = x["enters"] != F.coalesce(x["leaves"], F.lit(-1))
            now = _count(acc["counts"], x["enters"])
            gone = F.when(x["leaves"] >= 0, _count(acc["counts"], x["leaves"]))
            total = acc["sum"] + F.when(
                moved,
                F.get(both["terms"], now + 1) - F.get(both["terms"], now) + F.coalesce(F.get(both["terms"], gone - 1) - F.get(both["terms"], gone), F.lit(0)),
            ).otherwise(0)
            counts = F.transform(acc["counts"], lambda n, i: n + _unit(x["enters"], i) - _unit(x["leaves"], i))
            seen = acc["seen"] + 1
            least = F.when((seen >= WINDOW) & (total < acc["least"]), total).otherwise(acc["least"])
            new = F.struct(counts.alias("counts"), total.cast("long").alias("sum"), seen.alias("seen"), least.alias("least"))
            return F.when(x["enters"].isNull(), acc).otherwise(new)

        return F.aggregate(steps, start, step, lambda acc: F.when(acc["seen"] >= WINDOW, F.lit(round(WINDOW * math.log2(WINDOW) * 1e6)) - acc["least"]))

    # one element, so that codes and terms are computed once for each run
    return F.transform(F.array(F.struct(codes.alias("codes"), _terms().alias("terms"))), slide)[0]


def entropy_matches(text: Column) -> Column:
    """Runs that hold a window of high entropy and are not allowed."""
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    runs = F.filter(matches(text, ENTROPY_RUN, "entropy"), lambda x: ~x["value"].rlike(allowed))
    bound = lambda v: F.when(v.rlike(_HEX_RUN), F.lit(HEX_BOUND * WINDOW)).otherwise(F.lit(BASE64_BOUND * WINDOW))
    return F.filter(runs, lambda x: window_entropy(x["value"]) >= bound(x["value"]))


def _ordered(spans: Column) -> Column:
    """kind:start:end, by start, then kinds in the order assign, access, hex, entropy."""
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with array columns assign, access, hex and entropy of struct<start, kind, end, value>."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, "assign", ASSIGN_HINT), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 12)
    return docs.withColumns({"assign": assign, "access": matches(text, ACCESS, "access"), "hex": matches(text, HEX, "hex"), "entropy": entropy_matches(text)})


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 and spans."""
    found = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), text_col="body")
    base = F.concat("assign", "access", "hex")
    return found.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_ordered(base), 256).alias("base_sha256"),
        _ordered(F.concat(base, F.col("entropy"))).alias("spans"),
    )

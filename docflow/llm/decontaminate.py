"""Benchmark passages in documents: SimHash of item-sized windows, then weighted shingle similarity. DataFrame functions only.

Texts are compared as words (letters and digits, lower case) in shingles of ``shingle_words``. A window has as many shingles
as the item it is compared with, or is the whole document if that has fewer. Similarity is the weighted Jaccard of the two
multisets of shingles, a shingle weighing as often as it occurs.

Which windows: at similarity s, a window shares at least s / (1 + s) of the shingles of both, and of all windows of one size the best can be moved
right to begin at a shared shingle (or to end with the document). So the windows that begin at a shingle of any item of their size, with enough such
shingles inside, hold a best window of every document and item; no other needs a fingerprint. Documents are first
searched for every g-th shingle only: a similar window lacks fewer shingles than it has among these, if g suits the items'
lengths (at 0.8, g is 5 for items of 9 words or more). A shingle meets the sizes of the items that hold it, not the items, so that a phrase that many items
and documents share makes rows in proportion to the documents.

Which items: each window gets a 64-bit SimHash, cut into BLOCKS blocks of bits. A fingerprint within the radius of another differs in at most
radius / BLOCKS bits of some block (radius 19: in 3 of 12 or 13). So an item is indexed, for each block, under all values that near, and a window looks up its own five: every
fingerprint of its size within the radius is found. The Hamming distance of the whole fingerprints, and then the exact similarity, decide.

At similarity 0.8 the angle of two multisets is 27 degrees at most, 9.6 of 64 bits differ on average, and more than 19 in
1 of 1000 pairs at that bound; equal passages have distance 0.

Defined cases: null, empty or blank texts and items match nothing; a text with fewer words than a shingle is one shingle.
Items that repeat each match. Rows that repeat an id give that id's best match. Null ids are kept apart from others, as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.llm.workspace import Workspace

BITS = 64
#: Blocks of the multi-index.
BLOCKS = 5


def shingles(text: Column, k: int, stride: int = 1) -> Column:
    """array<bigint>: hashes of every ``stride``-th k-word shingle in order; of all words together if there are fewer than
    k; null without words."""
    clean = F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    one = F.array(F.split(clean, " "))  # one element, so that the words are split once and not for each shingle
    rolled = F.transform(
        one,
        lambda w: F.when(F.size(w) < k, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)), F.lit(stride)), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))
        ),
    )[0]
    return F.when(clean != "", rolled)


def simhash(window: Column) -> Column:
    """64-bit fingerprint of an array of hashes: each bit as most of the hashes have it.

    16 words count four bits each, in 16 bits that hold up to 65,535 hashes; longer arrays are counted bit by bit."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    add = lambda acc, h: F.transform(acc, lambda x, j: x + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(0x0001000100010001)))
    words = F.aggregate(window, F.array_repeat(zero, 16), add)

    def whole(counts: Column) -> Column:
        total = zero
        for b in range(BITS):
            ones = F.shiftrightunsigned(F.get(counts, b % 16), 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF).cast("long"))
            total = total.bitwiseOR(F.when(ones * 2 > F.size(window), F.shiftleft(one, b)).otherwise(zero))
        return total

    def plain() -> Column:
        bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(F.size(F.filter(window, lambda h: F.call_function("shiftrightunsigned", h, b).bitwiseAND(one) == 1)) * 2 > F.size(window), F.call_function("shiftleft", one, b)).otherwise(zero))
        return F.aggregate(bits, zero, lambda acc, x: acc.bitwiseOR(x))

    # one element, so that the words are counted once and not for each bit
    return F.when(F.size(window) > 0xFFFF, plain()).otherwise(F.transform(F.array(words), whole)[0])


def _blocks(fingerprint: Column, within: int = 0) -> Column:
    """array<struct<block, value>>: the fingerprint cut into BLOCKS runs of bits, each with all values that differ in up to ``within`` bits."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]

    def near(i: int, lo: int, hi: int) -> Column:
        own = F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
        changes = F.expr(f"filter(sequence(0L, {(1 << (hi - lo)) - 1}L), x -> bit_count(x) <= {int(within)})") if within else F.array(F.lit(0).cast("long"))
        return F.transform(changes, lambda x: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(x).alias("value")))

    return F.concat(*(near(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))))


def _common(window: Column, item: Column) -> Column:
    """Sum of the smaller multiplicities."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(item, window), F.lit(0), lambda acc, x: acc + F.least(count(item, x), count(window, x)))


def _needed(n: int, m: int, percent: int) -> int:
    """Shingles that multisets of n and m must share to be so similar."""
    return -(-percent * (n + m) // (100 + percent))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    radius: int = 19,
) -> DataFrame:
    """(id, item, similarity, start): the best window of each document and item that are at least ``percent`` similar.

    start: the window's first word, from 0; of equally similar windows, the first that begins at a shingle of an item of its size or ends the document."""
    scored = _scored(docs, benchmark, id_col, text_col, item_col, item_text_col, shingle_words, percent, radius)
    best = scored.groupBy("id", "item").agg(F.max("similarity").alias("similarity"), F.max_by("start", F.struct("similarity", -F.col("start"))).alias("start"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start")


def _row_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _scored(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, shingle_words: int, percent: int, radius: int
) -> DataFrame:
    """(id, row_hash, item, similarity, start, ...) of all windows and items that are similar enough."""
    k = int(shingle_words)
    items = benchmark.select(F.col(item_col).alias("item"), shingles(F.col(item_text_col), k).alias("item_shingles")).where("item_shingles is not null")
    items = items.withColumn("item_size", F.size("item_shingles"))
    wanted = items.select("item_size", F.explode(F.array_distinct("item_shingles")).alias("shingle")).distinct()

    sizes = [r["item_size"] for r in items.select("item_size").distinct().collect()]  # lengths, not items
    whole = range(1, max(sizes, default=0) + 1)  # documents shorter than an item are one window
    stride = max(
        (g for g in range(1, k + 1) if all(n // g > n - _needed(n, n, int(percent)) for n in sizes) and all(-(-n // g) > n - _needed(n, n, int(percent)) for n in whole)),
        default=1,
    )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    texts = texts.withColumn("row_hash", _row_hash(F.col("body")))
    spread = texts.select("id", "row_hash", F.explode(shingles(F.col("body"), k, stride)).alias("shingle"))
    near = spread.join(wanted.select("shingle").distinct(), "shingle").groupBy("id", "row_hash").agg(F.count(F.lit(1)).alias("hits"))
    # the texts of these only: a table of ids that is measured to be small is broadcast, else both sides are shuffled
    own = texts.select(F.col("id").alias("own"), F.col("row_hash").alias("own_hash"), "body")
    met = near.join(own, F.col("id").eqNullSafe(F.col("own")) & (F.col("row_hash") == F.col("own_hash"))).select("id", "row_hash", "body").distinct()
    work = Workspace(docs.sparkSession, "decontaminate")
    hashed = work.save(met.select("id", "row_hash", shingles(F.col("body"), k).alias("shingles")))

    placed = hashed.select("id", "row_hash", F.size("shingles").alias("doc_size"), F.posexplode("shingles").alias("at", "shingle"))
    seeds = placed.join(wanted, "shingle").groupBy("id", "row_hash", "item_size", "doc_size").agg(F.sort_array(F.collect_set("at")).alias("at"))

    width = F.least("item_size", "doc_size")
    need = F.ceil(F.lit(int(percent)) * (F.col("item_size") + width) / F.lit(100.0 + int(percent)) - 1e-9).cast("int")
    starts = F.filter(
        F.transform("at", lambda p, i: F.when(F.get(F.col("at"), i + F.col("need") - 1) < p + F.col("width"), F.least(p, F.col("doc_size") - F.col("width")))),
        lambda s: s.isNotNull(),
    )
    seeds = seeds.withColumn("width", width).withColumn("need", need)
    windows = seeds.select("id", "row_hash", "item_size", "width", F.explode(F.array_distinct(starts)).alias("start"))
    grouped = windows.groupBy("id", "row_hash").agg(F.collect_list(F.struct("item_size", "width", "start")).alias("windows"))  # of one document
    again = hashed.select(F.col("id").alias("own"), F.col("row_hash").alias("own_hash"), "shingles")
    found = grouped.join(again, F.col("id").eqNullSafe(F.col("own")) & (F.col("row_hash") == F.col("own_hash")))
    cut = F.transform("windows", lambda w: F.struct(w["item_size"].alias("item_size"), w["start"].alias("start"), F.slice(F.col("shingles"), w["start"] + 1, w["width"]).alias("window")))
    cut = found.select("id", "row_hash", F.explode(cut).alias("w")).select("id", "row_hash", "w.item_size", "w.start", "w.window")

    left = cut.withColumn("fingerprint", simhash(F.col("window")))
    left = left.withColumn("b", F.explode(_blocks(F.col("fingerprint")))).select("*", "b.block", "b.value").drop("b")
    named = items.select("item", "item_size", "item_shingles").distinct().withColumn("item_row", F.xxhash64("item", "item_shingles"))
    named = work.save(named.withColumn("item_print", simhash(F.col("item_shingles"))))
    right = named.select("item_row", "item_print", "item_size", F.explode(_blocks(F.col("item_print"), radius // BLOCKS)).alias("b"))
    right = work.save(right.select("item_row", "item_print", "item_size", "b.block", "b.value"))
    met = left.join(right, ["item_size", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
    met = met.select("id", "row_hash", "item_row", "start", "window").distinct().join(named.select("item_row", "item", "item_shingles"), "item_row")

    common = _common(F.col("window"), F.col("item_shingles"))
    scored = met.withColumn("common", common).withColumn("total", F.size("window") + F.size("item_shingles") - F.col("common"))
    return scored.where(F.col("common") * 100 >= F.col("total") * int(percent)).withColumn("similarity", F.col("common") / F.col("total"))


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    radius: int = 19,
) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item, whatever other rows have their id; all columns stay."""
    scored = _scored(docs, benchmark, id_col, text_col, item_col, item_text_col, shingle_words, percent, radius)
    found = scored.select(F.col("id").alias("_found"), F.col("row_hash").alias("_found_hash")).distinct()
    same = docs[id_col].eqNullSafe(found["_found"]) & (_row_hash(docs[text_col].cast("string")) == found["_found_hash"])
    return docs.join(found, same, "left_anti")

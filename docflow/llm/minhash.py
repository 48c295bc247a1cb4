"""Near-duplicate documents by circulant MinHash.

Two permutations of the 32-bit integers make every coordinate of a signature: sigma scatters a shingle once, and
coordinate k is the minimum of pi over the scattered shingles shifted by k places around the circle (Li and Li, C-MinHash,
2021). Bands of coordinates propose pairs, and exact Jaccard similarity of the full shingle sets decides.

Rows with equal shingle sets are one class and count as one candidate. Classes that share a band are compared in rounds:
with the smallest class of their bands, with another member of each band that still holds several components, and last
with every member of another component in these bands: pair by pair in bands of up to PAIRED members, and in larger ones by
products of shingle matrices over blocks of members, which emit one link for each component they join and no pairs. Blocks are those of one band, or
of all members that overlapping bands connect where these make fewer pairs. A pair that shares a band is thus compared, or already connected; neither the size of a band nor the number of its pairs is capped. At the default 45 bands of 6, a pair of similarity
0.8 shares no band with a probability of 1e-6.

Defined cases: a null or blank text has an empty set and is linked with nothing; a row without id can't stand for a
class and has the component of the rows that share its set, or null. An id on several rows is one node. Ties go to the
smallest id. Ids are integers; a text that isn't one stops the job with Spark's cast error. Columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docflow.llm.graph import connected_components, spanning_edges
from docflow.llm.words import mix64, shingle_sets, word_chunks
from docflow.llm.workspace import Workspace

_SET_SEED = np.uint64(0xD6E8FEB86659FD93)
_SIGMA = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
_PI = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_BLOCK = 512
#: Bands of more open members are compared in blocks of BLOCK_ROWS texts.
PAIRED, BLOCK_ROWS = 24, 128
#: Rows of one band that a task joins at once; parts in which the rows of any cluster are dealt out.
SALTED, SALTS = 512, 32
_COLUMNS = 4096


def _permute(x: np.ndarray, factors: tuple[np.uint32, np.uint32], spare: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers, in place."""
    for shift, factor in ((16, factors[0]), (13, factors[1])):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, factor, out=x)
    np.right_shift(x, np.uint32(16), out=spare)
    return np.bitwise_xor(x, spare, out=x)


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash coordinates of a set of 64-bit hashes, by two permutations and circular shifts."""
    signature = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    shifts = (np.arange(size, dtype=np.uint64) * np.uint64((1 << 32) // size)).astype(np.uint32)[:, None]
    for at in range(0, len(shingles), _BLOCK):
        base = (shingles[at : at + _BLOCK] >> np.uint64(32)).astype(np.uint32)
        base = _permute(base, _SIGMA, np.empty_like(base))
        circle = base[None, :] + shifts
        np.minimum(signature, _permute(circle, _PI, np.empty_like(circle)).min(axis=1), out=signature)
    return signature


def _sums(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return int(mix64(own).sum(dtype=np.uint64).astype(np.int64)), int(mix64(own ^ _SET_SEED).sum(dtype=np.uint64).astype(np.int64))


def signature_batches(words: int, bands: int, rows: int):
    """A ``mapInArrow`` function: (id, text, text_hash) -> (id, n, f1, f2, bands, text_hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2 = [], [], []
            signatures = np.zeros((batch.num_rows, bands * rows), dtype=np.uint32)
            for chunk in word_chunks(batch.column(1)):
                for i, own in enumerate(shingle_sets(chunk, words), chunk.first):
                    n.append(len(own))
                    one, two = _sums(own)
                    f1.append(one)
                    f2.append(two)
                    if len(own):
                        signatures[i] = circulant_signature(own, bands * rows)
            cubes = signatures.reshape(-1, bands, rows).astype(np.uint64)
            keys = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), cubes.shape[:2])
            for j in range(rows):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + cubes[:, :, j])
            flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), lists, batch.column(2)], ["id", "n", "f1", "f2", "bands", "text_hash"]
            )

    return run


def jaccard_batches(words: int):
    """A ``mapInArrow`` function: (a, b, text_a, text_b) -> (a, b, common, total), the sizes of intersection and union."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [own for chunk in word_chunks(column) for own in shingle_sets(chunk, words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # the sets of a few rows at a time
                part = batch.slice(at, 256)
                left, right = sets(part.column(2)), sets(part.column(3))
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
                total = [len(x) + len(y) - c for x, y, c in zip(left, right, common, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, number, often = np.unique(flat, return_inverse=True, return_counts=True)
    several = often[number] > 1
    number, owner = np.unique(number[several], return_inverse=True)[1], owner[several]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(left), len(right)))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, _COLUMNS):
        a, b = np.searchsorted(number, [lo, lo + _COLUMNS])
        held = np.zeros((len(left) + len(right), _COLUMNS), dtype=np.float32)
        held[owner[a:b], number[a:b] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def block_batches(words: int, percent: int):
    """A ``mapInArrow`` function over rows sorted by their first three: (group, block_a, block_b, block, id, label, text)
    -> (a, b), links that connect all components which similar texts of the two blocks connect."""

    def linked(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        _, one, two = rows[0][:3]
        sets = [own for chunk in word_chunks(pa.array([r[6] for r in rows], pa.string())) for own in shingle_sets(chunk, words)]
        block, label = np.array([r[3] for r in rows]), np.array([r[5] for r in rows])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if not len(left) or not len(right):
            return
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(x) for x in sets])
        close = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
        close &= label[left][:, None] != label[right][None, :]
        ids = np.array([r[4] for r in rows])
        yield from spanning_edges(close, ids[left], ids[right], one == two)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:3] != row[:3]:
                    found += linked(held)
                    held = []
                held.append(row)
        if held:
            found += linked(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 45, rows: int = 6
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    ``percent``: least Jaccard similarity of linked texts, in hundredths. component_id: the smallest id that links reach.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = _components(source, Workspace(docs.sparkSession, "minhash"), shingle_words, percent, bands, rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _components(source: DataFrame, work: Workspace, shingle_words: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(id, n, component, text_hash) of each row of ``source`` (id, text)."""
    hashed = source.select("id", "text", _text_hash(F.col("text")).alias("text_hash"))
    signed = work.save(hashed.mapInArrow(signature_batches(shingle_words, bands, rows), "id long, n long, f1 long, f2 long, bands array<long>, text_hash long"))

    filled = signed.where("n > 0")
    classes = work.save(filled.where("id is not null").groupBy("f1", "f2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.first("bands").alias("bands")))
    banded = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("centre")).where("size > 1")
    members = work.save(banded.join(shared, "key").select("key", "id", "n", "centre", "size"))
    links = _links(source, members, work, shingle_words, percent)

    found = connected_components(links, work)
    labels = classes.select("f1", "f2", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "f1", "f2", "text_hash").join(labels, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", "n", component.alias("component"), "text_hash")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _beside(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """``rows`` (key, id, size, ...) with what ``bands`` (key, size, ...) holds once for each key; the rows of a large band are dealt out."""
    count = F.expr(f"int(ceil(size / {SALTED}))")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("id"), count).cast("int"))
    right = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("size")
    return left.join(right, ["key", "salt"]).drop("salt")


def _links(source: DataFrame, members: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) that connect all that share a band and are similar enough."""
    texts = work.save(source.join(members.select("id").distinct(), "id", "left_semi"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        sized = both.mapInArrow(jaccard_batches(words), "a long, b long, common long, total long")
        return work.save(sized.withColumn("linked", F.expr(f"100 * common >= {int(percent)} * total")))

    # no pair outside these sizes can reach the similarity
    fits = F.expr(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)")

    first = members.where("id <> centre").groupBy("id").agg(F.min("centre").alias("b")).select(F.col("id").alias("a"), "b")
    tried = verified(first)
    links = tried.where("linked").select("a", "b")

    label = None
    for full in (False, True):
        if label is None or not fresh.where("linked").isEmpty():
            label = connected_components(links, work).withColumnRenamed("node", "id")
        labelled = members.select("key", "id", "n", "size").join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
        pick = F.min(F.struct(F.expr("xxhash64(id, key)"), "id", "n", "label")).alias("pick")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), pick, F.max("size").alias("size"))
        open_bands = mixed.where("low <> high").select("key", "pick.id", "pick.n", "pick.label", "size").toDF("key", "b", "m", "other", "size")
        rest = work.save(_beside(labelled, open_bands))
        if rest.isEmpty():
            break
        pairs = rest.select(F.col("id").alias("a"), "b", "n", "m", "label", "other")
        if full:
            few = rest.where(F.col("size") <= PAIRED)
            left, right = few.select("key", F.col("id").alias("a"), "n", "label"), few.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"))
            pairs = left.join(right, "key")
        pairs = pairs.where("label <> other").where(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        fresh = verified(pairs.join(tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"))
        tried = tried.unionByName(fresh)
        links = tried.where("linked").select("a", "b")
        if full:
            many = rest.where(F.col("size") > PAIRED).select("key", "id", "b", "label", "size")
            links = links.union(_block_links(many, texts, work, words, percent))
    return links


def _block_links(many: DataFrame, texts: DataFrame, work: Workspace, words: int, percent: int) -> DataFrame:
    """``many`` (key, id, b, label, size): members of large bands, each with one other member of its band.

    They are dealt out as pairs of blocks, band by band. Where bands overlap so much that comparing all members which they connect at once
    makes fewer pairs than comparing each band, these members are one group instead. A group never has more pairs than its bands."""
    many = work.save(many)
    if many.isEmpty():
        return many.select(F.col("id").alias("a"), "b").limit(0)
    cluster = work.save(connected_components(many.select(F.col("id").alias("a"), "b"), work).withColumnRenamed("component", "cluster"))
    bands = many.select("key", "b", "size").distinct().join(cluster.withColumnRenamed("node", "b"), "b")
    by_band = bands.groupBy("cluster").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("pairs"))
    sizes = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    choice = sizes.join(by_band, "cluster").select("cluster", "members", (F.col("members").cast("double") * F.col("members") <= F.col("pairs")).alias("together"))
    choice = work.save(choice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))  # a cluster may hold most rows
    salted = lambda rows, by: rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(choice, ["cluster", "salt"])
    merged = salted(cluster, "node").where("together").select(F.col("node").alias("id"), F.xxhash64(F.lit(1), "cluster").alias("group"), F.col("members").alias("size"))
    single = salted(bands, "key").where("not together").select("key", "size")
    alone = _beside(many.select("key", "id", "size"), single).select("id", F.xxhash64(F.lit(2), "key").alias("group"), "size")
    named = merged.unionByName(alone).join(many.select("id", "label").distinct(), "id")
    parts = named.withColumn("parts", F.expr(f"int(ceil(size / {BLOCK_ROWS}))"))
    parts = parts.withColumn("block", F.expr("int(pmod(xxhash64(id), parts))")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = parts.select("group", F.least("block", "with").alias("block_a"), F.greatest("block", "with").alias("block_b"), "block", "id", "label")
    dealt = dealt.join(texts, "id").select("group", "block_a", "block_b", "block", "id", "label", "text")
    count = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(count, "group", "block_a", "block_b").sortWithinPartitions("group", "block_a", "block_b")
    return work.save(dealt.mapInArrow(block_batches(words, percent), "a long, b long"))


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 45, rows: int = 6
) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest id; all columns stay. Each row is judged by its own text: rows that
    repeat an id with another text are nodes of their own, equal rows stay or go together, and rows without id stay if no row with an id represents them."""
    work = Workspace(docs.sparkSession, "one_of_each")
    own, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    source = docs.select(own.alias("id"), text.alias("text"))
    names = None
    if not source.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        # numbers in the order of (id, hash) name the different texts of an id
        each = source.where("id is not null").select("id", _text_hash(F.col("text")).alias("hash")).distinct().orderBy("id", "hash")
        names = work.save(each.withColumn("node", F.monotonically_increasing_id()))
        hashed = source.withColumn("hash", _text_hash(F.col("text")))
        source = hashed.join(names, ["id", "hash"], "left").select(F.col("node").alias("id"), "text")
    found = _components(source, work, shingle_words, percent, bands, rows).where(~F.col("id").eqNullSafe(F.col("component")))
    gone = found.select(F.col("id").alias("_gone"), F.col("text_hash").alias("_gone_hash")).distinct()
    if names is not None:
        gone = gone.join(names.select(F.col("node").alias("_gone"), "id"), "_gone", "left").select(F.col("id").alias("_gone"), "_gone_hash")
    return docs.join(gone, own.eqNullSafe(gone["_gone"]) & (_text_hash(text) == gone["_gone_hash"]), "left_anti")

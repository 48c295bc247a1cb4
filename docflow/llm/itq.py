"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned that brings vectors close to the corners of a cube (Gong and Lazebnik, 2011), on
a sample bounded by ``sample_rows``; signs of the rotated, centred vectors are balanced binary codes. Several rotations
give one long code, cut into blocks; each block is the key of one table. Vectors that agree in a block are compared by Hamming distance of the
first CODE_BITS bits, and what is near is reranked by the cosine of the original vectors in double precision.

Block width follows the number of vectors, so that buckets of unrelated vectors keep their size (BUCKET) at every size of the input, and the number of
tables follows the width: two vectors at an angle t agree in a bit with probability 1 - t / pi, and there are as many tables as a
pair at exactly ``cosine`` needs to meet in one of them with probability RECALL. The learned codes are tried on made pairs of that
cosine; if fewer meet (centring pulls the vectors of a narrow cloud apart), codes are of random rotations and not centred, and tables are added
until they do. The Hamming bound is one that NEAR of these pairs keep.

Tables hold numbers and short codes, no vectors: a bucket first says which of its vectors have a partner near in Hamming distance that they
did not meet in an earlier table, and only these are fetched. Large buckets are dealt out as pairs of blocks; how large they are is estimated on one
vector in SAMPLED, on which no result depends. A task compares two blocks with a matrix product and emits counts for each vector and one
edge for each local component, never pairs. A pair counts in the first table whose block it shares. Equal vectors are one class with a count.

Defined cases: null, empty, zero and non-finite vectors link with nothing; vectors of different lengths aren't compared (each
length has a model and tables of its own). Each row is a vector of its own, also if ids
repeat; the component is the smallest id reached; a row without id counts as a vector but can't name a component. Ids are integers; a text that
isn't one stops the job with Spark's cast error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docflow.llm.graph import connected_components, spanning_edges
from docflow.llm.workspace import Workspace

#: Least probability that a pair at the wanted cosine shares a bucket, and that its codes are near enough there.
RECALL, NEAR = 0.995, 0.999
#: Bits of the code that is compared in buckets; unrelated vectors of a bucket; one vector in SAMPLED estimates sizes of buckets.
CODE_BITS, BUCKET, SAMPLED = 128, 192, 8


@dataclass(frozen=True)
class Quantiser:
    """centre: mean of the sample; planes: dimensions x code bits, all rotations side by side; radius: the Hamming bound in the first CODE_BITS."""

    centre: np.ndarray
    planes: np.ndarray
    tables: int
    block_bits: int
    radius: int = CODE_BITS

    def code(self, vectors: np.ndarray) -> np.ndarray:
        """Packed bits of each vector (rows x bytes)."""
        out = np.empty((len(vectors), self.planes.shape[1] // 8), dtype=np.uint8)
        for lo in range(0, len(vectors), 512):
            part = vectors[lo : lo + 512]
            unit = part / np.linalg.norm(part, axis=1, keepdims=True)
            out[lo : lo + 512] = np.packbits((unit - self.centre) @ self.planes > 0, axis=1, bitorder="little")
        return out

    def keys(self, code: np.ndarray) -> np.ndarray:
        """Of each code its block of each table, as integers (rows x tables)."""
        bits = np.unpackbits(code, axis=1, count=self.tables * self.block_bits, bitorder="little").reshape(len(code), self.tables, self.block_bits)
        return bits @ (np.int64(1) << np.arange(self.block_bits, dtype=np.int64))

    def earlier(self, table: int) -> np.ndarray:
        """Masks (tables x 2 words) of the blocks of the tables before ``table`` that are within the first CODE_BITS."""
        bits = np.zeros((min(table, CODE_BITS // self.block_bits), CODE_BITS), dtype=np.uint8)
        for t in range(len(bits)):
            bits[t, t * self.block_bits : (t + 1) * self.block_bits] = 1
        return short(np.packbits(bits, axis=1, bitorder="little"))


def short(code: np.ndarray) -> np.ndarray:
    """The first CODE_BITS bits as words (rows x 2)."""
    return np.ascontiguousarray(code[:, : CODE_BITS // 8]).view(np.uint64)


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hamming distances of all short codes on the left to all on the right."""
    return sum(np.bitwise_count(left[:, None, w] ^ right[None, :, w]).astype(np.int16) for w in range(left.shape[1]))


def tables_for(cosine: float, block_bits: int, recall: float = RECALL) -> int:
    """Tables in which a pair at ``cosine`` agrees in a block at least once with probability ``recall``, if bits are independent."""
    met = (1 - math.acos(min(1.0, cosine)) / math.pi) ** block_bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log1p(-met))


def bits_for(vectors: int) -> int:
    """Block width that leaves about BUCKET unrelated vectors in a bucket."""
    return min(48, max(4, round(math.log2(max(2, vectors) / BUCKET))))


def made_pairs(sample: np.ndarray, cosine: float, pairs: int = 2000, seed: int = 13) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at exactly ``cosine`` that differ in a random direction, and pairs that differ in the direction of another vector of the sample."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    one = unit[rng.integers(len(unit), size=pairs)]
    found = []
    for away in (rng.normal(size=one.shape), unit[rng.integers(len(unit), size=pairs)] - one):
        away = away - (away * one).sum(axis=1, keepdims=True) * one
        length = np.linalg.norm(away, axis=1, keepdims=True)
        left, away = one[length[:, 0] > 1e-9], away[length[:, 0] > 1e-9] / length[length[:, 0] > 1e-9]
        if len(left):
            found.append((left, cosine * left + math.sqrt(max(0.0, 1 - cosine**2)) * away))
    return found


def met_share(model: Quantiser, sample: np.ndarray, cosine: float) -> float:
    """Share of made pairs that agree in a block: the smaller one of both kinds."""
    shares = [float((model.keys(model.code(a)) == model.keys(model.code(b))).any(axis=1).mean()) for a, b in made_pairs(sample, cosine)]
    return min(shares, default=1.0)


def bounded(model: Quantiser, sample: np.ndarray, cosine: float) -> Quantiser:
    """``model`` with the Hamming bound that made pairs at ``cosine`` keep."""
    far = [np.bitwise_count(short(model.code(a)) ^ short(model.code(b))).sum(axis=1) for a, b in made_pairs(sample, cosine)]
    return replace(model, radius=max((int(np.quantile(x, NEAR)) + 1 for x in far), default=CODE_BITS))


def fitted(sample: np.ndarray, block_bits: int, cosine: float, recall: float = RECALL) -> Quantiser:
    """A model whose tables let pairs at ``cosine`` meet with probability ``recall``."""
    tables = tables_for(cosine, block_bits, recall)
    model = learn(sample, tables, block_bits)
    centred = met_share(model, sample, cosine) >= recall - 0.005
    while not centred:
        model = learn(sample, tables, block_bits, iterations=0, centred=False)
        if met_share(model, sample, cosine) >= recall - 0.005:
            break
        tables = math.ceil(tables * 1.25)
    return bounded(model, sample, cosine)


def learn(sample: np.ndarray, tables: int, block_bits: int, iterations: int = 25, seed: int = 11, centred: bool = True) -> Quantiser:
    """Rotations by iterative quantisation of ``sample`` (rows x dimensions, not zero)."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centre = unit.mean(axis=0) if centred else np.zeros(unit.shape[1])
    dims = unit.shape[1]
    _, axes = np.linalg.eigh(np.cov((unit - centre).T) + 1e-12 * np.eye(dims) if len(unit) > 1 else np.eye(dims))
    projected = (unit - centre) @ axes
    planes = []
    bits = -(-max(tables * block_bits, CODE_BITS) // 8) * 8  # whole bytes
    for _ in range(math.ceil(bits / dims)):
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(iterations):
            left, _, right = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
            rotation = (left @ right).T
        planes.append((axes @ rotation)[:, rng.permutation(dims)])
    return Quantiser(centre, np.concatenate(planes, axis=1)[:, :bits], tables, block_bits)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _codes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _coded(model: Quantiser):
    """(node, weight, v) -> (node, weight, v, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = pa.array([x.tobytes() for x in model.code(_matrix(batch.column(2)))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, code], ["node", "weight", "v", "code"])

    return run


def _keyed(model: Quantiser):
    """(node, code) -> (key, node, c0, c1), a row for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                code = _codes(part.column(1), model.planes.shape[1] // 8)
                keys = (np.arange(model.tables, dtype=np.int64)[None, :] << np.int64(model.block_bits)) + model.keys(code)
                words = short(code).view(np.int64)
                each = [np.repeat(x, model.tables) for x in (part.column(0).to_numpy(), words[:, 0], words[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), *each)], ["key", "node", "c0", "c1"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that agree in the first three columns, whatever the batches; groups of one row are left out."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        if not table.num_rows:
            continue
        heads = np.stack([table.column(i).to_numpy() for i in range(3)])
        cut = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if hi - lo > 1:
                yield table.slice(lo, hi - lo)
        held = table.slice(cut[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _candidates(model: Quantiser):
    """(key, block_a, block_b, block, node, c0, c1), sorted by the first three -> the first five, of those with a near partner."""

    def near(code: np.ndarray, left: np.ndarray, right: np.ndarray, masks: np.ndarray, same: bool) -> np.ndarray:
        """Rows of ``left`` and ``right`` that have a partner among the other."""
        hit = np.zeros(len(code), dtype=bool)
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            i, j = np.nonzero(distances(code[some], code[right]) <= model.radius)
            i, j = some[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            apart = code[i] ^ code[j]
            for mask in masks:  # not the pairs that an earlier table has
                if not len(i):
                    break
                stay = (apart & mask).any(axis=1)
                i, j, apart = i[stay], j[stay], apart[stay]
            hit[i] = hit[j] = True
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block_a", "block_b", "block", "node"]
        for group in _grouped(batches):
            key, a, b = (group.column(i)[0].as_py() for i in range(3))
            block = group.column(3).to_numpy()
            code = np.stack([group.column(i).to_numpy() for i in (5, 6)], axis=1).view(np.uint64)
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            if len(left) and len(right):
                hit = near(code, left, right, model.earlier(key >> model.block_bits), a == b)
                if hit.any():
                    found = group.select(names).filter(pa.array(hit)).combine_chunks()
                    yield from found.to_batches()

    return run


def _comparer(model: Quantiser, least: float):
    """(key, block_a, block_b, block, node, weight, v, code), sorted by the first three -> (node, other, links).

    Rows with ``other`` null carry a count of links; the rest are edges."""

    def compare(group: pa.Table) -> Iterator[tuple]:
        key, a, b = (group.column(i)[0].as_py() for i in range(3))
        block, node, weight = (group.column(i).to_numpy() for i in (3, 4, 5))
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        if not len(left) or not len(right) or (a == b and len(left) < 2):
            return
        vectors = _matrix(group.column(6).combine_chunks())
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        close = unit[left] @ unit[right].T >= least
        if a == b:
            close &= ~np.eye(len(left), dtype=bool)
        table = key >> model.block_bits
        if table and close.any():  # not the pairs that an earlier table has
            keys = model.keys(_codes(group.column(7).combine_chunks(), model.planes.shape[1] // 8))
            i, j = np.nonzero(close)
            met = np.zeros(len(i), dtype=bool)
            for t in range(table):
                met |= keys[left[i], t] == keys[right[j], t]
            close[i[met], j[met]] = False
        links = close @ weight[right]
        hit = np.flatnonzero(links)
        yield from zip(node[left[hit]].tolist(), [None] * len(hit), links[hit].tolist(), strict=True)
        if a != b:
            back = close.T @ weight[left]
            other = np.flatnonzero(back)
            yield from zip(node[right[other]].tolist(), [None] * len(other), back[other].tolist(), strict=True)
        yield from ((x, y, None) for x, y in spanning_edges(close, node[left], node[right], a == b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _grouped(batches):
            out += compare(group)
            if len(out) >= 20_000:
                yield rows(out)
                out = []
        yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "other", "links"])

    return run


def near_duplicate_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_bits: int | None = None, sample_rows: int = 10_000, block_rows: int = 256
) -> DataFrame:
    """One row per row of ``vectors``: (id, n_links, component_id, kept). ``block_bits``: by the number of vectors, unless given."""
    spark = vectors.sparkSession
    work = Workspace(spark, "itq")
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    usable = F.expr("size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    usable = F.coalesce(F.col("v").isNotNull() & usable, F.lit(False))
    # two hashes stand for a vector, so that vectors are shuffled once, when equal ones become a class
    hashed = source.withColumn("v", F.when(usable, F.col("v"))).withColumns({"h1": F.when(usable, F.xxhash64("v")), "h2": F.when(usable, F.xxhash64(F.lit(7), F.size("v"), "v"))})
    distinct = hashed.where("h1 is not null").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    # ids that repeat, or are missing, can't name a class
    classes = work.save(distinct.withColumn("node", F.monotonically_increasing_id()))

    sizes = classes.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy("dims").collect()  # lengths, not vectors
    found = spark.createDataFrame([], "node long, other long, links long")
    for dims, n in sizes:
        if n > 1:
            found = found.unionByName(_found(classes.where(F.size("v") == dims), n, work, cosine, block_bits, sample_rows, block_rows))

    component = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), work)
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "h1", "h2", "id", "weight").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = named.join(least, "component").join(links, "node", "left")
    labels = labels.select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))

    out = hashed.select("id", "h1", "h2").join(labels, ["h1", "h2"], "left")
    component_id = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component_id.alias("component_id"), F.col("id").eqNullSafe(component_id).alias("kept"))


def _found(indexed: DataFrame, n: int, work: Workspace, cosine: float, block_bits: int | None, sample_rows: int, block_rows: int) -> DataFrame:
    """(node, other, links) of ``indexed`` (node, weight, v), n vectors of one length, as the comparer gives them."""
    sample = indexed.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample_rows).toArrow()
    model = fitted(_matrix(sample.column("v").combine_chunks()), block_bits or bits_for(n), cosine)

    coded = indexed.select("node", "weight", "v")
    coded = work.save(coded.mapInArrow(_coded(model), T.StructType([*coded.schema.fields, T.StructField("code", T.BinaryType())])))
    tables = lambda rows: rows.select("node", "code").mapInArrow(_keyed(model), "key long, node long, c0 long, c1 long")
    sampled = tables(coded.where(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SAMPLED)) == 0)).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("size"))
    large = work.save(sampled.where(F.col("size") > 2 * block_rows).select("key", F.expr(f"int(ceil(size / {int(block_rows)}))").alias("parts")))

    parts = tables(coded).join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    parts = parts.withColumn("block", F.expr("int(pmod(xxhash64(node, key), parts))")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    count = int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["key", "block_a", "block_b"]
    dealt = parts.select("key", F.least("block", "with").alias("block_a"), F.greatest("block", "with").alias("block_b"), "block", "node", "c0", "c1")
    dealt = dealt.repartition(count, *group).sortWithinPartitions(*group)
    near = work.save(dealt.mapInArrow(_candidates(model), "key long, block_a int, block_b int, block int, node long"))

    fetched = near.join(coded, "node").select(*group, "block", "node", "weight", "v", "code").repartition(count, *group).sortWithinPartitions(*group)
    return work.save(fetched.mapInArrow(_comparer(model, cosine), "node long, other long, links long"))

"""Line deduplication over the whole corpus, by sorted hashes and bitmaps.

Every long enough line becomes a row (hash, document, position) without its text. The rows are range-partitioned by hash
and document and sorted in each partition by hash, document (largest first) and position, so that one pass over a
partition meets the occurrences of a hash in order: those in the first document stay, the others go once enough
documents are known to hold the line. A frequent line spreads over many partitions; for the first and last hash of a partition
the pass uses totals gathered from all partitions (two rows each). Dropped positions become one compressed bitmap for each
document, which the document meets again to lose its lines.

Defined cases: a null or empty text is one empty line. Rows that share an id (null ids share one) count as one document;
each keeps its own bitmap, told apart by a hash of its text. Ids are integers; a text that isn't one stops the job with Spark's cast error.
Other columns pass through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from docflow.llm.workspace import Workspace

_SPACE = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAPS = "row_id long, row_hash long, keep binary"
#: Bytes of bitmaps for each partition up to which documents meet them in a hash join.
HASHED_BYTES = 32 << 20


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _LOWER)


def _row_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, row_hash, pos) for each line whose key has ``min_chars`` code points."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _row_hash(text).alias("row_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    rows = rows.where(F.length("line") >= min_chars).withColumn("key", key).where(F.length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "row_hash", "pos")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int | None, list]]:
    """(hash, document, its rows) in the order of the rows, whatever the batches."""
    key, doc, rows = None, None, []
    for batch in batches:
        h1, h2, docs, row_hash, pos = (c.to_pylist() for c in batch.columns)
        for at in range(len(h1)):
            if key == (h1[at], h2[at]) and doc == docs[at]:
                rows.append((row_hash[at], pos[at]))
            else:
                if key is not None:
                    yield key, doc, rows
                key, doc, rows = (h1[at], h2[at]), docs[at], [(row_hash[at], pos[at])]
    if key is not None:
        yield key, doc, rows


def _edge_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last hash of this partition: its number of documents here, and the first of them."""
    first = last = None
    for key, doc, _ in _runs(batches):
        if last is None or last[0] != key:
            if first is None and last is not None:
                first = last
            last = [key, 1, doc]
        else:
            last[1] += 1
    found = [x for x in (first, last) if x]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0][0] for x in found], pa.int64()), pa.array([x[0][1] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())],
        ["h1", "h2", "docs", "first"],
    )


def _dropper(edges: dict[tuple[int, int], tuple[int, int | None]], min_docs: int):
    """The pass over a sorted partition: emits what is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["row_id", "row_hash", "pos"])

        key, seen, held = None, 0, []
        for now, doc, rows in _runs(batches):
            if now != key:
                key, seen, held = now, 0, []
            seen += 1
            rows = [(doc, *x) for x in rows]
            if now in edges:
                total, first = edges[now]
                if total >= min_docs and doc != first:
                    out += rows
            elif seen >= min_docs:  # all of this hash is in this partition
                out += held + rows
                held = []
            elif seen > 1:
                held += rows
            if len(out) >= 20_000:
                yield flush()
        yield flush()

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for positions in batch.column(2):
            drop = positions.values.to_numpy()
            bits = np.ones((int(drop.max()) // 8 + 1) * 8, dtype=bool)
            bits[drop] = False
            keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.binary())], ["row_id", "row_hash", "keep"])


def keep_mask(keep: bytes | None, n: int) -> np.ndarray:
    """Of ``n`` lines, which stay. Lines beyond the bitmap's last byte stay; so does everything without a bitmap."""
    mask = np.ones(n, dtype=bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), bitorder="little").astype(bool)
        mask[: min(n, len(bits))] = bits[:n]
    return mask


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(row_id, row_hash, keep) of each document that loses lines: bit i of the decompressed ``keep`` is 0 if line i goes."""
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    rows = work.save(line_rows(docs, id_col, text_col, min_chars))  # ranges are found by a pass of their own, which needn't split the texts again
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, "h1", "h2", F.desc("doc")).sortWithinPartitions("h1", "h2", F.desc("doc"), "pos")
    ordered = work.checkpoint(ordered)  # keeps the order in partitions, for two passes

    edges: dict[tuple[int, int], tuple[int, int | None]] = {}
    for h1, h2, n, first in ordered.mapInArrow(_edge_totals, "h1 long, h2 long, docs long, first long").toLocalIterator():
        total, largest = edges.get((h1, h2), (0, None))
        edges[h1, h2] = total + n, max((x for x in (largest, first) if x is not None), default=None)
    dropped = ordered.mapInArrow(_dropper(edges, min_docs), "row_id long, row_hash long, pos int")
    positions = dropped.groupBy("row_id", "row_hash").agg(F.collect_set("pos").alias("drop"))
    return work.save(positions.mapInArrow(_pack, BITMAPS))


def _with_bitmaps(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    maps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **options).toDF("__row_id", "__row_hash", "__keep")
    key = docs[id_col].cast("long").eqNullSafe(maps["__row_id"]) & (_row_hash(F.coalesce(docs[text_col], F.lit(""))) == maps["__row_hash"])
    # a hash join needn't sort the texts, but holds the bitmaps of a partition in memory: only where their measured size is small
    held = maps.agg(F.coalesce(F.sum(F.length("__keep") + F.lit(64)), F.lit(0))).first()[0]
    if held <= HASHED_BYTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        maps = maps.hint("shuffle_hash")
    return docs.join(maps, key, "left")


def _split(texts: pa.Array, bitmaps: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
    for text, keep in zip(texts, bitmaps, strict=True):
        lines = (text.as_py() or "").split("\n")
        yield lines, keep_mask(keep.as_py(), len(lines))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, sha = [], [], []
        for lines, mask in _split(batch.column(1), batch.column(2)):
            n.append(len(lines))
            gone.append(int(len(mask) - mask.sum()))
            kept = "\n".join(x for x, stays in zip(lines, mask, strict=True) if stays)
            sha.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), batch.column(2)], ["id", "n_lines", "n_dropped", "kept_sha256", "keep"])


def line_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_dropped, kept_sha256 and the bitmap ``keep`` (null: nothing goes)."""
    joined = _with_bitmaps(docs.select(id_col, text_col), id_col, text_col, **options)
    digest = joined.select(F.col(id_col).cast("long").alias("id"), text_col, "__keep").mapInArrow(_digest, "id long, n_lines long, n_dropped long, kept_sha256 string, keep binary")
    return digest.withColumnRenamed("id", id_col)


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with its columns, texts without the lines that go. A null text without lines to lose stays null."""
    joined = _with_bitmaps(docs, id_col, text_col, **options).select(*docs.columns, "__keep")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, maps = batch.column(at), batch.column(len(docs_columns))
            kept = [
                text.as_py() if not keep.is_valid else "\n".join(x for x, stays in zip(lines, mask, strict=True) if stays)
                for text, keep, (lines, mask) in zip(texts, maps, _split(texts, maps), strict=True)
            ]
            columns = [*batch.columns[: len(docs_columns)]]
            columns[at] = pa.array(kept, texts.type)
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(run, docs.schema)

"""Exact first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.plans.workspace import Workspace


def content_hash(title: Column, blocks: Column, codes: Column) -> Column:
    """SHA-256 of a record's parts joined by blank lines; empty strings are parts, missing lists are not."""
    one = lambda b: F.concat(
        F.array(b["type"], F.coalesce(b["text"], F.lit(""))),
        F.when(F.size(b["items"]) > 0, F.array(F.array_join(b["items"], "\n"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(b["rows"]) > 0, F.array(F.array_join(F.transform(b["rows"], lambda r: F.array_join(r, "|")), "\n"))).otherwise(F.array().cast("array<string>")),
    )
    code = F.flatten(F.transform(codes, lambda c: F.array(F.coalesce(c["language"], F.lit("")), F.coalesce(c["text"], F.lit("")))))
    return F.sha2(F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), F.flatten(F.transform(blocks, one)), code), "\n\n"), 256)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    picked = rows.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_order"))
    return rows.join(picked, F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_order"))).drop("_key", "_order")


def first_of_two_keys(rows: DataFrame, order: str, one: str, two: str) -> DataFrame:
    """``rows`` with ``decision``: accepted, or the key that an earlier accepted row has (``one`` before ``two``).

    Row by row, a row is rejected if an accepted row has either key, and only accepted rows count. A null is no key, and neither is an
    empty text of ``one``; rows without keys are accepted. Rows that repeat a value of ``order`` come in any order, but one after another.

    In rounds: among undecided rows, one that comes first under both keys is accepted, and rows that share a key with an
    earlier accepted row are rejected. Each round aggregates minima and joins them back. The first undecided row is decided in every round, so
    the rounds end; their number is that of the longest chain in which each row hangs on the one before it, a few for keys that repeat at random.
    """
    work = Workspace(rows.sparkSession, "dedup")
    held = work.save(rows.withColumn("_row", F.monotonically_increasing_id()))
    keys = held.select(F.struct(F.col(order).alias("order"), F.col("_row").alias("row")).alias("o"), F.nullif(F.col(one), F.lit("")).alias("k1"), F.col(two).alias("k2"))
    open_rows = keys = work.save(keys)
    accepted = keys.limit(0)
    while not open_rows.isEmpty():
        first1 = open_rows.where("k1 is not null").groupBy("k1").agg(F.min("o").alias("m1"))
        first2 = open_rows.where("k2 is not null").groupBy("k2").agg(F.min("o").alias("m2"))
        now = open_rows.join(first1, "k1", "left").join(first2, "k2", "left")
        taken = work.save(now.where("(k1 is null or o = m1) and (k2 is null or o = m2)").select("o", "k1", "k2"))
        accepted = accepted.unionByName(taken)
        left = open_rows.join(taken.select("o"), "o", "left_anti")
        left = left.join(taken.where("k1 is not null").select("k1"), "k1", "left_anti").join(taken.where("k2 is not null").select("k2"), "k2", "left_anti")
        following = work.save(left.select("o", "k1", "k2"))
        if open_rows is not keys:
            work.drop(open_rows)
        open_rows = following
    by1 = accepted.where("k1 is not null").select(F.col("k1"), F.col("o").alias("a1"))
    decided = keys.join(accepted.select("o", F.lit(True).alias("ok")), "o", "left").join(by1, "k1", "left")
    decision = F.when(F.col("ok"), "accepted").when(F.col("a1") < F.col("o"), one).otherwise(two)
    return held.join(decided.select(F.col("o.row").alias("_row"), decision.alias("decision")), "_row").drop("_row")


def repeated_prose(rows: DataFrame, owner: str, position: str, text: str, min_chars: int) -> DataFrame:
    """Without later repeats of a long text inside one owner; short texts stay."""
    seen = F.row_number().over(Window.partitionBy(owner, text).orderBy(position))
    return rows.withColumn("_seen", seen).where((F.col("_seen") == 1) | (F.length(text) < min_chars)).drop("_seen")

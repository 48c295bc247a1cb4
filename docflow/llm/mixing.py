"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p**t / sum(p**t). The exponent t lies between 0 (all sources alike) and
1 (as they are); it is bisected to meet a target entropy of the weights, or the most repetitions that any source may
see. Sums over sources for 32 exponents at a time come from one aggregate, so the table of sources stays distributed
and each pass is worth five bisections.

Weights become budgets of tokens, and budgets become documents: a seeded hash orders the documents of a source at
random, its leading bits name blocks, and blocks are taken in order until the budget is met. Only the sums of blocks, then
those of the blocks inside the one where the budget ends, then the documents of that inner block are looked at in order;
no source is sorted as a whole. A budget of several times a source takes all of its documents that often, and a part once more.
A repetition limit holds with any budget: what a source may not take goes to the others by their weights, and if all are at the limit, the rest
of the budget is not taken.

Defined cases: a null source is a source. Texts without words have no tokens: they go with their source's whole rounds, and cost nothing.
A source without tokens has weight 0, and its documents are taken once if ``cover`` is set and not at all otherwise. Repeated rows are
ordered alike and so taken or left together: budgets are met up to the rows of one hash. No rows give no rows. Columns of the input keep their
names; a result whose name is taken, in any case of letters, gets ``mix_`` before it (``output_names``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from docflow.llm.workspace import Workspace

#: Bits of the order hash for a block, and for a block inside it.
BLOCK_BITS = 10
_POINTS = 32
_PASSES = 8


def tokens(text: Column) -> Column:
    """Words: runs of what isn't ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def find_exponent(shares: DataFrame, *, entropy: float | None = None, repeats: float | None = None) -> float:
    """The largest exponent whose weights reach a share ``entropy`` of the most entropy possible, or under which the
    largest source is seen once and none more than ``repeats`` times. ``shares``: a column p over 0."""
    if (entropy is None) == (repeats is None):
        raise ValueError("give entropy or repeats")
    if repeats is not None and repeats < 1:
        raise ValueError("repeats must be at least 1")
    low, high = 0.0, 1.0
    n, least, most = shares.agg(F.count(F.lit(1)), F.min("p"), F.max("p")).first()
    if n < 2 or least == most:
        return 1.0
    for _ in range(_PASSES):
        points = [low + (high - low) * i / (_POINTS - 1) for i in range(_POINTS)]
        if entropy is not None:
            power = [F.pow("p", F.lit(t)) for t in points]
            sums = shares.agg(*(F.sum(x) for x in power), *(F.sum(x * F.log("p")) for x in power)).first()
            # H of p**t / Z is log Z - t * sum(p**t log p) / Z; it falls as t grows
            meets = [math.log(sums[i]) - t * sums[_POINTS + i] / sums[i] >= entropy * math.log(n) - 1e-12 for i, t in enumerate(points)]
        else:
            meets = [(most / least) ** (1 - t) <= repeats * (1 + 1e-12) for t in points]
        # entropy is met below some exponent, repetition above one
        if entropy is not None:
            at = max((i for i, x in enumerate(meets) if x), default=0)
            low, high = points[at], points[min(at + 1, _POINTS - 1)]
        else:
            at = min((i for i, x in enumerate(meets) if x), default=_POINTS - 1)
            low, high = points[max(at - 1, 0)], points[at]
    return low if entropy is not None else high


def source_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """``sizes`` (source, tokens) -> with p and weight; weights sum to 1 over sources with tokens."""
    total = sizes.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    shares = sizes.withColumn("p", F.col("tokens") / F.lit(float(max(total, 1))))
    power = F.when(F.col("p") > 0, F.pow("p", F.lit(float(exponent)))).otherwise(0.0)
    norm = shares.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    return shares.withColumn("weight", power / F.lit(norm))


def output_names(columns: list[str]) -> dict[str, str]:
    """What the results are called beside ``columns``."""
    taken, names = {c.lower() for c in columns}, {}
    for name in ("n_tokens", "weight", "copies", "order_key"):
        free = name
        while free.lower() in taken:
            free = f"mix_{free}"
        names[name] = free
        taken.add(free.lower())
    return names


def limited(weighted: DataFrame, budget: int, most: float) -> DataFrame:
    """``weighted`` (tokens, weight, ...) with wanted: the budget by weights, no source above ``most`` times its tokens.

    Sources get the smaller of their limit and a multiple of their weight; the multiple that spends the budget is bisected."""
    limit = F.lit(float(most)) * F.col("tokens")
    room, high = weighted.where("weight > 0").agg(F.sum(limit), F.max(limit / F.col("weight"))).first()
    scale = high or 0.0
    if (room or 0.0) > budget:
        low = float(budget)  # weights sum to 1, so this spends the budget at most
        for _ in range(_PASSES):
            points = [low + (scale - low) * i / (_POINTS - 1) for i in range(_POINTS)]
            spent = weighted.agg(*(F.sum(F.least(limit, F.lit(x) * F.col("weight"))) for x in points)).first()
            at = max((i for i, x in enumerate(spent) if x <= budget), default=0)
            low, scale = points[at], points[min(at + 1, _POINTS - 1)]
        scale = low
    wanted = F.round(F.least(limit, F.lit(float(scale)) * F.col("weight"))).cast("long")
    return weighted.withColumn("wanted", F.least(wanted, F.floor(limit)))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float | None = None,
    repeats: float | None = None,
    budget: int | None = None,
    rounds_of_corpus: float | None = None,
    most_copies: float | None = None,
    seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: its columns, n_tokens, weight (of its source), copies (0: not taken), order_key.

    ``entropy`` or ``repeats`` finds the exponent. ``most_copies``: how often a source may be seen, by default ``repeats`` if that is given.
    ``budget``: tokens to take in all, or ``rounds_of_corpus`` times the tokens of ``docs``; neither: so many that no document
    is left out (cover). order_key orders the
    documents of the mixture at random: sorted by (copy, order_key) they are a training order.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mixing")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # own names can't clash
    rows = docs.select(*(F.col(f"`{c}`").alias(names[c]) for c in docs.columns))
    ident, text, source = (F.col(names[c]) for c in (id_col, text_col, source_col))
    order = F.xxhash64(F.lit(seed), ident.cast("string"), source.cast("string"), text)
    slim = work.save(rows.select(source.alias("source"), tokens(text).alias("n"), order.alias("h")))

    sizes = work.save(slim.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    found = sizes.agg(F.sum("tokens").alias("t")).first()["t"]
    shares = sizes.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(found or 1)))
    exponent = find_exponent(shares, entropy=entropy, repeats=repeats)
    weighted = source_weights(sizes, exponent)
    if budget is None and rounds_of_corpus is not None:
        budget = round(rounds_of_corpus * (found or 0))
    most_copies = repeats if most_copies is None else most_copies
    if budget is None:  # the source that is seen least is seen once
        ratio = weighted.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("r")).first()["r"] or 0.0
        wanted = F.greatest(F.round(F.lit(float(ratio)) * F.col("weight")).cast("long"), F.col("tokens"))
        if most_copies is not None:
            wanted = F.least(wanted, F.floor(F.lit(float(most_copies)) * F.col("tokens")))
        plan = weighted.withColumn("wanted", wanted)
    elif most_copies is not None:
        plan = limited(weighted, budget, most_copies)
    else:
        plan = weighted.withColumn("wanted", F.round(F.lit(float(budget)) * F.col("weight")).cast("long"))
    rounds = F.when(F.col("tokens") > 0, F.expr("wanted div tokens")).otherwise(F.lit(1 if budget is None else 0).cast("long"))
    plan = plan.withColumn("rounds", rounds)
    plan = work.save(plan.select("source", "weight", "rounds", (F.col("wanted") - F.col("rounds") * F.col("tokens")).alias("rest")))
    edges = _cuts(slim, plan, work)

    # rows of one source are many: its plan meets them in a join that can be split, or is broadcast if measured to be small
    result = output_names(docs.columns)
    out = rows.withColumns({"n_tokens": tokens(text), "order_key": order})
    out = out.join(edges, source.eqNullSafe(edges["source"]), "left").withColumn("copies", (F.col("rounds") + F.when(F.col("order_key") <= F.col("last"), 1).otherwise(0)).cast("long"))
    return out.select(*(F.col(names[c]).alias(c) for c in docs.columns), *(F.col(c).alias(result[c]) for c in result))


def _cuts(slim: DataFrame, plan: DataFrame, work: Workspace) -> DataFrame:
    """``plan`` (source, weight, rounds, rest) -> with last: the largest hash that the part of a round takes, or null."""
    width = 64 - BLOCK_BITS
    inner = 64 - 2 * BLOCK_BITS
    # shifted right with its sign, a hash keeps its order
    blocks = slim.groupBy("source", F.shiftright("h", width).alias("block")).agg(F.sum("n").alias("n"))
    first = _boundary(blocks, plan.where("rest > 0").select("source", "rest"), ["source"], "block", work)

    within = slim.withColumn("block", F.shiftright("h", width)).withColumn("part", F.shiftright("h", inner))
    ends = first.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("rest").alias("rest"))
    within = within.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b", "block")
    parts = within.groupBy("source", "part").agg(F.sum("n").alias("n"))
    second = _boundary(parts, first.select("source", "rest"), ["source"], "part", work)

    ends = second.select(F.col("source").alias("s"), F.col("part").alias("b"), F.col("rest").alias("left"))
    last = within.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("b"))).groupBy("source", "part", "left", "h").agg(F.sum("n").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source", "part").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    taken = last.withColumn("sum", running).where("sum <= left").groupBy("source").agg(F.max("h").alias("h"))
    found = second.select(F.col("source").alias("s"), "part").join(taken, F.col("s").eqNullSafe(F.col("source")), "left")
    # none taken in the inner block: all before it
    found = found.select("s", F.coalesce("h", F.shiftleft("part", inner) - 1).alias("last"))
    return work.save(plan.join(found, plan["source"].eqNullSafe(found["s"]), "left").select("source", "weight", "rounds", "last"))


def _boundary(sums: DataFrame, rest: DataFrame, key: list[str], block: str, work: Workspace) -> DataFrame:
    """The block of each source in which its rest is used up, and what is left of the rest there. At most 2**BLOCK_BITS
    rows of a source meet in a window."""
    ends = rest.select(F.col("source").alias("s"), "rest")
    placed = sums.join(ends, F.col("source").eqNullSafe(F.col("s")))
    before = F.sum("n").over(Window.partitionBy("source").orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("before", F.coalesce(before, F.lit(0)))
    return work.save(placed.where("before < rest and before + n >= rest").select("source", block, (F.col("rest") - F.col("before")).alias("rest")))

"""Chat formatting by linking quotations.

Lines that begin with ``>`` are quotations; the number of marks is their level, and a run of lines of one level is a
passage. Passages are normalised (white space, case; lines joined by a space) and hashed whole, and so are the texts that earlier messages of the
conversation wrote themselves: a passage that is all of a message links at any length. Lines are hashed one by one too, so that a shortened quotation
of whole lines links, and so are all runs of SHINGLE words, which a wrapped quotation or a part of a line shares with its source. Each hash counts for the first message that
wrote it; the message replied to is the one with the most whole messages quoted at the outermost level, then the most lines and
runs of words there, then at any level, the latest of equals. Without such a message, a message is a reply to none. Threads and depths follow by pointer jumping, and the text is what is left without quotations and the lines that announce them.

Defined cases: a null text is empty; null roles become ``user``. Rows of one conversation with one turn are told apart by a hash of role and
text, and exact repeats are kept but link as one. A row with null conversation or turn replies to nothing. A message is never its own
ancestor, as only earlier turns are quoted. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.llm.workspace import Workspace

_MARKS = r"^[\x20\t]*((?:>[\x20\t]?)+)"
#: Words in a run that links.
SHINGLE = 5
#: Lines that announce a quotation, in fixed forms of mail programs.
ANNOUNCE = r"(?i)^\s*(on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$"


def lines(text: Column) -> Column:
    """array<struct<level, body>>: the lines, quote marks counted and removed."""
    one = lambda x: F.struct(F.regexp_count(F.regexp_extract(x, _MARKS, 1), F.lit(">")).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), one)


def normalised(body: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(body, r"\s+", " ")))


def own_text(parsed: Column) -> Column:
    """The lines of level 0, without those that announce a quotation and without blank lines around."""
    kept = F.filter(parsed, lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(ANNOUNCE) & F.coalesce(F.get(parsed, i + 1)["level"] > 0, F.lit(False))))
    return F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def _hashes(parsed: Column, min_chars: int) -> Column:
    """array<struct<level, whole, hash>> of a message: its passages whole, their lines, and their runs of SHINGLE words. What it wrote itself is one passage."""
    passage = "struct<level: int, body: string>"
    cut = F.filter(parsed, lambda x, i: ~((x["level"] == 0) & x["body"].rlike(ANNOUNCE) & F.coalesce(F.get(parsed, i + 1)["level"] > 0, F.lit(False))))
    own = F.struct(F.lit(0).alias("level"), F.array_join(F.transform(F.filter(cut, lambda x: x["level"] == 0), lambda x: x["body"]), " ").alias("body")).cast(passage)

    def between(starts: Column) -> Column:
        length = lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(parsed)) - s
        body = lambda s, k: F.array_join(F.transform(F.slice(parsed, s + 1, length(s, k)), lambda x: x["body"]), " ")
        return F.transform(starts, lambda s, k: F.struct(F.get(parsed, s)["level"].alias("level"), body(s, k).alias("body")).cast(passage))

    # the lines at which the level changes; an array of one element, so that they are found once and not for each passage
    places = F.sequence(F.lit(0), F.size(parsed) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(parsed, i)["level"] != F.get(parsed, i - 1)["level"]))
    runs = F.filter(F.transform(F.array(starts), between)[0], lambda x: x["level"] > 0)
    passages = F.filter(F.transform(F.concat(F.array(own), runs), lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("body"))), lambda x: x["body"] != "")
    lines_ = F.filter(F.transform(parsed, lambda x: F.struct(x["level"].alias("level"), normalised(x["body"]).alias("body"))), lambda x: F.length(x["body"]) >= min_chars)
    made = lambda level, whole, value: F.struct(level.alias("level"), F.lit(whole).alias("whole"), F.xxhash64(value).alias("hash"))
    # an array of structs, so that the words of a passage are split once and not for each run
    worded = F.transform(passages, lambda p: F.struct(p["level"].alias("level"), F.split(p["body"], " ").alias("words")))
    first = lambda p: F.sequence(F.lit(0), F.greatest(F.size(p["words"]) - SHINGLE, F.lit(0)))
    run = lambda p, i: F.concat_ws(" ", *(F.get(p["words"], i + j) for j in range(SHINGLE)))
    shingles = lambda p: F.when(F.size(p["words"]) >= SHINGLE, F.transform(first(p), lambda i: made(p["level"], False, run(p, i))))
    parts = F.filter(F.transform(worded, shingles), lambda x: x.isNotNull())
    return F.concat(F.transform(passages, lambda p: made(p["level"], True, p["body"])), F.transform(lines_, lambda x: made(x["level"], False, x["body"])), F.flatten(parts))


def conversations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", min_chars: int = 12) -> DataFrame:
    """One row per message: conv_id, turn, role, text (its own), n_quoted (lines), reply_to (turn), thread (turn of the first
    message), depth, formatted.

    Sorted by (conv_id, thread, depth, turn), rows are conversations in the order of replies. ``min_chars``: shorter lines
    don't link by themselves; passages that are whole messages do.
    """
    work = Workspace(messages.sparkSession, "quotes")
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("user")).alias("role"),
        F.col(text_col).cast("string").alias("raw"),
    )
    parsed = work.save(rows.withColumn("lines", lines(F.col("raw"))).withColumn("key", F.xxhash64("role", F.coalesce("raw", F.lit("")))).drop("raw"))

    # only conversations that quote can link, so that the others' texts aren't hashed; their ids are saved, so that a table measured to be small is
    # broadcast, and both sides are shuffled otherwise
    quoting = work.save(parsed.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id").distinct())
    known = parsed.where("conv_id is not null and turn is not null").join(quoting, "conv_id", "left_semi")
    each = known.select("conv_id", "turn", "key", F.explode(_hashes(F.col("lines"), min_chars)).alias("x")).select("conv_id", "turn", "key", "x.*")
    quoted = each.where("level > 0").groupBy("conv_id", "whole", "hash", "turn", "key").agg(F.min("level").alias("level"))
    written = each.where("level = 0").groupBy("conv_id", "whole", "hash").agg(F.min("turn").alias("parent"))
    met = quoted.join(written, ["conv_id", "whole", "hash"]).where("parent < turn")
    outer = F.col("level") == 1
    counts = met.groupBy("conv_id", "turn", "key", "parent").agg(
        F.count_if(outer & F.col("whole")).alias("outer_whole"), F.count_if(outer).alias("outer_parts"), F.count(F.lit(1)).alias("all_parts")
    )
    parents = work.save(counts.groupBy("conv_id", "turn", "key").agg(F.max(F.struct("outer_whole", "outer_parts", "all_parts", "parent")).alias("best")).select("conv_id", "turn", "key", F.col("best.parent").alias("reply_to")))

    threads = _threads(parents, work)
    same = parsed.join(parents, ["conv_id", "turn", "key"], "left").join(threads, ["conv_id", "turn"], "left")
    body = own_text(F.col("lines"))
    out = same.select(
        "conv_id",
        "turn",
        "role",
        body.alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
    )
    return out.withColumn("formatted", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))


def _threads(parents: DataFrame, work: Workspace) -> DataFrame:
    """(conv_id, turn, thread, depth) of turns that reply: pointers double in length until all end at a first message.

    A turn with several messages takes the latest parent."""
    pointers = work.save(parents.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("thread")).withColumn("depth", F.lit(1)))
    while True:
        onward = pointers.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("beyond"), F.col("depth").alias("more"))
        longer = pointers.join(onward, ["conv_id", "thread"], "left")
        if longer.where("beyond is not null").isEmpty():
            return pointers
        following = work.save(longer.select("conv_id", "turn", F.coalesce("beyond", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        work.drop(pointers)
        pointers = following

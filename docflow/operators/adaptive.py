"""Decisions of the adaptive crawl as columns: reports are data, and the next step is a function of the state.

A state is a row: detection (llms_txt, sitemap, openapi, framework, or null), failure_mode (null without a usable report), include_sparse,
max_depth, workers, retries, exhausted, and n_records with the quality columns of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docflow.functions import text as T, urls as U
from docflow.operators import sections
from docflow.schema import BLOCK, block

#: What a report may name, the failures that a new script can mend, and the limits of retrying.
FAILURE_MODES = ("SELECTOR_MISMATCH", "PAGINATION_FAILURE", "RATE_LIMITED", "EMPTY_CONTENT", "SYNTAX_ERROR", "JS_NOT_RENDERED", "ANTIBOT", "AUTH_REQUIRED", "INFINITE_SCROLL")
SCRIPT_MODES = ("SELECTOR_MISMATCH", "PAGINATION_FAILURE", "SYNTAX_ERROR", "RATE_LIMITED", "JS_NOT_RENDERED", "EMPTY_CONTENT", "INFINITE_SCROLL")
MAX_RETRIES, SINGLE_DOCUMENT_WORDS = 3, 1200


def feedback_report(text: Column) -> Column:
    """A report from JSON: the mode in upper case, confidence within 0 and 1; null if it isn't an object or names an unknown mode."""
    raw = F.from_json(text, "struct<failure_mode:string,confidence_score:string,permanent_fix_recommended:string,rationale:string,immediate_fix:string>")
    mode = F.upper(T.strip(raw["failure_mode"]))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(raw["confidence_score"].try_cast("double"), F.lit(0.0))))
    permanent = F.coalesce(~F.lower(raw["permanent_fix_recommended"]).isin("false", "", "0", "0.0"), F.lit(False))
    known = F.struct(
        mode.alias("failure_mode"), confidence.alias("confidence_score"), permanent.alias("permanent_fix_recommended"),
        F.coalesce(raw["rationale"], F.lit("")).alias("rationale"), F.coalesce(raw["immediate_fix"], F.lit("")).alias("immediate_fix"),
    )
    return F.when(F.btrim(text).startswith("{") & mode.isin(*FAILURE_MODES), known)


def answer_text(response: Column) -> Column:
    """Text of a model's response in JSON: a message's content, else content, else the parts of the first candidate; '' without one."""
    text = lambda path: F.nullif(F.get_json_object(response, path), F.lit(""))
    parts = F.from_json(F.get_json_object(response, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    joined = F.nullif(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.lit(""))
    return F.coalesce(text("$.message.content"), text("$.content"), joined, F.lit(""))


def script_records(lines: DataFrame) -> DataFrame:
    """``lines`` (line_no, value) of a script's output -> records; lines that aren't JSON objects are skipped and keep their number."""
    raw = F.from_json("value", "struct<url:string,title:string,content:string,metadata:struct<depth:int>>")
    good = lines.where(F.try_parse_json("value").isNotNull() & F.btrim("value").startswith("{")).withColumn("r", raw)
    content = F.coalesce("r.content", F.lit(""))
    paragraphs = F.transform(sections.prose_blocks(content), lambda p: block("paragraph", text=p))
    url = F.coalesce("r.url", F.lit(""))
    return good.select(
        url.alias("url"), F.nullif(url, F.lit("")).alias("canonical_url"), F.coalesce("r.metadata.depth", F.lit(0)).alias("depth"), F.col("line_no").cast("int").alias("order_index"),
        F.coalesce("r.title", F.concat(F.lit("Page "), (F.col("line_no") + 1).cast("string"))).alias("title"), paragraphs.cast(f"array<{BLOCK}>").alias("content_blocks"),
        sections.code_blocks(content).alias("code_blocks"), F.nullif(U.domain(url), F.lit("")).alias("source_domain"),
    )


def after_quality(states: DataFrame) -> DataFrame:
    """``states`` with ``phase``, retries and exhausted after their records were measured (structural, passed, words, n_records).

    Done if the records pass or are one dense document. A retried crawl (no detection) with nothing left to widen and one record at most ends,
    too. Otherwise the failure is diagnosed, within three retries."""
    single = (F.col("n_records") == 1) & (F.col("structural") >= 0.95) & (F.col("words") >= SINGLE_DOCUMENT_WORDS)
    stalled = F.col("detection").isNull() & (F.col("retries") > 0) & (F.col("n_records") <= 1) & F.col("include_sparse") & F.col("max_depth").isNull()
    phase = (
        F.when(F.col("passed") | single, "done")
        .when(stalled, F.when(F.col("n_records") > 0, "done").otherwise("failed"))
        .otherwise("feedback")
    )
    out = states.withColumn("phase", phase)
    again = (F.col("phase") == "feedback") & (F.col("retries") < MAX_RETRIES)
    return out.withColumn("exhausted", (F.col("phase") == "feedback") & ~again).withColumn("retries", F.col("retries") + again.cast("int"))


def after_feedback(states: DataFrame) -> DataFrame:
    """``states`` with ``phase`` after a diagnosis: corrected, or at the end of the retries what there is."""
    end = F.when(F.col("n_records") > 0, "done").otherwise("failed")
    return states.withColumn("phase", F.when(F.col("exhausted"), end).otherwise("correct"))


def corrected(states: DataFrame) -> DataFrame:
    """``states`` with the next ``phase`` and the changed detection, include_sparse, max_depth and workers.

    A framework's script is written anew for failures that a script can mend, and otherwise by the plain ladder, too. A crawl slows down when
    it was limited, or takes sparse pages when it found nothing. The ladder: a sitemap gives way to a crawl, other structured
    sources are accepted, and a crawl first takes sparse pages and then loses its depth limit.
    """
    mode, none = F.col("failure_mode"), F.col("detection").isNull()
    is_script, is_sitemap = F.coalesce(F.col("detection") == "framework", F.lit(False)), F.coalesce(F.col("detection") == "sitemap", F.lit(False))
    slow = F.coalesce(none & (mode == "RATE_LIMITED"), F.lit(False))
    thin = F.coalesce(none & mode.isin("EMPTY_CONTENT", "JS_NOT_RENDERED") & ~F.col("include_sparse"), F.lit(False))
    ladder = none & ~slow & ~thin
    wider, deeper = ladder & ~F.col("include_sparse"), ladder & F.col("include_sparse")
    return states.select(
        *(c for c in states.columns if c not in ("phase", "detection", "include_sparse", "max_depth", "workers")),
        F.when(is_script, "script").when(none | is_sitemap, "crawl").otherwise("done").alias("phase"),
        F.when(~is_sitemap, F.col("detection")).alias("detection"),
        (F.col("include_sparse") | thin | wider).alias("include_sparse"),
        F.when(~deeper, F.col("max_depth")).alias("max_depth"),
        F.when(slow, 1).otherwise(F.col("workers")).alias("workers"),
        (is_script & F.coalesce(mode.isin(*SCRIPT_MODES), F.lit(False))).alias("uses_report"),
    )


def first_phase(detection: Column) -> Column:
    """Where a run goes after probing."""
    return F.when(detection == "llms_txt", "llms").when(detection == "sitemap", "sitemap").when(detection == "openapi", "openapi").when(detection == "framework", "script").otherwise("crawl")

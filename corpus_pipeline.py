"""A training corpus from raw documents: five stages, each the table that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docflow.llm import decontaminate, linededup, minhash, mixing, quality
from docflow.llm.folds import held_out
from docflow.llm.workspace import Workspace


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3, by a classifier of the labelled documents outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    scored = quality.score(docs, quality.fit(docs, labels), score_col="__quality")
    return scored.where("__quality >= 0.3").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents stay in the last of them only; n_chars follows the text."""
    kept = linededup.drop_repeated_lines(docs, min_chars=20, min_docs=3)
    if "n_chars" in docs.columns:
        kept = kept.selectExpr(*(f"cast(length(text) as {docs.schema[c].dataType.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))
    return kept


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Jaccard similarity of five-word shingles of 0.8 or more."""
    return minhash.one_of_each(docs, shingle_words=5, percent=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the copies that even sources out: none is seen more than four times as often as the largest."""
    mixed = mixing.mix(docs, repeats=4.0)
    return mixed.where(f"`{mixing.output_names(docs.columns)['copies']}` > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", reject_low_quality),
    ("line dedup", dedup_lines),
    ("near-duplicates", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("source mixing", mix_sources),
]

#: A trained classifier and the hash order of the mixture aren't SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

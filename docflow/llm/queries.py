"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docflow.llm import decontaminate, itq, langid, linededup, minhash, mixing, pagediff, quality, quotes, secrets
from docflow.llm.folds import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out("doc_id")))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(_table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.line_digest(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), entropy=0.99, rounds_of_corpus=1.0)
    return out.select("doc_id", "source", "n_tokens", "weight", "copies", "order_key")


def op7_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.conversations(_table(spark, sf_dir, "conversations"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out("doc_id")))
    out = langid.identify(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_page_text": op2_page_text,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_quotation_chat": op7_quotation_chat,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_language_id": op9_language_id,
    "op10_minhash": op10_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.key IS NOT NULL AND o.keeper <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE o.key IS NULL OR o.keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON o.key = k.key
GROUP BY k.doc_id
""",
    "op5_secret_scan": r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(rank, kind, pattern) AS (VALUES
    (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
    (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'entropy', '[A-Za-z0-9+/_=-]{20,}')),
likely AS (SELECT * FROM texts, kinds WHERE regexp_matches(t, pattern)),
cut AS (
    SELECT doc_id, rank, kind, regexp_extract_all(t, pattern) AS found, regexp_split_to_array(t, pattern) AS gaps FROM likely
), each AS (
    SELECT doc_id, rank, kind, unnest(found) AS value, unnest(gaps[:len(found)]) AS gap, generate_subscripts(found, 1) AS i FROM cut
), placed AS (
    SELECT doc_id, rank, kind, value, sum(length(gap) + length(value)) OVER (PARTITION BY doc_id, rank ORDER BY i)::BIGINT AS stop FROM each
), runs AS (
    SELECT *, row_number() OVER () AS run FROM placed
    WHERE kind = 'entropy'
      AND NOT regexp_matches(value, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
      AND lower(value) NOT IN ('d41d8cd98f00b204e9800998ecf8427e', 'da39a3ee5e6b4b0d3255bfef95601890afd80709', 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855')
      AND NOT regexp_matches(lower(value), '(example|placeholder|changeme|your[_-]?(api[_-]?)?key|xxxxx|abcdefghij|0123456789)')
      AND NOT regexp_matches(value, '^([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$')
), windows AS (SELECT run, value, unnest(range(1, length(value) - 18)) AS pos FROM runs),
letters AS (SELECT run, value, pos, unnest(str_split(substr(value, pos, 20), '')) AS c FROM windows),
counted AS (SELECT run, value, pos, c, count(*) AS n FROM letters GROUP BY ALL),
measured AS (
    SELECT run, any_value(value) AS value, 86438562 - sum(round(n * log2(n) * 1e6)::BIGINT) AS entropy FROM counted GROUP BY run, pos
), high AS (
    SELECT DISTINCT run FROM measured WHERE entropy >= CASE WHEN regexp_matches(value, '^[0-9a-fA-F]+$') THEN 60000000 ELSE 74000000 END
), spans AS (
    SELECT doc_id, rank, kind, stop - length(value) AS start, stop FROM placed
    WHERE (kind = 'assign' AND length(regexp_extract(value, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12)
       OR (kind = 'access' AND length(value) >= 18) OR (kind = 'hex' AND length(value) >= 16)
    UNION ALL
    SELECT doc_id, rank, kind, stop - length(value), stop FROM runs JOIN high USING (run)
)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, rank) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id
GROUP BY t.doc_id
""",
    "op10_minhash": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
    FROM words
), sized AS (SELECT doc_id, s, len(s) AS n FROM shingles),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
frequent AS (SELECT g, count(*) AS df FROM grams GROUP BY g),
ranked AS (
    SELECT doc_id, n, grams.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, grams.g) AS r
    FROM grams JOIN frequent USING (g)
), heads AS (SELECT * FROM ranked WHERE r <= n - (8 * n + 9) // 10 + 1),
pairs AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM heads a JOIN heads b ON a.g = b.g AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS (
    SELECT a, b FROM pairs JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, target) AS (
    SELECT doc_id, doc_id FROM sized
    UNION
    SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.target
), least_of AS (SELECT node, min(target) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sized JOIN least_of ON node = doc_id
""",
}

"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of character n-grams inside words (padded by one space at either end), with absolute
discounting and continuation counts for the lower orders. n-grams are counted on the executors, over a bounded sample of
labelled rows for each language; the models are stored as sorted arrays of 64-bit n-gram hashes, with a column for each language.
A text gets the language of the lowest cross-entropy per character. A temperature and a bound on the entropy, both fitted on a part of
the sample that the counts don't use, turn it into a calibrated probability and a rejection.

Words are runs of what isn't ASCII white space, in lower case.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows with null language are never learned
from; with no row to learn from, everything is ``und``. Ties go to the first language by name. Ids are integers; a text that isn't one stops the job with
Spark's cast error. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docflow.llm.wordcache import WordSums
from docflow.llm.words import mix64, word_chunks

UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased, padded words, end to end; and where each begins."""
    text = "".join(f" {w.lower()} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(w.lower()) + 2 for w in words], dtype=np.int64)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """At [n][i]: the hash of the n characters that end before i + 1 (garbage where fewer precede); n from 0."""
    hashes = [np.zeros(len(codes), dtype=np.uint64)]
    for n in range(1, order + 1):
        # a gram is its last character appended to the gram before it, so that contexts are found without it
        before = np.concatenate([np.zeros(1, dtype=np.uint64), hashes[n - 1][:-1]]) if n > 1 else np.zeros(len(codes), dtype=np.uint64)
        hashes.append(mix64(before * _STEP + codes.astype(np.uint64) + np.uint64(n)))
    return hashes


@dataclass
class Model:
    """grams/contexts: for each order sorted hashes; logp and backoff: a row for each hash, a column for each language."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    most_entropy: float = float("inf")
    least_score: float = 0.0

    def word_values(self, words: list[str]) -> np.ndarray:
        """Of each word: summed log-probabilities by language, characters, letters."""
        codes, begins = _codes(words)
        offset = np.arange(len(codes)) - np.repeat(begins[:-1], np.diff(begins))
        hashes = gram_hashes(codes, self.order)
        total = np.zeros((len(codes), len(self.languages)))
        todo = np.flatnonzero(offset > 0)  # the leading space is context only
        for n in range(self.order, 0, -1):
            can = todo[offset[todo] >= n - 1]
            rest = todo[offset[todo] < n - 1]
            found, rows = _lookup(self.grams[n], hashes[n][can])
            total[can[found]] += self.logp[n][rows[found]]
            missed = can[~found]
            if n > 1:
                has, at = _lookup(self.contexts[n - 1], hashes[n - 1][missed - 1])
                total[missed[has]] += self.backoff[n - 1][at[has]]
            else:
                total[missed] += self.floor
            todo = np.concatenate([rest, missed])
        sums = np.add.reduceat(total, begins[:-1], axis=0)
        letters = [sum(c.isalpha() for c in w) for w in words]
        return np.column_stack([sums, np.diff(begins) - 1, letters])

    def predict(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From summed word values: index of the language (-1: no letter), calibrated probability, rejected."""
        scores, chars, letters = sums[:, :-2], sums[:, -2], sums[:, -1]
        entropy = -scores / np.maximum(chars, 1)[:, None]
        best = np.argmin(entropy, axis=1)
        weight = np.exp(-(entropy - entropy.min(axis=1, keepdims=True)) * self.temperature)
        score = 1 / weight.sum(axis=1)
        rejected = (score < self.least_score) | (entropy.min(axis=1) > self.most_entropy)
        none = letters < 0.5
        return np.where(none, -1, best), np.where(none, 0.0, score), rejected | none


def _lookup(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    found = at < len(table)
    found[found] = table[at[found]] == wanted[found]
    return found, at


def _count_grams(order: int):
    """(lang, text) -> (lang, gram, n), summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, Counter())
                for word, n in Counter(_WORD.findall(text or "")).items():  # words as in scoring
                    padded = f" {word.lower()} "
                    for end in range(2, len(padded) + 1):
                        own[padded[max(0, end - order) : end]] += n  # the longest gram that ends here
        rows = [(lang, gram, n) for lang, own in counts.items() for gram, n in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], ["lang", "gram", "n"])

    return run


def _chain(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points, as ``gram_hashes`` chains them."""
    out = np.zeros(len(codes), dtype=np.uint64)
    for j in range(codes.shape[1]):
        out = mix64(out * _STEP + codes[:, j].astype(np.uint64) + np.uint64(j + 1))
    return out


@dataclass
class _Level:
    """The n-grams of one language and one n, sorted by hash: code points, counts, probabilities; and the weights of their contexts."""

    codes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    prob: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


def _levels(codes: np.ndarray, sizes: np.ndarray, n: np.ndarray, order: int, discount: float, alphabet: int) -> list[_Level]:
    """Levels 1 to ``order`` of one language. codes: rows of ``order`` code points of which the first ``size`` count."""
    levels: list[_Level] = []
    above = np.zeros((0, order + 1), dtype=codes.dtype)
    for size in range(order, 0, -1):
        # a shorter gram counts the characters before it; at the start of a word, occurrences
        own = sizes == size
        rows = np.concatenate([codes[own][:, :size], above[:, 1 : size + 1]])
        counts = np.concatenate([n[own].astype(np.float64), np.ones(len(above))])
        hashes, first, inverse = np.unique(_chain(rows), return_index=True, return_inverse=True)
        above = rows[first]
        none = np.zeros(0)
        levels.insert(0, _Level(above, hashes, np.bincount(inverse, weights=counts, minlength=len(hashes)), none, none, none))
    lower = np.full(len(levels[0].hashes), 1 / alphabet)
    for at, level in enumerate(levels):
        if at:
            lower = levels[at - 1].prob[np.searchsorted(levels[at - 1].hashes, _chain(level.codes[:, 1:]))]
        level.contexts, which = np.unique(_chain(level.codes[:, :-1]), return_inverse=True)
        total = np.bincount(which, weights=level.counts, minlength=len(level.contexts))
        level.weight = discount * np.bincount(which, minlength=len(level.contexts)) / total
        level.prob = (level.counts - discount) / total[which] + level.weight[which] * lower
    return levels


def build(counts: pd.DataFrame, order: int, discount: float = 0.75) -> Model:
    """``counts`` (lang, gram, n): the longest grams, those at the start of a word are shorter. Level by level over sorted arrays of hashes."""
    languages = sorted(counts.lang.unique())
    sizes = np.fromiter(map(len, counts.gram), dtype=np.int64, count=len(counts))
    flat = np.frombuffer("".join(counts.gram).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.zeros((len(counts), order), dtype=np.uint32)
    codes[np.arange(order)[None, :] < sizes[:, None]] = flat
    alphabet = len(np.unique(flat)) + 1
    lang, n = counts.lang.to_numpy(), counts.n.to_numpy()
    models = [_levels(codes[lang == x], sizes[lang == x], n[lang == x], order, discount, alphabet) for x in languages]

    grams, logp = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, len(languages)))]
    contexts, backoff = [], []
    before = np.full((1, len(languages)), 1 / alphabet)
    for at in range(order):
        every = np.concatenate([m[at].codes for m in models])
        hashes, first = np.unique(np.concatenate([m[at].hashes for m in models]), return_index=True)
        rows = every[first]
        # of a language without the gram: that of the gram less its first character, times the weight of its context
        shorter = before[np.searchsorted(grams[at], _chain(rows[:, 1:])) if at else np.zeros(len(rows), dtype=np.int64)]
        value = np.empty((len(rows), len(languages)))
        for j, m in enumerate(models):
            found, where = _lookup(m[at].hashes, hashes)
            has, of = _lookup(m[at].contexts, _chain(rows[:, :-1]))
            weight = np.ones(len(rows))
            weight[has] = m[at].weight[of[has]]
            value[:, j] = weight * shorter[:, j]
            value[found, j] = m[at].prob[where[found]]
        grams.append(hashes)
        logp.append(np.log(value))
        before = value
        known = np.unique(np.concatenate([m[at].contexts for m in models]))
        weights = np.ones((len(known), len(languages)))
        for j, m in enumerate(models):
            weights[np.searchsorted(known, m[at].contexts), j] = m[at].weight
        contexts.append(known)
        backoff.append(np.log(weights))
    return Model(languages, order, grams, logp, contexts, backoff, backoff[0][0] - np.log(alphabet))


def calibrate(model: Model, sums: np.ndarray, truth: np.ndarray) -> None:
    """Fit temperature by likelihood; the entropy bound and least score so that 0.5 % of right texts would be rejected by each."""
    if not len(truth):
        return
    entropy = -sums[:, :-2] / np.maximum(sums[:, -2], 1)[:, None]
    best = (float("inf"), 1.0)
    for temperature in np.geomspace(1, 200, 40):
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * temperature
        loss = np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth])
        best = min(best, (float(loss), float(temperature)))
    model.temperature = best[1]
    index, score, _ = model.predict(sums)
    right = index == truth
    if right.any():
        model.most_entropy = float(np.quantile(entropy.min(axis=1)[right], 0.995)) * 1.25
        model.least_score = float(np.quantile(score[right], 0.005))


def _summed(model: Model, column: pa.Array, sums: WordSums) -> np.ndarray:
    return np.concatenate([np.zeros((0, len(model.languages) + 2)), *(sums.of(chunk) for chunk in word_chunks(column))])


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", key_col: str = "doc_id", rows_per_language: int = 800, order: int = 5) -> Model | None:
    """Learn from about ``rows_per_language`` rows of each language, those of the smallest hashes of ``key_col``."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).count().collect()  # one row for each language
    if not sizes:
        return None
    scale = 1 << 30
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(scale, rows_per_language * scale // r["count"] + 1))))
    dice = F.pmod(F.xxhash64(F.lit(23), F.col(key_col)), F.lit(scale))
    sample = rows.where(dice < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(29), F.col(key_col)), F.lit(5)).alias("part"))
    sample = sample.repartition(max(2, len(sizes)))
    counted = sample.where("part > 0").select("lang", "text").mapInArrow(_count_grams(order), "lang string, gram string, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = build(counts, order)
    names = {x: i for i, x in enumerate(model.languages)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordSums(model.word_values, len(names) + 2)
        for batch in batches:
            truth = [names.get(x, -1) for x in batch.column(0).to_pylist()]
            flat = pa.array(_summed(model, batch.column(1), cache).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(truth, pa.int32()), flat], ["truth", "sums"])

    checked = sample.where("part = 0").select("lang", "text").mapInArrow(held, "truth int, sums array<double>").where("truth >= 0").toPandas()
    if len(checked):
        calibrate(model, np.stack(checked.sums.to_list()), checked.truth.to_numpy())
    return model


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) per row: a learned language, or ``und`` without a letter."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cache = WordSums(own.word_values, len(own.languages) + 2)
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            index, score, rejected = own.predict(_summed(own, batch.column(1), cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[index], pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


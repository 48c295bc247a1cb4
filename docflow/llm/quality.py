"""Quality classifier: supervised subword embeddings.

Words and their character n-grams are hashed into one table of vectors; a document is the average of its vectors, and a
softmax layer makes probabilities of it (Joulin et al., 2016). Table and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows. As the score is linear in the average up to the softmax, scoring
needs one number for each bucket, which is broadcast; distinct words are hashed once for each task.

Defined cases: a null, empty or blank text gets the prior of the labels. With no labels, or only one kind, every
score is the share of label 1 (0.5 without any). A document with several labels counts once for each.
A word that equals the word before it counts as one common word of its own.
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

BUCKETS = 1 << 17
GRAMS = (3, 4)
#: Stands for a word that equals the word before it, so that repetition is learned for all words at once.
REPEAT = "\x01repeat"
#: A text's average holds the vector of this word as often as PAUSE features, so that a few words don't decide alone.
START, PAUSE = "\x02start", 40.0
_BLANK = re.compile(r"[\x20\x09-\x0D]+")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words, end to end, and where each word's begin: its own, then its n-grams."""
    text = "".join(f"<{w.lower()}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w.lower()) + 2 for w in words], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(words)), sizes)
    power = np.cumprod(np.full(len(codes) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    hashes, owners = [], []
    position = (np.arange(len(codes)) - begin[:-1][owner]).astype(np.int64)
    whole = np.add.reduceat(mix64(codes + np.uint64(1)) * power[position], begin[:-1])
    hashes.append(mix64(whole))
    owners.append(np.arange(len(words)))
    for n in GRAMS:
        if len(codes) < n:
            continue
        acc = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - n + 1 + j])
        inside = owner[: len(acc)] == owner[n - 1 :]
        hashes.append(acc[inside])
        owners.append(owner[: len(acc)][inside])
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return (np.concatenate(hashes)[order] % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(owners_all[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """weight: what a bucket adds to the log-odds of label 1, if it were alone; bias: log-odds without any."""

    weight: np.ndarray
    bias: float
    prior: float

    def word_values(self, words: list[str]) -> np.ndarray:
        buckets, begin = features(words)
        return np.column_stack([np.add.reduceat(self.weight[buckets], begin[:-1]), np.diff(begin)])

    def score(self, sums: np.ndarray) -> np.ndarray:
        start = self.word_values([START])[0]
        odds = self.bias + (sums[:, 0] + PAUSE * start[0] / start[1]) / (sums[:, 1] + PAUSE)
        return np.where(sums[:, 1] > 0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), self.prior)


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def train(texts: list[str], labels: np.ndarray, *, dims: int = 12, epochs: int = 6, rate: float = 1.5, seed: int = 5) -> Model:
    """Stochastic gradient descent, one document a step; the rate falls linearly to 0."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if len(labels) == 0 or prior in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), prior)
    bags = []
    for text in texts:
        words = [w for w in _BLANK.split(_ascii_lower(text)) if w]
        if not words:
            bags.append(None)
            continue
        counts = Counter(REPEAT if w == before else w for before, w in zip([None, *words], words, strict=False))
        buckets, begin = features([*counts, START])
        sizes = np.diff(begin)
        weight = np.repeat(np.array([*counts.values(), PAUSE / sizes[-1]], dtype=np.float64), sizes)
        distinct, inverse = np.unique(buckets, return_inverse=True)
        share = np.bincount(inverse, weights=weight)
        bags.append((distinct, (share / share.sum()).astype(np.float32)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    layer = np.zeros((dims, 2), dtype=np.float32)
    bias = np.log(np.array([1 - prior, prior], dtype=np.float32))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now = np.float32(rate * (1 - done / steps))
            done += 1
            if bags[i] is None:
                continue
            buckets, share = bags[i]
            hidden = share @ table[buckets]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = layer @ p
            layer -= now * np.outer(hidden, p)
            bias -= now * np.float32(0.1) * p
            # an average spreads the gradient thin: rows move by their share of the text, scaled to the mean share
            table[buckets] -= (now * len(share) * share)[:, None] * back * np.float32(0.05)
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]), prior)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000) -> Model:
    """Learn from at most ``sample_rows`` labels (those of the smallest hashes of the id) and the texts they belong to."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    chosen = known.withColumn("_dice", F.xxhash64(F.lit(31), "_id")).orderBy("_dice", "_id", "_label").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text").toPandas()  # sample_rows bounds it
    rows = rows.sort_values(["_id", "_label", "_text"], kind="stable", na_position="first")
    return train([t if isinstance(t, str) else "" for t in rows["_text"]], rows["_label"].to_numpy(dtype=np.int64))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` from 0 to 1: how likely label 1 is. It takes the place of a column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of BUCKETS

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = WordSums(shared.value.word_values, 2, REPEAT)
        for batch in texts:
            sums = [cache.of(chunk) for chunk in word_chunks(pa.array(batch, pa.string(), from_pandas=True))]
            yield pd.Series(shared.value.score(np.concatenate([np.zeros((0, 2)), *sums])))

    return docs.withColumn(score_col, scores(F.col(text_col).cast("string")))

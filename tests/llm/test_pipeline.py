"""The pipeline after its trained first stage, against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def _lines(docs):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(LOWER)
    for doc, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(doc)
    goes = lambda doc, line: len(holders.get(key(line), ())) >= 3 and doc != max(holders[key(line)])
    return {doc: "\n".join(x for x in (text or "").split("\n") if not goes(doc, x)) for doc, text in docs.items()}


def _shingles(words, k):
    if len(words) < k:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def _one_of_each(docs):
    sets = {doc: set(_shingles(WORD.findall(text.translate(LOWER)), 5)) for doc, text in docs.items()}
    lead = {doc: doc for doc in docs}

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return {doc: text for doc, text in docs.items() if find(doc) == doc}


def _clean(docs, items):
    words = lambda text: [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]
    bench = [Counter(_shingles(words(x), 5)) for x in items]

    def dirty(text):
        own = _shingles(words(text), 5)
        for item in bench:
            n = sum(item.values())
            for at in range(max(1, len(own) - n + 1)):
                part = Counter(own[at : at + n])
                common = sum((part & item).values())
                if common and 100 * common >= 80 * (sum(part.values()) + n - common):
                    return True
        return False

    return {doc: text for doc, text in docs.items() if not dirty(text)}


def test_stages_after_the_classifier(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.reject_low_quality(spark, docs, sf)
    want = {r.doc_id: r.text for r in good.collect()}
    want = _clean(_one_of_each(_lines(want)), [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(WORD.findall(r.text)) and 1 <= r.copies <= 4 for r in out)
    assert len({(r.source, r.weight) for r in out}) == len({r.source for r in out})

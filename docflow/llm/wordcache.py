"""Per-word values, computed once for each word of a task, and summed over texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from docflow.llm.words import Words

#: A full cache is emptied; results don't depend on it.
CACHE_WORDS = 1_000_000


class WordSums:
    """``values(list of words) -> array (words x width)``: sums of these rows over the words of each text.

    ``repeat``: the word that stands for a word equal to the one before it, if any."""

    def __init__(self, values: Callable[[list[str]], np.ndarray], width: int, repeat: str | None = None):
        self.values, self.width = values, width
        self.repeat = None if repeat is None else values([repeat])[0]
        self.known = np.zeros(0, dtype=np.uint64)
        self.rows = np.zeros((0, width))

    def of(self, words: Words) -> np.ndarray:
        if not len(words.hash):
            return np.zeros((words.rows, self.width))
        distinct, first, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == distinct[hit]
        fresh = np.flatnonzero(~hit)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known, self.rows = np.zeros(0, dtype=np.uint64), np.zeros((0, self.width))
            fresh = np.arange(len(distinct))
        if len(fresh):
            rows = self.values([words.text(i) for i in first[fresh].tolist()])
            known = np.concatenate([self.known, distinct[fresh]])
            order = np.argsort(known, kind="stable")
            self.known, self.rows = known[order], np.concatenate([self.rows, rows])[order]
            at = np.searchsorted(self.known, distinct)
        each = self.rows[at][inverse]
        if self.repeat is not None:
            again = words.hash[1:] == words.hash[:-1]
            firsts = words.bounds[(words.bounds > 0) & (words.bounds < len(words.hash))]
            again[firsts - 1] = False
            each[1:][again] = self.repeat
        total = np.zeros((len(each) + 1, self.width))
        np.cumsum(each, axis=0, out=total[1:])
        return total[words.bounds[1:]] - total[words.bounds[:-1]]

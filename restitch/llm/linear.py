"""Hashed linear models: sparse logistic regression on which words and word beginnings a text holds.

Words are runs of letters and digits, lower-cased; they and their beginnings (for families of
words) are hashed into `1 << BITS` features. A feature is there or not, however long the text. Models are fitted by
proximal gradient steps (L1) on a bounded sample, and score texts where they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np

from restitch.llm.common import of_worker

BITS = 20
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")


def ids_of_word(word: str) -> set[int]:
    starts = {word[:n] + "-" for n in PREFIXES if n < len(word)}
    mask = (1 << BITS) - 1
    return {zlib.crc32(part.encode("utf-8", "surrogatepass")) & mask for part in (word, *starts)}


class Hasher:
    """Features of texts, with the words of this worker cached."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def of_word(self, word: str) -> bytes:
        return np.array(sorted(ids_of_word(word)), dtype=np.int32).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        words = set(_WORD.findall(text.lower()))
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for word in words.difference(known):
            known[word] = self.of_word(word)
        return np.unique(np.frombuffer(b"".join([known[w] for w in words]), dtype=np.int32))


def features(text: str) -> np.ndarray:
    return of_worker("word features", Hasher)(text)


@dataclass
class Rows:
    """Rows of feature ids in one flat array."""

    ids: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, lists: Iterable[np.ndarray]) -> Rows:
        lists = list(lists)
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        return cls(ids, np.repeat(np.arange(len(lists), dtype=np.int32), sizes), len(lists))

    def take(self, rows: np.ndarray) -> Rows:
        new = np.full(self.n, -1, np.int32)
        new[rows] = np.arange(len(rows))
        there = new[self.row] >= 0
        return Rows(self.ids[there], new[self.row[there]], len(rows))


@dataclass
class Model:
    """Weights of hashed words and of a few dense inputs beside them."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def predict(self, x: Rows, dense: np.ndarray) -> np.ndarray:
        total = np.full(x.n, self.bias)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, x.ids), len(self.ids) - 1)
            total += np.bincount(x.row, np.where(self.ids[at] == x.ids, self.weights[at], 0.0), x.n)
        if len(self.dense):
            total += dense @ self.dense
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


class Scorer:
    """Scores texts by a model without dense inputs; of a word only the features that have a weight are kept."""

    def __init__(self, model: Model) -> None:
        self.weights = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
        self.bias = model.bias
        self.starts: dict[str, int] = {}
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> None:
        """Put words into the recent generation; beginnings are few and have a table of their own."""
        weights, starts, mask = self.weights, self.starts, (1 << BITS) - 1
        if len(starts) > 2 * CACHE_WORDS:
            starts.clear()
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) & mask]
                for n in PREFIXES:
                    if n >= len(word):
                        break
                    start = word[:n]
                    at = starts.get(start)
                    if at is None:
                        at = starts[start] = zlib.crc32((start + "-").encode("utf-8", "surrogatepass")) & mask
                    found.append(at)
                ids = tuple(at for at in found if at in weights)
            self.recent[word] = ids

    def score(self, text: str, more: set[int]) -> float:
        """Probability for the words of a text and `more` features."""
        words = set(_WORD.findall(text.lower()))
        if len(self.recent) > CACHE_WORDS:
            # Words of the older generation that are met again come back without being hashed.
            self.older, self.recent = self.recent, {}
        self._learn(words.difference(self.recent))
        ids = set(chain.from_iterable(map(self.recent.__getitem__, words)))
        ids |= self.weights.keys() & more
        total = self.bias + sum(map(self.weights.__getitem__, sorted(ids)))
        return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def scorer_of_worker(name: str, model: Model) -> Scorer:
    """One for each Python worker, so that its words serve all tasks; only that of the last model is kept."""
    return of_worker(name, lambda: Scorer(model))


def fit(
    x: Rows,
    dense: np.ndarray,
    y: np.ndarray,
    most_features: int = 4096,
    least_rows: int = 3,
    l1: float = 1.0,
    steps: int = 300,
) -> Model:
    """Fit to targets from 0 to 1. One target only, or no rows, give a constant model.

    The words that differ most between the targets (by chi-square, at least `least_rows` rows
    each) take part; `l1` is the penalty in units of one row's largest gradient.
    """
    if not x.n:
        return Model(bias=0.0, dense=np.zeros(dense.shape[1]))
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    prior = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Model(bias=prior, dense=np.zeros(dense.shape[1]))
    seen = np.bincount(x.ids, minlength=1 << BITS)
    positive = np.bincount(x.ids, y[x.row], 1 << BITS)
    expected = seen * share
    spread = expected * (1 - share) * (1 - seen / x.n)
    chi = np.where((seen >= least_rows) & (spread > 0), (positive - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:most_features]
    chosen = np.sort(best[chi[best] > 0])
    at = np.searchsorted(chosen, x.ids) if len(chosen) else np.zeros(len(x.ids), np.int64)
    there = chosen[np.minimum(at, len(chosen) - 1)] == x.ids if len(chosen) else np.zeros(len(x.ids), bool)
    col, row = at[there], x.row[there]
    k = len(chosen)
    w, d, b = np.zeros(k), np.zeros(dense.shape[1]), prior
    # Steps that can't overshoot: a column's curvature is at most a quarter of the sums of its rows.
    sums = np.bincount(row, minlength=x.n) + np.abs(dense).sum(axis=1) + 1
    curve = 0.25 * np.maximum(np.bincount(col, sums[row], k), 1)
    dense_curve = 0.25 * np.maximum((np.abs(dense) * sums[:, None]).sum(axis=0), 1)
    bias_curve = 0.25 * sums.sum()
    ahead, ahead_d, ahead_b, momentum = w.copy(), d.copy(), b, 1.0
    for _ in range(steps):
        z = ahead_b + np.bincount(row, ahead[col], x.n) + dense @ ahead_d
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        step = ahead - np.bincount(col, error[row], k) / curve
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / curve, 0)
        new_d = ahead_d - (dense.T @ error) / dense_curve
        new_b = ahead_b - error.sum() / bias_curve
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pace = (momentum - 1) / following
        if ((new - w) * (ahead - new)).sum() > 0:  # it has gone too far: start the momentum anew
            following, pace = 1.0, 0.0
        ahead, ahead_d = new + pace * (new - w), new_d + pace * (new_d - d)
        ahead_b = new_b + pace * (new_b - b)
        w, d, b, momentum = new, new_d, new_b, following
    kept = np.flatnonzero(w)
    return Model(chosen[kept], w[kept], d, b)

"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good (1), bad (-1) or not at all (0). How often each pattern of votes
occurs is counted over all documents, at most `3 ** len(LABELLERS)` numbers; from them EM
estimates what each labeller says of good and of bad documents, and so the probability that
a document with a pattern is good. These posteriors are the targets of a linear scorer over
hashed words, word beginnings and binned measures of the text, fitted on at most
`MOST_TRAINING` documents, a bound that is a parameter. Every document is scored.

Null and empty texts have no words: only the labeller of length votes, against them. Repeated
rows get equal results; copies in the training sample count once. An empty table gives no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm import linear
from restitch.llm.common import bounded_sample, checkpoint, text_of, whole
from restitch.llm.quality_rules import statistics

MOST_TRAINING = 5_000
KEEP_FROM = 0.5
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def measures(text: str | None) -> dict[str, float]:
    words, chars, lines, symbols, dup_lines, repeats = statistics(text)
    n = max(words, 1)
    counts = Counter((text or "").split())
    return {
        "words": float(words),
        "word_length": chars / n,
        "symbols": symbols / max(chars, 1),
        "dup_lines": dup_lines / max(lines, 1),
        "repeats": repeats / n,
        "upper": len(_UPPER.findall(text or "")) / max(chars, 1),
        "commonest": max(counts.values(), default=0) / n,
        "different": len(counts) / n,
        "digits": sum(c.isdigit() for c in counts) / n,
        "lines": float(lines),
    }


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(good)


# Name and vote of each labeller, from the measures of a text: finders of faults vote bad or not
# at all, finders of plain prose good or not at all. They overlap, and none is always right.
LABELLERS: list[tuple[str, Callable[[dict[str, float]], int]]] = [
    ("no_words", lambda m: _vote(m["words"] < 5, False)),
    ("symbols", lambda m: _vote(m["symbols"] > 0.03, False)),
    ("repeats", lambda m: _vote(m["repeats"] > 0.25, False)),
    ("dup_lines", lambda m: _vote(m["dup_lines"] > 0.3, False)),
    ("word_length", lambda m: _vote(m["words"] > 0 and not 3 <= m["word_length"] <= 10, False)),
    ("upper", lambda m: _vote(m["upper"] > 0.3, False)),
    ("commonest", lambda m: _vote(m["words"] >= 20 and m["commonest"] > 0.3, False)),
    ("same_words", lambda m: _vote(m["words"] >= 50 and m["different"] < 0.15, False)),
    ("plain", lambda m: _vote(False, m["words"] > 0 and m["symbols"] < 0.005 and m["upper"] < 0.15)),
    ("varied", lambda m: _vote(False, m["words"] > 0 and m["repeats"] < 0.15 and (m["words"] < 20 or m["commonest"] < 0.2))),
    ("tidy", lambda m: _vote(False, m["dup_lines"] < 0.2 and 3 <= m["word_length"] <= 10 and m["symbols"] < 0.01)),
]


def pattern_of(m: dict[str, float]) -> int:
    """The votes as digits to base 3, the first labeller lowest; digit 0 is bad, 1 none, 2 good."""
    return sum((vote(m) + 1) * 3**k for k, (_, vote) in enumerate(LABELLERS))


def votes_of(patterns: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(labellers)], axis=1)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and `says[class, labeller, vote]`, from counted patterns.

    Starts from what a single bad vote suggests: faults are of different kinds and seldom meet
    in one document.
    """
    labellers = votes.shape[1]
    good = np.where((votes == 0).any(axis=1), 0.01, 0.99)
    says = np.full((2, labellers, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        for k in range(labellers):
            for v in range(3):
                says[:, k, v] = weight[:, votes[:, k] == v].sum(axis=1) + 0.1
        says /= says.sum(axis=2, keepdims=True)
        share = np.clip(weight.sum(axis=1) / max(weight.sum(), 1e-9), 0.01, 0.99)
        logs = np.log(share)[:, None] + sum(np.log(says[:, k, votes[:, k]]) for k in range(labellers))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - good).max(initial=0) < 1e-6:
            good = new
            break
        good = new
    return good, says


def _bins(m: dict[str, float]) -> set[int]:
    """Features that say which tenth or power of two each measure lies in."""
    bins = [f"#{k}:{int(log2(v + 1)) if k in ('words', 'lines', 'word_length') else int(v * 10)}" for k, v in m.items()]
    mask = (1 << linear.BITS) - 1
    return {zlib.crc32(b.encode()) & mask for b in bins}


def _features(text: str, m: dict[str, float]) -> np.ndarray:
    """Hashed words and bins."""
    return np.unique(np.concatenate([linear.features(text), np.array(sorted(_bins(m)), np.int32)]))


def vote_patterns(docs: DataFrame) -> DataFrame:
    def voted(texts: pd.Series) -> pd.Series:
        return pd.Series([pattern_of(measures(t)) for t in texts], dtype="int32")

    return docs.select("doc_id", text_of("text").alias("text")).select("doc_id", F.pandas_udf(voted, "int")("text").alias("pattern"))


def label_model(voted: DataFrame) -> tuple[dict[int, float], dict[str, tuple[float, float]]]:
    """Posterior by pattern, and for each labeller how often it is right on bad and on good documents it votes on."""
    counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()
    patterns = counted["pattern"].to_numpy(np.int64)
    if not len(patterns):
        return {}, {}
    good, says = expectation_maximisation(votes_of(patterns), counted["n"].to_numpy(float))
    # Of bad documents the share voted bad or not voted good; of good ones the other way round.
    right = {}
    for k, (name, _) in enumerate(LABELLERS):
        finds_good = says[:, k, 2].sum() > says[:, k, 0].sum()
        on_bad, on_good = (1 - says[0, k, 2], says[1, k, 2]) if finds_good else (says[0, k, 0], 1 - says[1, k, 0])
        right[name] = (float(on_bad), float(on_good))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), right


def train_scorer(docs: DataFrame, posterior: dict[int, float], most: int = MOST_TRAINING) -> linear.Model:
    def featured(texts: pd.Series) -> pd.DataFrame:
        rows = [(m := measures(t), _features(t, m)) for t in texts]
        return pd.DataFrame({"pattern": [pattern_of(m) for m, _ in rows], "ids": [ids for _, ids in rows]})

    texts = docs.select(text_of("text").alias("text"))
    # Chosen by their text, so of copies all or none; they count once.
    sample = bounded_sample(texts, most, "text")
    shape = F.pandas_udf(featured, "pattern int, ids array<int>")("text")
    rows = sample.distinct().select(shape.alias("x")).select("x.*").toPandas()
    rows["key"] = [np.asarray(i, np.int32).tobytes() for i in rows["ids"]]
    rows = rows.sort_values("key").reset_index(drop=True)
    y = np.array([posterior.get(p, 0.5) for p in rows["pattern"].tolist()])
    return linear.fit(linear.Rows.of(rows["ids"].tolist()), np.zeros((len(rows), 0)), y)


def score_column(model: linear.Model, text: Column) -> Column:
    name = uuid.uuid4().hex

    def scored(texts: pd.Series) -> pd.DataFrame:
        scorer = linear.scorer_of_worker(name, model)
        found = [(pattern_of(m := measures(t)), scorer.score(t, _bins(m))) for t in texts]
        return pd.DataFrame(found, columns=["pattern", "score"])

    return F.pandas_udf(scored, "pattern int, score double")(text)


def classify_quality(docs: DataFrame) -> DataFrame:
    """Each row of `docs (doc_id, text)` in `row`, with `posterior` (of its votes), `score` and `kept`."""
    voted = checkpoint(vote_patterns(docs))
    posterior, _ = label_model(voted)
    model = train_scorer(docs, posterior)
    scored = docs.select(whole(), score_column(model, text_of("text")).alias("s"))
    # At most 3 ** len(LABELLERS) rows.
    known = docs.sparkSession.createDataFrame(list(posterior.items()), "pattern int, posterior double")
    return scored.join(F.broadcast(known), F.col("s.pattern") == known["pattern"], "left").select(
        "row", "posterior", F.col("s.score").alias("score"), (F.col("s.score") >= KEEP_FROM).alias("kept")
    )

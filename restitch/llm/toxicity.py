"""Toxicity: a chain of classifiers; each sees the words and the probabilities of the categories before it.

Categories are predicted in order. A later model is fitted with out-of-fold probabilities of
the earlier ones, so it sees them as uncertain as they will be on new texts. Each model is a
hashed linear one (`linear`), fitted on at most `MOST_LABELLED` labelled documents, a bound
that is a parameter; every document is scored.

A category's threshold is the one with the best F-beta on the out-of-fold probabilities.

Null and empty texts have no words and get what the models give to none. Documents without
labels only get scored; labels of one document that differ count as the larger one. Without
labels all probabilities are even and nothing is flagged. Repeated rows get equal results. An empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm import linear
from restitch.llm.common import bounded_sample, text_of, whole

MOST_LABELLED = 5_000
FOLDS = 4
# Below 1, flagging a clean document counts for more than missing a toxic one.
BETA = 0.5


@dataclass
class Chain:
    categories: list[str]
    models: list[linear.Model]
    thresholds: list[float]

    def probabilities(self, x: linear.Rows) -> np.ndarray:
        found = np.zeros((x.n, 0))
        for model in self.models:
            found = np.column_stack([found, model.predict(x, _logits(found))])
        return found


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.001, 0.999)
    return np.log(p / (1 - p)) / 4


def best_threshold(p: np.ndarray, y: np.ndarray, beta: float = BETA) -> float:
    """Half way between the two probabilities where F-beta is best; 1 where nothing is positive."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    last = np.append(p[order][1:] != p[order][:-1], True)
    score = np.where(last, (1 + beta**2) * hit / (np.arange(1, len(p) + 1) + beta**2 * y.sum()), 0)
    k = int(np.argmax(score))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def fit_chain(x: linear.Rows, labels: np.ndarray, categories: list[str], fold: np.ndarray) -> Chain:
    """`labels`: 0 or 1, rows by categories; `fold`: a part from 0 to `FOLDS` - 1 for each row."""
    models, thresholds = [], []
    before = np.zeros((x.n, 0))
    for k in range(len(categories)):
        y, dense = labels[:, k].astype(float), _logits(before)
        unseen = np.zeros(x.n)
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            model = linear.fit(x.take(train), dense[train], y[train])
            unseen[test] = model.predict(x.take(test), dense[test])
        models.append(linear.fit(x, dense, y))
        thresholds.append(best_threshold(unseen, y))
        before = np.column_stack([before, unseen])
    return Chain(categories, models, thresholds)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = MOST_LABELLED) -> Chain:
    """Fit on labelled documents; `categories` are 0/1 columns of `labels`, in chain order."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(*[F.max(F.coalesce(c.cast("int"), F.lit(0))).alias(f"y{k}") for k, c in enumerate(categories.values())])
    # At most `most` rows with as many words as their documents have; the ids come to the executors by broadcast.
    chosen = bounded_sample(known, most, "doc_id")
    hashed = F.pandas_udf(_feature_lists, "array<int>")
    text = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = text.select("doc_id", *[f"y{k}" for k in range(len(categories))], hashed("text").alias("ids")).toPandas()
    # Copies count once, and stay in one fold.
    rows["key"] = [np.asarray(ids, np.int32).tobytes() for ids in rows["ids"]]
    rows = rows.sort_values(["key", "doc_id"]).drop_duplicates("key").sort_values("doc_id").reset_index(drop=True)
    ys = rows[[f"y{k}" for k in range(len(categories))]].to_numpy(int).reshape(len(rows), len(categories))
    fold = np.array([zlib.crc32(key) % FOLDS for key in rows["key"]], np.int64)
    return fit_chain(linear.Rows.of(rows["ids"].tolist()), ys, list(categories), fold)


def _feature_lists(texts: pd.Series) -> pd.Series:
    return pd.Series([linear.features(t) for t in texts], dtype=object)


def scorer(chain: Chain) -> Callable[[Column], Column]:
    names = [f"c{k}" for k in range(len(chain.categories))]

    def scored(texts: pd.Series) -> pd.DataFrame:
        found = chain.probabilities(linear.Rows.of(linear.features(t) for t in texts))
        return pd.DataFrame(found, columns=names)

    return F.pandas_udf(scored, ", ".join(f"{n} double" for n in names))


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """Each row of `docs (doc_id, text)` in `row`, with `p_<category>` and `is_<category>` for each."""
    chain = train(docs, labels, categories)
    judged = docs.select(whole(), scorer(chain)(text_of("text")).alias("p"))
    p = [F.col(f"p.c{k}").alias(f"p_{c}") for k, c in enumerate(chain.categories)]
    flags = [(F.col(f"p.c{k}") >= t).alias(f"is_{c}") for k, (c, t) in enumerate(zip(chain.categories, chain.thresholds, strict=True))]
    return judged.select("row", *p, *flags)

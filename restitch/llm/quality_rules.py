"""Quality rules: an isolation forest over rule statistics, its threshold set by labelled rows.

Statistics of a text (a word is a run of characters other than blank, tab, LF, VT, FF and CR):

* `n_words`, `word_chars` (code points inside words), `n_lines` (lines that hold a word);
* `n_symbols`: characters out of `#*$%&|<>`;
* `n_dup_lines`: lines with a word that equal an earlier line of the text;
* `n_repeat_words`: words covered by windows of eight words that occur twice or more.

`base_failed` marks texts of fewer than 20 words, or with over 30 % repeated words. The
forest sees ratios only, so that a text's length alone never makes it odd, and of mean
word length, equal lines and repeats only what exceeds a tolerance: rare but harmless
values would be as isolated as junk.

Null or empty texts have no words and fail the base rule. Repeated rows get equal
verdicts. An empty table gives no rows. Without usable labels the threshold is `DEFAULT_THRESHOLD`; with too few
distinct statistics to grow a tree nothing but the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.common import bounded_sample, checkpoint, of_worker, text_of, whole

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = "n_words long, word_chars long, n_lines long, n_symbols long, n_dup_lines long, n_repeat_words long"

# What ordinary texts show as well: mean word lengths, shares of equal lines and of repeated words.
WORD_LENGTH = (3.0, 10.0)
DUP_LINES = 0.3
REPEATS = MAX_REPEAT_PERCENT / 100

TREES = 100
# Rows that one tree is grown on: part of the method, not a cut of the data that is judged.
TREE_ROWS = 256
# Share of the labelled good documents that the threshold may reject.
GOOD_LOSS = 0.002
DEFAULT_THRESHOLD = 0.65
_BINS = 1 << 12


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of `WINDOW` words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # All windows of equal words have equal sums; if all sums differ, nothing is repeated.
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = sums * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    if len(np.unique(sums)) == n:
        return 0
    # Exact: number the windows of 2, 4 and 8 words, each by the pair of its halves.
    span = 1
    while span < WINDOW:
        pairs = ids[:-span] * np.int64(len(words)) + ids[span:]
        ids = np.unique(pairs, return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[WINDOW:] -= again
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def statistics(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text or "") - (len(raw) - len(raw.translate(None, SPACES))),
        len(lines),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _statistics_of(texts: pd.Series) -> pd.DataFrame:
    of_worker("statistics", dict)  # nothing is kept, but what others kept goes
    names = [part.split()[0] for part in STATS.split(", ")]
    return pd.DataFrame([statistics(t) for t in texts], columns=names, dtype="int64")


def text_statistics(text: Column) -> Column:
    return F.pandas_udf(_statistics_of, STATS)(text)


def base_failed(stats: str = "stats") -> Column:
    words = F.col(f"{stats}.n_words")
    repeats = F.col(f"{stats}.n_repeat_words")
    return (words < MIN_WORDS) | (repeats * 100 > words * MAX_REPEAT_PERCENT)


def ratios(stats: pd.DataFrame) -> np.ndarray:
    """What the rules measure, beyond what they tolerate: one row per text, one column per rule."""
    words = np.maximum(stats["n_words"].to_numpy(float), 1)
    length = stats["word_chars"].to_numpy(float) / words
    return np.column_stack(
        [
            np.maximum(np.maximum(WORD_LENGTH[0] - length, length - WORD_LENGTH[1]), 0),
            stats["n_symbols"] / np.maximum(stats["word_chars"], 1),
            np.maximum(stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1) - DUP_LINES, 0),
            np.maximum(stats["n_repeat_words"] / words - REPEATS, 0),
        ]
    ).astype(float)


def _unsplit_depth(size: np.ndarray) -> np.ndarray:
    """Mean depth that a random tree over `size` rows would still have."""
    n = np.maximum(size, 2).astype(float)
    return np.where(size > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, 0.0)


@dataclass
class Forest:
    """Trees in heap order: children of node i are 2i+1 and 2i+2; feature -1 is a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    normal: float
    threshold: float = DEFAULT_THRESHOLD

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1: alone after few splits; near 0.5 and below: like the others."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(f < 0, node, 2 * node + 1 + right)
            total += path[node]
        return 2.0 ** (-(total / max(len(self.feature), 1)) / self.normal)


def grow(sample: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest | None:
    """A forest over `sample` (rows by features); None if it holds fewer than two different rows."""
    if len(sample) < 2 or len(np.unique(sample, axis=0)) < 2:
        return None
    rng = np.random.default_rng(seed)
    take = min(tree_rows, len(sample))
    limit = int(np.ceil(np.log2(max(take, 2))))
    nodes = (1 << (limit + 1)) - 1
    feature = np.full((trees, nodes), -1, np.int64)
    split = np.zeros((trees, nodes))
    path = np.zeros((trees, nodes))
    for t in range(trees):
        open_nodes = [(0, 0, sample[rng.choice(len(sample), take, replace=False)])]
        while open_nodes:
            node, depth, rows = open_nodes.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth == limit or not len(usable):
                path[t, node] = depth + float(_unsplit_depth(np.array(len(rows))))
                continue
            f = int(rng.choice(usable))
            at = low[f] + (high[f] - low[f]) * (1 - rng.random())
            feature[t, node], split[t, node] = f, at
            right = rows[:, f] >= at
            open_nodes += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, split, path, max(float(_unsplit_depth(np.array(take))), 1.0))


def score_column(forest: Forest | None, stats: str = "stats") -> Column:
    if forest is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def scored(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(ratios(rows)))

    return scored(F.col(stats))


def _threshold(judged: DataFrame, labels: DataFrame) -> float:
    """Lowest score above which at most `GOOD_LOSS` of the labelled good rows lie.

    Counted over all labelled rows that pass the base rule, in a histogram of fixed size.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counted = (
        judged.join(known, "doc_id")
        .groupBy(F.floor(F.col("score") * _BINS).cast("int").alias("bin"), "quality")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    good, bad = np.zeros(_BINS + 1), np.zeros(_BINS + 1)
    for row in counted:
        (good if row["quality"] == 1 else bad)[min(max(row["bin"], 0), _BINS)] += row["n"]
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1]
    allowed = np.flatnonzero(lost <= GOOD_LOSS)
    if not len(allowed) or not caught[allowed[0]]:
        return 1.0
    # Of thresholds that catch the same rows the middle one, a margin for unlabelled rows on both sides.
    same = allowed[caught[allowed] == caught[allowed[0]]]
    return float(same[0] + same[-1]) / 2 / _BINS


def fit(measured: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold for rows `(doc_id, stats)`.

    Trees grow on a bounded sample (`TREES * TREE_ROWS` different statistics), in which
    copies count once; the threshold comes from all labelled rows.
    """
    passed = measured.where(~base_failed())
    different = passed.select("stats.*").distinct()
    sample = bounded_sample(different, TREES * TREE_ROWS, *different.columns).toPandas()
    sample = sample.sort_values(list(sample.columns)).reset_index(drop=True)
    forest = grow(ratios(sample))
    if forest is not None:
        forest.threshold = _threshold(passed.select("doc_id", score_column(forest).alias("score")), labels)
    return forest


def judge(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """Add `score`, `base_failed` and `kept` to rows with `stats`."""
    limit = forest.threshold if forest else 1.0
    return (
        measured.withColumn("score", score_column(forest))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") < limit))
    )


def measure(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), text_statistics(text_of("text")).alias("stats"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts `(doc_id, stats, score, base_failed, kept)` on every row of `docs (doc_id, text)`."""
    measured = checkpoint(measure(docs))
    return judge(measured, fit(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    Statistics are computed once to fit and again to filter, which moves no text.
    """
    forest = fit(checkpoint(measure(docs)), labels)
    rows = docs.select(whole(), text_statistics(text_of("text")).alias("stats"))
    return judge(rows, forest).where("kept").select("row.*")

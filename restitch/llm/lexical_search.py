"""Ranked lexical search: one automaton of all items' terms is run over the texts, with no index of the documents.

A term is a run of ASCII letters, digits and characters beyond ASCII; of the letters only A to Z
are lower-cased. In UTF-8 every byte of a term is one of these or above 127, so texts are searched
as bytes in which each other byte has become the guard, a blank. The automaton (Aho-Corasick)
holds every different term of the items between two guards, so it finds whole terms only, and two
terms in a row share the guard between them. Its outputs are term numbers, which lead to the
items that hold the term and how often.

Texts are scanned twice: once for the corpus (documents, terms, and in how many documents each of
the items' terms is), summed up in the tasks; once for the scores. Each task keeps the best `TOP`
documents of each item as it goes, so what is shuffled is at most `TOP` rows per item and batch of
documents, cut to `TOP` per item and task before the shuffle.

Weights: `w = floor(1000 ln((2N + 2) / (2df + 1)))`. A document of `n` terms has
`m = 100 - 75 + (75 n N) div L`, and scores the sum of `w ((10^9 tf) div (1000 tf + 8 m))` over
the item's terms, repeats included.

Items come in batches of at most about `BATCH_BYTES` bytes of terms and `BATCH_ITEMS` items (an item
is never split, so a longer one stands alone); each batch is broadcast and takes its own scans.

Null and empty texts hold no terms: such documents have no rank and do not count in N, such items
give no rows. Equal scores are in order of doc_id, null last. Every row is a document, so repeated rows and
repeated ids have a rank each; items of one item_id with different rows are ranked one by one, each
named by its item_id, and rows that are equal in all of this are interchangeable. A text is scanned whole, however long. Empty tables give no rows. Further
columns are not looked at.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restitch.llm.common import of_worker, text_of

TOP = 10
BATCH_BYTES = 4_000_000
BATCH_ITEMS = 4096
# Documents whose scores are held at once for all items of a batch.
SLICE_DOCUMENTS = 256
SLICE_SCORES = 1 << 20
# Candidates held before all but the best of each item are dropped.
MOST_CANDIDATES = 200_000
# The first stage of ranking deals each item out over so many groups.
SALTS = 16

_GUARD = b" "
# Every byte as it is searched: letters, digits and bytes above 127 stay (A to Z lower-cased), others are guards.
_SEARCHED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def searched(text: bytes) -> bytes:
    """The text between two guards, in the bytes that are searched."""
    return _GUARD + text.translate(_SEARCHED) + _GUARD


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_SEARCHED).split()


def count_terms(between_guards: bytes) -> int:
    """Terms in what `searched` gives, without making them."""
    is_term = np.frombuffer(between_guards, np.uint8) != 32
    return int(np.count_nonzero(is_term[1:] & ~is_term[:-1]))


@dataclass
class Items:
    """Some items: their ids, and for each different term the items with it and how often (`starts` cuts both)."""

    ids: list[int | None]
    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes]]) -> Items:
        places: dict[bytes, dict[int, int]] = {}
        for k, (_, text) in enumerate(rows):
            for term in terms_of(text):
                held = places.setdefault(term, {})
                held[k] = held.get(k, 0) + 1
        terms = sorted(places)
        sizes = [len(places[t]) for t in terms]
        return cls(
            [item_id for item_id, _ in rows],
            terms,
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            np.array([k for t in terms for k in places[t]], np.int64),
            np.array([n for t in terms for n in places[t].values()], np.int64),
        )


def automaton_of(terms: list[bytes]):
    """Automaton of the guarded terms over text in which a character stands for a byte."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        automaton.add_word((_GUARD + term + _GUARD).decode("latin-1"), k)
    automaton.make_automaton()
    return automaton


def _automaton(name: str, terms: list[bytes]):
    """One for each Python worker and batch of items; only the last is kept."""
    return of_worker(name, lambda: automaton_of(terms))


def found_terms(automaton, text: bytes | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms in a text, and which of the automaton's terms it holds how often."""
    guarded = searched(text or b"")
    found = np.fromiter((k for _, k in automaton.iter(guarded.decode("latin-1"))), np.int64)
    held, tf = np.unique(found, return_counts=True)
    return count_terms(guarded), held, tf.astype(np.int64)


def batches(benchmark: DataFrame, most_bytes: int = BATCH_BYTES, most_items: int = BATCH_ITEMS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items `(item_id, text)` in lists of bounded size; only one list is held at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of("text").cast("binary").alias("text"))
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"])
        if held and (size + len(text) > most_bytes or len(held) >= most_items):
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


def corpus_counts(docs: DataFrame, shared, name: str) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms in all, and for each term of a batch how many documents hold it."""

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        automaton = _automaton(name, terms)
        df = np.zeros(len(terms), np.int64)
        documents = total = 0
        for frame in frames:
            for text in frame.column("text"):
                n, held, _ = found_terms(automaton, text.as_py())
                documents += n > 0
                total += n
                df[held] += 1
        there = np.flatnonzero(df)
        # Numbers below zero stand for the sums over all terms.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1, -2], there])), pa.array(np.concatenate([[documents, total], df[there]]))], ["term", "n"]
        )

    summed = docs.select("text").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # At most as many rows as the batch has terms, and two.
    sums = {r["term"]: r["n"] for r in summed.collect()}
    df = np.zeros(len(shared.value.terms), np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(-1, 0), sums.get(-2, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int):
        self.least = np.ones(items, np.int64)
        self.kept = np.zeros((4, 0), np.int64)
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        """Scores of some documents (rows) for all items (columns)."""
        doc, item = np.nonzero(scores >= self.least)
        no_id = np.array([i is None for i in doc_ids], np.int64)
        known = np.array([i or 0 for i in doc_ids], np.int64)
        self.waiting.append(np.stack([item, scores[doc, item], no_id[doc], known[doc]]))
        self.held += len(doc)
        if self.held > MOST_CANDIDATES:
            self.cut()

    def cut(self) -> np.ndarray:
        """Rows of the best: item, score, whether the document has no id, its id."""
        found = np.concatenate([self.kept, *self.waiting], axis=1)
        found = found[:, np.lexsort((found[3], found[2], -found[1], found[0]))]
        item, score = found[0], found[1]
        rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
        self.kept = found[:, rank < TOP]
        last = rank == TOP - 1
        # Equal scores may still come with a smaller id.
        self.least[item[last]] = score[last]
        self.waiting, self.held = [], 0
        return self.kept


def _scored(docs: DataFrame, shared, name: str, documents: int, total: int, w: np.ndarray) -> DataFrame:
    """`(item, doc_id, score)`: of each task's documents the best of each item."""

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        automaton, best = _automaton(name, items.terms), Best(len(items.ids))
        fan = np.diff(items.starts)
        at_once = max(1, min(SLICE_DOCUMENTS, SLICE_SCORES // max(1, len(items.ids))))

        def of(ids: list[int | None], found: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            doc = np.repeat(np.arange(len(found)), [len(held) for _, held, _ in found])
            term, tf = (np.concatenate([f[k] for f in found]) for k in (1, 2))
            # Whole numbers of any size, before they are cut to 64 bits.
            m = np.array([25 + (75 * n * documents) // total for n, _, _ in found], np.int64)[doc]
            gained = w[term] * ((10**9 * tf) // (1000 * tf + 8 * m))
            many = fan[term]
            place = np.repeat(items.starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
            scores = np.zeros((len(found), len(items.ids)), np.int64)
            np.add.at(scores, (np.repeat(doc, many), items.items[place]), np.repeat(gained, many) * items.times[place])
            best.add(scores, ids)

        for frame in frames:
            ids, found = [], []
            for doc_id, text in zip(frame.column("doc_id").to_pylist(), frame.column("text"), strict=True):
                n, held, tf = found_terms(automaton, text.as_py())
                if len(held):
                    ids.append(doc_id)
                    found.append((n, held, tf))
                if len(found) == at_once:
                    of(ids, found)
                    ids, found = [], []
            if found:
                of(ids, found)
        item, points, no_id, doc = best.cut()
        doc_ids = pa.array(doc, mask=no_id.astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(item), doc_ids, pa.array(points)], ["item", "doc_id", "score"])

    return docs.mapInArrow(score, "item long, doc_id long, score long")


def _best_of(rows: DataFrame, *group: str) -> DataFrame:
    best_first = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= TOP)


def _ranked(spark: SparkSession, docs: DataFrame, rows: list[tuple[int | None, bytes]]) -> DataFrame:
    items = Items.of(rows)
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    documents, total, df = corpus_counts(docs, shared, name)
    scored = _scored(docs, shared, name, documents, total, weights(documents, df))
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    best = _best_of(_best_of(salted, "item", "salt"), "item")
    named = spark.createDataFrame([(k, item_id) for k, item_id in enumerate(items.ids)], "item long, item_id long")
    # A batch's items, of which there are at most `BATCH_ITEMS`.
    return best.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(item_id, rank, doc_id, score)`: the best `TOP` of `docs (doc_id, text)` for each row of `benchmark (item_id, text)`."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = [_ranked(spark, texts, rows) for rows in batches(benchmark)]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)

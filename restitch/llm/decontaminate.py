"""Benchmark decontamination: test items found in documents up to an edit budget, by the pigeonhole principle.

An item with a budget of k edits is split into k + 1 pieces. A passage within k edits of the
item leaves one piece untouched, so every such passage holds a piece exactly; all pieces are
searched at once by an automaton. At each hit the item is compared with the stretch of the
document where it would lie, by Myers' bit-parallel distance, which decides.

Texts are compared lower-cased, with white space collapsed to one blank. The budget is one
edit in `EDIT_EVERY` characters, but pieces keep at least `LEAST_PIECE` of them; so short
items get fewer edits. Items below `LEAST_ITEM` characters get none and must stand as whole words
(scripts that don't separate words excepted), whatever their length: an item "yes" is found
in every document with that word. Empty and null items are not looked for. Null and empty
documents hold nothing. Repeated items and rows are found one by one. An empty table of documents or items
gives no rows, and without items all documents stay.

Items are searched in batches of at most `BATCH_CHARS` characters, counted before; each
batch is one pass over the documents, so memory stays bounded however many items there are.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.llm.common import of_worker, text_of, whole

EDIT_EVERY = 12
LEAST_PIECE = 10
LEAST_ITEM = 30
BATCH_CHARS = 4_000_000
# Thai to Burmese, Khmer, kana and ideographs: their words have no edges that could be seen.
_UNSEPARATED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int) -> int:
    return max(0, min(length // EDIT_EVERY, length // LEAST_PIECE - 1)) if length >= LEAST_ITEM else 0


def _of_word(c: str) -> bool:
    return c.isalnum() or unicodedata.category(c)[0] == "M"


def stands_alone(document: str, start: int, stop: int) -> bool:
    """Whether neither edge of a stretch lies within a word."""
    edges = [document[at - 1 : at + 1] for at in (start, stop) if 0 < at < len(document)]
    return not any(_of_word(a) and _of_word(b) and not _UNSEPARATED.search(a + b) for a, b in edges)


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """`edits` + 1 parts of about equal length, with their places."""
    cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Myers:
    """Least edit distance of one pattern to the end of each prefix of a text, starting anywhere (Myers 1999)."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.peq: dict[str, int] = {}
        for k, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << k

    def best(self, text: str) -> tuple[int, int]:
        """Smallest distance to a stretch of `text`, and where the first such stretch ends."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        best, end, peq = score, 0, self.peq
        for at, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up = minus | (full & ~((eq | down) | plus))
            down = plus & (eq | down)
            if score < best:
                best, end = score, at
        return best, end


class Searcher:
    """All pieces of some items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(item_id, normal(text)) for item_id, text in items]
        self.items = [(item_id, text) for item_id, text in self.items if text]
        self.edits = [budget(len(text)) for _, text in self.items]
        self.myers: dict[int, Myers] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for place, piece in pieces(text, self.edits[k]):
                at.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.empty = not at
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """`(item, distance)` of the items within their budgets, the best distance of each."""
        if self.empty:
            return []
        document, windows, alone = normal(text), {}, set()
        for last, (size, places) in self.automaton.iter(document):
            for k, place in places:
                start = last + 1 - size - place
                if len(self.items[k][1]) < LEAST_ITEM:
                    if k not in alone and stands_alone(document, start, last + 1):
                        alone.add(k)
                    continue
                windows.setdefault(k, set()).add(start)
        found = [(k, 0) for k in alone]
        for k, starts in windows.items():
            length, edits = len(self.items[k][1]), self.edits[k]
            if k not in self.myers:
                self.myers[k] = Myers(self.items[k][1])
            best = edits + 1
            for low, high in _merged(sorted(starts), length, edits):
                best = min(best, self.myers[k].best(document[max(0, low) : high])[0])
            if best <= edits:
                found.append((k, best))
        return found


def _merged(starts: list[int], length: int, edits: int) -> Iterator[tuple[int, int]]:
    """Stretches to compare, those that overlap made one, so that no character is compared twice."""
    low = high = None
    for start in starts:
        a, b = start - edits, start + length + edits
        if high is None or a > high:
            if high is not None:
                yield low, high
            low, high = a, b
        else:
            high = max(high, b)
    if high is not None:
        yield low, high


def _searcher(name: str, items: list[tuple[int, str]]) -> Searcher:
    """One for each Python worker and batch of items; only the last is kept."""
    return of_worker(name, lambda: Searcher(items))


def batches(benchmark: DataFrame, chars: int = BATCH_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most about `chars` characters (a longer item stands alone)."""
    items = benchmark.select(F.col("item_id").cast("long"), text_of("text").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts):
        rows = items.where(part == k) if parts > 1 else items
        yield [(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()]


def found_items(spark: SparkSession, items: list[tuple[int, str]], text: Column) -> Column:
    """Array of `(item_id, distance)` for each text."""
    shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def search(texts: pd.Series) -> pd.Series:
        searcher = _searcher(name, shared.value)
        return pd.Series(
            [[{"item_id": searcher.items[k][0], "distance": d} for k, d in searcher.find(t)] for t in texts],
            dtype=object,
        )

    return F.pandas_udf(search, "array<struct<item_id: long, distance: int>>")(text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`(doc_id, item_id, distance)` for each item that a document of `docs (doc_id, text)` holds."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_of("text").alias("text"))
    parts = [
        texts.select("doc_id", F.explode(found_items(spark, items, F.col("text"))).alias("hit"))
        for items in batches(benchmark)
    ]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "hit.item_id", "hit.distance")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` without any item, with all their columns."""
    spark, kept = docs.sparkSession, docs
    for items in batches(benchmark):
        rows = kept.select(whole(), found_items(spark, items, text_of("text")).alias("hits"))
        kept = rows.where(F.size("hits") == 0).select("row.*")
    return kept

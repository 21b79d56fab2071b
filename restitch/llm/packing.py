"""Best-fit packing: sequences of a fixed token budget, gaps filled exactly by looked-up sums of lengths.

Only the counts of pieces per length matter for the plan, at most `CAPACITY` numbers whatever
the corpus; so the plan is made from that histogram, and pieces are dealt to it by their rank
among the pieces of their length. A plan is a list of patterns (lengths side by side in one
sequence) with a number of copies.

A sequence is opened with the longest piece left. Its gap is looked up among the single
lengths, the sums of pairs, and the sums of triples (a length plus a pair sum) that are
available, counts included; what none of them fills exactly gets the longest piece that fits
(best fit), and the smaller gap is looked up again. A pattern is repeated for as long as
all its lengths last.

Tokens: `word_bpe_49k`, no special tokens added, then id 1. Null and empty texts give the one
id 1. Repeated rows are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restitch.llm.common import checkpoint, of_worker, text_of

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Words that a generation of each worker keeps with their ids, some 30 MB.
CACHE_WORDS = 120_000
# Marks that end a token of letters and start one of their own.
ENDINGS = frozenset(".,;:!?")
# Pieces of one length are ranked in so many parts.
SALTS = 64


def byte_symbols() -> dict[int, int]:
    """How byte-level models write bytes: printable ones as themselves, the others counted from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)).difference(printable))
    return {byte: 256 + k for k, byte in enumerate(others)}


class WordTokens:
    """Ids of texts, a cached word at a time, as little-endian 32-bit integers.

    The tokenizer drops white space, never lets a token cross it or the step from a letter to
    a punctuation mark, and lower-cases each character for itself; so a text's ids are those
    of its lower-case words, one after the other. Texts for which this does not hold (special
    tokens' strings, characters that lower-casing or composition treat by context) are encoded
    whole. The cache holds two generations of `CACHE_WORDS` words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Put words into the recent generation."""
        recent, older = self.recent, self.older
        parts = {w: (w[:-1], w[-1]) if w[-1:] in ENDINGS and w[-2:-1].isalpha() else (w,) for w in words}
        new = set()
        for word in {p for part in parts.values() for p in part}:
            if word not in recent:
                if word in older:
                    recent[word] = older[word]
                else:
                    new.add(word)
        listed = [w for w in new if not w.isalpha()]
        for word in new.difference(listed):
            # One run of letters: what the model's pre-tokenizer would hand it, byte by byte.
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            recent[word] = np.array([t.id for t in self.model.tokenize(symbols)], dtype="<u4").tobytes()
        if listed:
            coded = self.tokenizer.encode_batch(listed, add_special_tokens=False)
            recent.update((w, np.array(c.ids, dtype="<u4").tobytes()) for w, c in zip(listed, coded, strict=True))
        for word, part in parts.items():
            if len(part) > 1:
                recent[word] = recent[part[0]] + recent[part[1]]

    def encode(self, text: str) -> bytes:
        lower = text.lower()
        if not text.isascii() and ("\u03a3" in text or not is_normalized("NFC", text) or not is_normalized("NFC", lower)):
            return self.whole(text)
        if any(s in text for s in self.special):
            return self.whole(text)
        words = lower.replace("\n", " ").split(" ")
        ids = list(map(self.recent.get, words))
        if None in ids:
            if len(self.recent) > CACHE_WORDS:
                self.older, self.recent = self.recent, {}
                ids = [None] * len(words)
            self._learn({w for w, known in zip(words, ids, strict=True) if known is None})
            ids = map(self.recent.__getitem__, words)
        return b"".join(ids)


def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, so that its cache serves all of the worker's tasks."""
    return of_worker(f"tokens of {path}", lambda: WordTokens(path))


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces `(doc_id, piece, start, length, ids)` of `docs (doc_id, text)`; `ids` are unsigned 32-bit, little-endian.

    Only documents of more than `CAPACITY` tokens are cut.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from public_tokenizers import path

        words = word_tokens(path(tokenizer))
        end = np.array([END_ID], dtype="<u4").tobytes()
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = words.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                    part = ids[at : at + 4 * CAPACITY]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, part))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    # Ids pass through Python as text: pandas would turn a column with a null into floats.
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text_of("text").alias("text"))
    cuts = texts.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids binary")
    return cuts.withColumn("doc_id", F.col("doc_id").cast("long"))


class _Stock:
    """Pieces left of each length, with the sums that pairs of them make."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        self.left[: len(counts)] = counts
        self.capacity = capacity
        there = self.left > 0
        # pairs[s]: ordered ways to make s of two available lengths (a length may pair with itself).
        self.pairs = np.zeros(capacity + 1, np.int64)
        for a in np.flatnonzero(there):
            self.pairs[a:] += there[: capacity + 1 - a]
        self.there = there

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            self.there[length] = False
            # Both orders go, and the pair with itself once.
            self.pairs[length:] -= 2 * self.there[: self.capacity + 1 - length]
            if 2 * length <= self.capacity:
                self.pairs[2 * length] -= 1

    def longest(self, most: int) -> int:
        fitting = np.flatnonzero(self.there[: most + 1])
        return int(fitting[-1]) if len(fitting) else 0

    def _enough(self, lengths: list[int], used: Counter) -> bool:
        need = used + Counter(lengths)
        return all(self.left[n] >= need[n] for n in lengths)

    def _pair(self, gap: int, used: Counter) -> list[int] | None:
        if gap < 2 or not self.pairs[gap]:
            return None
        both = self.there[gap // 2 + gap % 2 : gap] & self.there[gap // 2 : 0 : -1]
        for a in np.flatnonzero(both)[::-1] + gap // 2 + gap % 2:
            if self._enough([int(a), gap - int(a)], used):
                return [int(a), gap - int(a)]
        return None

    def exact(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three lengths of stock that fill `gap`, besides those in `used`."""
        if self.there[gap] and self._enough([gap], used):
            return [gap]
        if pair := self._pair(gap, used):
            return pair
        ways = self.there[1:gap] & (self.pairs[gap - 1 : 0 : -1] > 0)
        for a in np.flatnonzero(ways)[::-1] + 1:
            if self._enough([int(a)], used) and (pair := self._pair(gap - int(a), used + Counter([int(a)]))):
                return [int(a), *pair]
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns and their numbers of copies that use up all `counts[length]` pieces."""
    stock, patterns = _Stock(counts, capacity), []
    while first := stock.longest(capacity):
        pattern, gap = [first], capacity - first
        used = Counter(pattern)
        while gap:
            if fill := stock.exact(gap, used):
                pattern += fill
                break
            best = next((n for n in _descending(stock, gap) if stock.left[n] > used[n]), 0)
            if not best:
                break
            # As many at once as still leave room, for gaps far longer than the pieces.
            n = max(1, min(int(stock.left[best]) - used[best], gap // best - 3))
            pattern += [best] * n
            used[best] += n
            gap -= n * best
        need = Counter(pattern)
        copies = min(int(stock.left[n]) // k for n, k in need.items())
        patterns.append((sorted(pattern, reverse=True), copies))
        for n, k in need.items():
            stock.take(n, copies * k)
    return patterns


def _descending(stock: _Stock, most: int) -> Iterator[int]:
    n = stock.longest(most)
    while n:
        yield n
        n = stock.longest(n - 1)


def _slots(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, pieces per copy, first sequence, offset of the first), by rank."""
    taken: Counter[int] = Counter()
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for pattern, copies in patterns:
        at = 0
        for n, k in Counter(pattern).items():
            slots.setdefault(n, []).append((taken[n], k, sequence, at))
            taken[n] += k * copies
            at += n * k
        sequence += copies
    return {n: np.array(rows, np.int64) for n, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces, rows with a `length` from 1 to `capacity`.

    `pieces` is read more than once and should be a checkpoint or table. Pieces of one
    length, which may be most, are ranked in `SALTS` parts.
    """
    own = [c for c in pieces.columns]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int"))
    per_part = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    # Bounded: capacity times SALTS rows at most.
    parts = per_part.orderBy("length", "_salt").toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    np.add.at(counts, parts["length"].to_numpy(np.int64), parts["n"].to_numpy(np.int64))
    slots = _slots(plan(counts, capacity))
    before = parts.groupby("length")["n"].cumsum() - parts["n"]
    first_rank = dict(zip(zip(parts["length"], parts["_salt"], strict=True), before, strict=True))
    ranks = Window.partitionBy("length", "_salt").orderBy(*own)
    ranked = salted.withColumn("_rank", F.row_number().over(ranks) - 1)
    schema = f"{pieces.sparkSession.createDataFrame([], pieces.schema)._jdf.schema().toDDL()}, sequence_id long, offset long"
    # Also bounded by the capacity, not by the corpus.
    shared = pieces.sparkSession.sparkContext.broadcast((slots, first_rank))

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, first_rank = shared.value
        for frame in frames:
            sequence, offset = np.zeros(frame.num_rows, np.int64), np.zeros(frame.num_rows, np.int64)
            lengths, salts, ranks = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            base = np.array([first_rank[key] for key in zip(lengths.tolist(), salts.tolist(), strict=True)], np.int64)
            rank = base + ranks
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                slot = slots[int(n)][np.searchsorted(slots[int(n)][:, 0], rank[at], side="right") - 1]
                copy, place = np.divmod(rank[at] - slot[:, 0], slot[:, 1])
                sequence[at] = slot[:, 2] + copy
                offset[at] = slot[:, 3] + place * n
            columns = [*(frame.column(c) for c in own), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*own, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Where each document's pieces lie: `(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`."""
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(checkpoint(pieces))

"""Source divergence audit: how the sources of a language differ in the terms they use.

A term is a run of ASCII letters and characters beyond ASCII, of which only A to Z are lower-cased.
Terms are counted by language and source, with the number of documents that hold each. Counting is done by
sorting: a batch of texts is one array of bytes, in which a table turns all but the bytes of terms
into breaks, so all beginnings and ends are found at once. Terms of up to 8 bytes are packed into
one unsigned 64-bit word, of up to 16 bytes into two; words are radix-sorted (16 bits at a time, least
first, stable) and counted as runs. Longer terms go by length into buckets, each a matrix of bytes
that is sorted by itself. Texts are in the order of their group before, so that after a stable
sort by term the runs of a term fall into runs of groups, and these into runs of documents.
Spark sums up what the batches find.

A language keeps the terms that at least `LEAST_DOCUMENTS` of its documents hold: V of them. A
group (a language's source, or the language itself), whose terms kept occur N times in all, gives each of them

    p = 1 + floor(10^9 (count + 2) / (N + 2 V))

and two groups differ in a term by `f = floor((p - q)^2 / (p + q))`. Two sources differ by the sum
over all kept terms. Terms that neither uses differ by the same amount each, so only terms that one
of the two uses are joined: a row of a term meets the sources of its language, and the
(few) rows of the same term.

Sums that may pass 64 bits are decimals. Null texts, languages and sources are empty ones. Empty
texts hold no terms, but their group is listed; a language of one source has no pairs. Repeated
rows count as documents of their own. Texts are counted whole: one of more than `CHUNK_BYTES` is counted
in parts cut between terms, and still as one document. An empty table gives no rows; further columns are not
looked at. Equal values are in order of the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restitch.llm.common import checkpoint, text_of

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
# Bytes of text that are counted at once.
CHUNK_BYTES = 4_000_000
# A table of groups is sent to all executors below this many rows; there it is dealt out instead.
BROADCAST_GROUPS = 100_000
SALTS = 64

# Every byte as it is counted: letters (A to Z lower-cased) and bytes above 127 stay, others are breaks.
_COUNTED = np.array([b if b > 127 or chr(b).isalpha() else 0 for b in range(256)], np.uint8)
_COUNTED[65:91] += 32
# The bytes of a big-endian word that belong to a term of so many bytes.
_MASKS = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * n) - 1) for n in range(9)], np.uint64)


def radix_order(words: np.ndarray) -> np.ndarray:
    """Stable order of unsigned 64-bit numbers, by digits of 16 bits."""
    order = None
    for shift in (0, 16, 32, 48):
        digits = (words >> np.uint64(shift)).astype(np.uint16)
        if len(digits) and (digits == digits[0]).all():
            continue
        if order is None:
            order = np.argsort(digits, kind="stable")
        else:
            order = order[np.argsort(digits[order], kind="stable")]
    return np.arange(len(words)) if order is None else order


def _run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns begins a new run."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return new


def _runs(keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: the first row of each run of a term and group, the run's length, and its different documents."""
    new = _run_starts(*keys, group)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(group)))
    documents = np.add.reduceat((new | _run_starts(doc)).astype(np.int64), first) if len(first) else first
    return first, count, documents


def count_runs(buffer: bytes, ends: np.ndarray, groups: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Terms, their groups, counts and numbers of documents in some texts, bucket by bucket.

    `buffer` holds the texts one after the other up to `ends`, in the order of their `groups`.
    """
    raw = _COUNTED[np.frombuffer(buffer, np.uint8)]
    is_term = raw != 0
    begins = np.append(0, ends[:-1])
    fresh = np.ones(len(raw), bool)
    fresh[1:] = ~is_term[:-1]
    fresh[begins[begins < len(raw)]] = True
    starts = np.flatnonzero(is_term & fresh)
    if not len(starts):
        return
    # A term ends at the next break, text or the end.
    stops = np.ones(len(raw), bool)
    stops[:-1] = ~is_term[1:]
    stops[ends[ends > 0] - 1] = True
    lengths = np.flatnonzero(is_term & stops) - starts + 1
    doc = np.searchsorted(ends, starts, "right")
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    # The eight bytes from every place on, as one big-endian word.
    word_at = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return word_at[at].astype(np.uint64) & _MASKS[size]

    def text_of_words(columns: list[np.ndarray]) -> list[bytes]:
        wide = np.stack(columns, axis=1).astype(">u8")
        return wide.view(f"S{8 * len(columns)}").reshape(-1).tolist()

    one = np.flatnonzero(lengths <= 8)
    two = np.flatnonzero((lengths > 8) & (lengths <= 16))
    long = np.flatnonzero(lengths > 16)
    if len(one):
        low = word(starts[one], lengths[one])
        order = radix_order(low)
        low, d = low[order], doc[one][order]
        first, count, documents = _runs([low], groups[d], d)
        yield text_of_words([low[first]]), groups[d[first]], count, documents
    if len(two):
        high, low = word(starts[two], np.full(len(two), 8)), word(starts[two] + 8, lengths[two] - 8)
        order = radix_order(low)
        order = order[radix_order(high[order])]
        high, low, d = high[order], low[order], doc[two][order]
        first, count, documents = _runs([high, low], groups[d], d)
        yield text_of_words([high[first], low[first]]), groups[d[first]], count, documents
    for size in np.unique(lengths[long]).tolist():
        bucket = long[lengths[long] == size]
        rows = raw[starts[bucket][:, None] + np.arange(size)].view(f"S{size}").reshape(-1)
        order = np.argsort(rows, kind="stable")
        rows, d = rows[order], doc[bucket][order]
        first, count, documents = _runs([rows], groups[d], d)
        yield rows[first].tolist(), groups[d[first]], count, documents


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A long text cut between terms into parts of about `most` bytes (a longer term stays whole)."""
    begin = 0
    while begin < len(text):
        end = min(begin + most, len(text))
        while end < len(text):
            breaks = np.flatnonzero(_COUNTED[np.frombuffer(text, np.uint8, min(most, len(text) - end), end)] == 0)
            if len(breaks):
                end += int(breaks[0])
                break
            end = min(end + most, len(text))
        yield text[begin:end]
        begin = end


def _counts_of(rows: list[tuple[str, str, bytes]]) -> Iterator[pa.RecordBatch]:
    names = sorted({(lang, source) for lang, source, _ in rows})
    number = {name: k for k, name in enumerate(names)}
    rows = sorted(rows, key=lambda r: number[r[0], r[1]])
    groups = np.array([number[lang, source] for lang, source, _ in rows], np.int64)
    if len(rows) == 1 and len(rows[0][2]) > CHUNK_BYTES:
        seen: set[bytes] = set()
        for part in _parts(rows[0][2], CHUNK_BYTES):
            for terms, _, count, _ in count_runs(part, np.array([len(part)]), groups):
                yield _batch(names, np.zeros(len(terms), np.int64), terms, count, np.array([t not in seen for t in terms], np.int64))
                seen.update(terms)
        return
    ends = np.cumsum([len(text) for _, _, text in rows])
    for terms, group, count, documents in count_runs(b"".join(text for _, _, text in rows), ends, groups):
        yield _batch(names, group, terms, count, documents)


def _batch(names: list[tuple[str, str]], group: np.ndarray, terms: list[bytes], count: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    langs, sources = (pa.array([n[k] for n in names], pa.string()).take(pa.array(group)) for k in (0, 1))
    columns = [langs, sources, pa.array(terms, pa.binary()), pa.array(count, pa.int64()), pa.array(documents, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])


def _counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, bytes]] = []
    size = 0
    for frame in frames:
        for lang, source, text in zip(frame.column("lang").to_pylist(), frame.column("source").to_pylist(), frame.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            if held and size + len(text) > CHUNK_BYTES:
                yield from _counts_of(held)
                held, size = [], 0
            held.append((lang, source, text))
            size += len(text)
    if held:
        yield from _counts_of(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """`(lang, source, term, n, documents)` over all of `docs (lang, source, text)`; terms are binary."""
    texts = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_counted, "lang string, source string, term binary, n long, documents long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p of a term, exact for counts beyond 64 bits once scaled."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.when(kept > 0, 1 + F.call_function("div", scaled, (total + 2 * kept).cast("decimal(20,0)"))).cast("long")


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _few(groups: DataFrame) -> tuple[DataFrame, bool]:
    groups = checkpoint(groups)
    return groups, groups.count() <= BROADCAST_GROUPS


def _with_sources(rows: DataFrame, others: DataFrame, small: bool) -> DataFrame:
    """Each row with each source of its language; a language may own any share of the rows."""
    if small:
        return rows.join(F.broadcast(others), "lang")
    salted = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term", "source"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """`(lang, source, part, item, value, rank)`: all pairs of sources of a language, and the `top` terms of each source."""
    groups = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    counts = checkpoint(term_counts(docs))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    kept = of_lang.where(F.col("documents") >= least).select("lang", "term", "lang_n")
    kept = checkpoint(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    once = kept.select("lang", "term", "lang_n").distinct()
    langs = once.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "lang_total", "total")]
    )
    groups, small = _few(groups.withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))))
    if small:
        known = kept.join(F.broadcast(groups), ["lang", "source"])
    else:
        known = kept.join(groups, ["lang", "source"])
    known = known.withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))
    return _pairs(known, groups, small).unionByName(_terms(known, top))


def _pairs(known: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """Sums over all kept terms, by what a term adds to the difference of terms that neither source uses."""
    rows = known.select("lang", "term", "source", "p", "p0")
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    nothing = _difference(F.col("p0"), F.col("q0"))
    # Of a term that one source uses, as if the other didn't ...
    alone = _with_sources(rows, others, small).where("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(_difference(F.col("p"), F.col("q0")) - nothing).alias("added"))
    both_ways = alone.unionByName(alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "added"))
    # ... and what it is instead where both do.
    theirs = known.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    shared = rows.join(theirs, ["lang", "term"]).where("source < other")
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    instead = _difference(p, q) - _difference(p, q0) - _difference(p0, q) + _difference(p0, q0)
    shared = shared.groupBy("lang", "source", "other").agg(F.sum(instead).alias("added"))
    both_ways = both_ways.unionByName(shared).unionByName(
        shared.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "added")
    )
    sums = both_ways.groupBy("lang", "source", "other").agg(F.sum("added").alias("added"))
    # The result has a row for each pair of a language's sources.
    pairs = groups.select("lang", "source", "v", "p0").join(others, "lang").where("source <> other")
    pairs = pairs.join(sums, ["lang", "source", "other"], "left")
    value = F.when(F.col("v") > 0, F.coalesce("added", F.lit(0)) + F.col("v") * nothing).otherwise(0).cast("long")
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value")))


def _terms(known: DataFrame, top: int) -> DataFrame:
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    more = known.withColumn("q", q).where("p > q")
    value = _difference(F.col("p"), F.col("q"))
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value"))
    return _ranked(more).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))

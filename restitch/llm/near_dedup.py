"""Near-duplicate classes by BagMinHash signatures, banding, and verified multiset overlap.

A text is the multiset of its shingles of `SHINGLE` words (lower-cased, split at white space;
of a shorter text, one shingle of all words). Two texts are linked if their weighted Jaccard
similarity, the sum of smaller over the sum of larger counts, is `SIMILARITY` or more.

Signatures follow BagMinHash (Ertl 2018). Counts are discretised at powers of two: the first
unit, the second, the next two, the next four and so on are Poisson processes of their own
with rate one, one, two, four. Each point of a process has a time, a component of the
signature and a place among the units; it counts if the text's count reaches that unit, which
is what splitting the process in halves down to the unit would give. A component keeps its
earliest time. Points come in order of time, so a text needs about `SIZE * ln(SIZE)` of them
in all, and equal components are an unbiased estimate of the similarity.

`BANDS` bands of `ROWS` components find a pair of similarity 0.8 but for three in a million.
Members of a bucket are compared with one leader first. Where buckets connect texts that are then
still of several classes, these are compared across classes, in blocks, until links make them
one; similarities there are exact, from a table of the shingles of a block, so what is missed is
what banding misses, and no pairs are written but those that are links. Exact copies are one node; nodes are 128-bit digests.

Null and empty texts have no words and stand alone. Repeated rows are copies of each other. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.common import checkpoint, of_worker, text_of, whole

SHINGLE = 5
SIMILARITY = 0.8
SIZE = 96
ROWS = 4
BANDS = SIZE // ROWS
# A block of a cluster holds about so many texts, and words, at most.
BLOCK_TEXTS = 1024
BLOCK_WORDS = 300_000
CACHE_WORDS = 100_000
# Work of a Python worker at a time: words sketched together, processes advanced together.
BATCH_WORDS = 25_000
BATCH_TEXTS = 64
BATCH_PROCESSES = 50_000
# Tables of at most so many keys or buckets (some 60 MB) are sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
# Small tables of keys are kept in tasks of about so many rows.
TASK_ROWS = 50_000
# A task joins edges until it holds so many nodes (some 40 MB), then begins anew.
MOST_NODES = 200_000
# Times are whole numbers, so that sums don't depend on the order of adding.
TICKS = 2.0**40

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _A
    z = (z ^ (z >> np.uint64(27))) * _B
    return z ^ (z >> np.uint64(31))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    hashes: dict[bytes, int] = of_worker("near_dedup", dict)
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    found = list(map(hashes.get, words))
    if None in found:
        for word in {w for w, known in zip(words, found, strict=True) if known is None}:
            hashes[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        found = list(map(hashes.__getitem__, words))
    return np.array(found, np.uint64)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


def shingles_of(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, given as its words, the sorted hashes of its different shingles and how often each occurs."""
    hashes = _word_hashes([w for words in texts for w in words])
    windows = np.zeros(max(len(hashes) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        windows = windows * _GOLDEN + hashes[k : k + len(windows)]
    windows = _mix(windows)
    out, at = [], 0
    for words in texts:
        n = len(words)
        if n >= SHINGLE:
            found = np.sort(windows[at : at + n - SHINGLE + 1])
        else:
            short = np.array([n], np.uint64)
            for k in range(n):
                short = short * _GOLDEN + hashes[at + k]
            found = _mix(short)
        at += n
        new = np.concatenate([[True], found[1:] != found[:-1]])
        edges = np.append(np.flatnonzero(new), len(found))
        out.append((found[new], np.diff(edges)))
    return out


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return shingles_of([words])[0]


def _advance(best: np.ndarray, owner: np.ndarray, seed: np.ndarray, rate: np.ndarray, units: np.ndarray) -> None:
    """Let the points of some processes into the rows of `best` that their owners have."""
    flat = best.reshape(-1)
    time, first = np.zeros(len(seed), np.uint64), np.zeros(len(seed), np.uint64)
    # As many points at once as will fill all components, then more for those that are behind.
    total = np.bincount(owner, rate, len(best))
    many = np.ceil(SIZE * (np.log(SIZE) + 1) / np.maximum(total, 1)).astype(np.int64)[owner] + 2
    while len(seed):
        ends = np.cumsum(many)
        starts = ends - many
        of = np.repeat(np.arange(len(seed)), many)
        number = (np.arange(len(of)) - starts[of] + 1).astype(np.uint64) + first[of]
        z = _mix(seed[of] + number * _GOLDEN)
        wait = -np.log(((z >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[of]
        sums = np.cumsum((wait * TICKS).astype(np.uint64))
        before = np.concatenate([[np.uint64(0)], sums])[starts]
        times = time[of] + (sums - before[of])
        mark = _mix(z ^ _B)
        component = ((mark & np.uint64(0xFFFFFFFF)) * np.uint64(SIZE)) >> np.uint64(32)
        unit = ((mark >> np.uint64(32)) * rate.astype(np.uint64)[of]) >> np.uint64(32)
        at = owner[of] * SIZE + component.astype(np.int64)
        counted = unit < units[of]
        np.minimum.at(flat, at[counted], times[counted])
        time = times[ends - 1]
        first = first + many.astype(np.uint64)
        behind = time < best.max(axis=1)[owner]
        seed, rate, units, owner = seed[behind], rate[behind], units[behind], owner[behind]
        time, first = time[behind], first[behind]
        many = np.full(len(seed), 4)


def signatures(multisets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each multiset `(elements, counts)`, which is not empty, the `SIZE` earliest times."""
    elements = np.concatenate([m[0] for m in multisets])
    counts = np.concatenate([m[1] for m in multisets])
    owners = np.repeat(np.arange(len(multisets)), [len(m[0]) for m in multisets])
    # A process for each element and power of two that its count reaches: units (start, start + rate].
    parts = [(owners, _mix(elements), np.ones(len(elements)), counts)]
    start, many = 1, np.flatnonzero(counts > 1)
    while len(many):
        seed = _mix(elements[many] + np.array([start], np.uint64) * _A)
        parts.append((owners[many], seed, np.full(len(many), float(start)), counts[many] - start))
        start *= 2
        many = many[counts[many] > start]
    owner, seed, rate, units = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = np.full((len(multisets), SIZE), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(seed), BATCH_PROCESSES):
        part = slice(k, k + BATCH_PROCESSES)
        mine, local = np.unique(owner[part], return_inverse=True)
        rows = best[mine]
        _advance(rows, local, seed[part], rate[part], units[part].astype(np.uint64))
        best[mine] = rows
    return best


def text_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketches(texts: list[str]) -> list[tuple[bytes | None, int, bytes | None, np.ndarray | None]]:
    """Digest, number of shingles, 32-bit signature and band hashes of each text; nulls without words."""
    out: list[tuple] = []
    waiting: list[tuple[int, list[bytes]]] = []
    held = 0

    def flush() -> None:
        multisets = shingles_of([words for _, words in waiting])
        mixed = _mix(signatures(multisets))
        bands = np.tile(np.arange(BANDS, dtype=np.uint64), (len(waiting), 1))
        for k in range(ROWS):
            bands = _mix(bands * _GOLDEN + mixed.reshape(-1, BANDS, ROWS)[:, :, k])
        for (at, words), (_, counts), sig, band in zip(waiting, multisets, mixed, bands.view(np.int64), strict=True):
            out[at] = (text_key(words), int(counts.sum()), (sig & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), band)
        waiting.clear()

    for text in texts:
        words = words_of(text)
        out.append((None, 0, None, None))
        if words:
            waiting.append((len(out) - 1, words))
            held += len(words)
        if held >= BATCH_WORDS or len(waiting) >= BATCH_TEXTS:
            flush()
            held = 0
    if waiting:
        flush()
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets from `shingles`."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    both = int(np.minimum(a[1][at][same], b[1][same]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _sketches(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(sketches(list(texts)), columns=["key", "n", "sig", "bands"])


def fingerprint(text: Column) -> Column:
    """128 bits by which a text is found again without Python; copies up to case and spacing have several."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def has_words(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a task's edges the smallest key they connect it with, if that is not the node itself."""
    above: dict[bytes, bytes] = {}

    def root_of(key: bytes) -> bytes:
        path = []
        while key in above:
            path.append(key)
            key = above[key]
        for node in path[:-1]:
            above[node] = key
        return key

    def found() -> pa.RecordBatch:
        columns = [list(above), [root_of(key) for key in above]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, other = root_of(a), root_of(b)
            if one != other:
                above[max(one, other)] = min(one, other)
        if len(above) > MOST_NODES:
            yield found()
            above.clear()
    if above:
        yield found()


def _in_few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df` in no more tasks than its number of rows needs, but in one for each core."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """`(key, root)` for every node of `edges (a, b)` but the roots: the smallest key it is connected with.

    Each round a task joins its edges to stars first, so a node meets at most one root from each task, and
    none meets its leaves. Then a node takes the smallest of its roots, the others are linked with that one,
    and links to a node that has a root itself go to that root, until nothing changes. So chains are halved,
    and a round shuffles each node once, to itself. `edges` are read twice.
    """
    edges = edges.where("a <> b").select("a", "b")
    rows = edges.count()
    edges = _in_few_tasks(edges, rows)
    while True:
        met = edges.mapInArrow(_stars, "a binary, b binary").groupBy("a").agg(F.collect_set("b").alias("roots"))
        low = met.select("a", "roots", F.array_min("roots").alias("low"))
        nodes = low.select("a", "low", F.filter("roots", lambda r: r != F.col("low")).alias("others"))
        nodes = checkpoint(_in_few_tasks(nodes, rows))
        lows = _in_few_tasks(nodes.select(F.col("low").alias("b")).distinct(), rows)
        steps = nodes.select(F.col("a").alias("b"), F.col("low").alias("next")).join(lows, "b")
        steps = checkpoint(_in_few_tasks(steps, rows))
        if steps.isEmpty() and nodes.where("size(others) > 0").isEmpty():
            return nodes.select(F.col("a").alias("key"), F.col("low").alias("root"))
        links = nodes.select(F.explode(F.concat(F.array("a"), "others")).alias("a"), F.col("low").alias("b"))
        edges = links.join(_if_small(steps), "b", "left").select("a", F.coalesce("next", "b").alias("b"))


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    recent: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def of(key: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        if key not in recent:
            recent[key] = shingles(words_of(text))
            if len(recent) > 64:
                recent.popitem(last=False)
        return recent[key]

    for frame in frames:
        good = [
            similarity(of(a, x), of(b, y)) >= SIMILARITY
            for a, b, x, y in zip(frame["a"], frame["b"], frame["text_a"], frame["text_b"], strict=True)
        ]
        yield frame.loc[good, ["a", "b"]]


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Those of `pairs (a, b)` that are similar enough; `bodies (key, text)` has each key once."""
    first = bodies.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    second = bodies.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b").mapInPandas(_verified, "a binary, b binary")


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between different classes in two blocks of a cluster.

    Each text of one block meets all of the other at once, by a table of that one's shingles;
    classes that a link joins count as one from then on.
    """
    left, right = (frame[frame["side"].isin(s)].sort_values("key").reset_index(drop=True) for s in ((0, 2), (1, 2)))
    if not len(left) or not len(right):
        return pd.DataFrame({"a": [], "b": []}, dtype=object)
    same_block = bool((frame["side"] == 2).any())
    joined: dict[bytes, bytes] = {}

    def root_of(root: bytes) -> bytes:
        while root in joined:
            root = joined[root]
        return root

    multisets = [shingles(words_of(text)) for text in right["text"]]
    elements, counts = (np.concatenate([m[k] for m in multisets]) for k in (0, 1))
    owners = np.repeat(np.arange(len(multisets)), [len(m[0]) for m in multisets])
    order = np.argsort(elements, kind="stable")
    elements, counts, owners = elements[order], counts[order], owners[order]
    n, keys, roots = right["n"].to_numpy(np.int64), right["key"].tolist(), right["root"].tolist()
    found = []
    for place, (key, root, size, text) in enumerate(zip(left["key"], left["root"], left["n"], left["text"], strict=True)):
        fits = np.minimum(n, size) >= SIMILARITY * np.maximum(n, size)
        if same_block:
            fits[: place + 1] = False
        one = root_of(root)
        fits[fits] = [root_of(roots[k]) != one for k in np.flatnonzero(fits)]
        if not fits.any():
            continue
        mine, many = multisets[place] if same_block else shingles(words_of(text))
        first, stop = np.searchsorted(elements, mine, "left"), np.searchsorted(elements, mine, "right")
        hits = stop - first
        at = np.repeat(first - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        both = np.bincount(owners[at], np.minimum(counts[at], np.repeat(many, hits)), len(n)).astype(np.int64)
        for k in np.flatnonzero(fits & (both / (n + size - both) >= SIMILARITY)).tolist():
            one, other = root_of(root), root_of(roots[k])
            if one != other:
                found.append((max(key, keys[k]), min(key, keys[k])))
                joined[max(one, other)] = min(one, other)
    return pd.DataFrame(found, columns=["a", "b"])


def _links_across(docs: DataFrame, pairs: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between classes within a cluster, the keys that buckets connect whether similar or not."""
    clusters = components(pairs).withColumnRenamed("root", "cluster")
    ends = clusters.unionByName(clusters.select(F.col("cluster").alias("key"), "cluster").distinct())
    placed = ends.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = checkpoint(placed.join(texts.select("key", "n", "fingerprint"), "key"))
    mixed = placed.groupBy("cluster").agg(
        F.count("*").alias("size"), F.sum("n").alias("words"), (F.min("root") != F.max("root")).alias("mixed")
    )
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_TEXTS, F.col("words") / BLOCK_WORDS)).cast("int").alias("blocks")
    # Of two members one was the other's leader, and that pair has been compared.
    mixed = checkpoint(mixed.where("mixed and size > 2").select("cluster", blocks))
    # Sent to the members while they are few, as all members of a large cluster would else meet theirs in one task.
    there = checkpoint(placed.join(_if_small(mixed), "cluster"))
    there = there.join(_bodies(docs, there.select("key", "fingerprint")), "key")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # A block meets itself and every other one: side 0 in front, 1 behind, 2 both.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.least(own, k).alias("i"),
            F.greatest(own, k).alias("j"),
            F.when(own == k, 2).when(own < k, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = there.select("cluster", "key", "root", "n", "text", F.explode(meets).alias("m"))
    dealt = dealt.select("cluster", "m.i", "m.j", "m.side", "key", "root", "n", "text")
    return checkpoint(dealt.groupBy("cluster", "i", "j").applyInPandas(_across, "a binary, b binary").distinct())


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _bodies(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The text of each of `keys (key, fingerprint)`. While the keys are few, only their texts are shuffled."""
    texts = docs.select(text_of("text").alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    return checkpoint(texts.join(_if_small(keys), "fingerprint").groupBy("key").agg(F.first("text").alias("text")))


def _both_ends(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    return checkpoint(ends.join(texts.select("key", "fingerprint"), "key"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots (key, root)` after `links (a, b)` between its classes; only the classes are connected anew."""
    for end in ("a", "b"):
        named = roots.select(F.col("key").alias(end), "root")
        links = links.join(named, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    new = components(checkpoint(links))
    moved = roots.join(new.select(F.col("key").alias("root"), F.col("root").alias("new")), "root", "left")
    return moved.select("key", F.coalesce("new", "root").alias("root")).unionByName(new)


def classes_of_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows `(doc_id, key, fingerprint)` of all documents, and `(key, root)` for keys with near-duplicates."""
    sketch = F.pandas_udf(_sketches, "key binary, n long, sig binary, bands array<long>")(text_of("text")).alias("s")
    sketched = docs.select("doc_id", fingerprint(text_of("text")).alias("fingerprint"), sketch)
    sketched = checkpoint(sketched.select("doc_id", "fingerprint", "s.*"))
    rows = sketched.select("doc_id", "key", "fingerprint")
    texts = sketched.where(F.col("key").isNotNull()).groupBy("key")
    texts = checkpoint(texts.agg(F.min("fingerprint").alias("fingerprint"), *[F.first(c).alias(c) for c in ("n", "bands")]))
    banded = texts.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("key").alias("leader"), F.count("*").alias("size")).where("size > 1")
    members = banded.join(_if_small(checkpoint(shared.select("bucket", "leader"))), "bucket")
    pairs = checkpoint(members.where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct())
    edges = checkpoint(verified(pairs, _bodies(docs, _both_ends(pairs, texts))))
    roots = components(edges)
    more = _links_across(docs, pairs, texts, roots)
    return rows, roots if more.isEmpty() else _merged(roots, more)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`(doc_id, class_id)` for every row of `docs (doc_id, text)`; a class is named by its smallest doc_id."""
    rows, roots = classes_of_texts(docs)
    firsts = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min("first").alias("class_id"))
    of_key = placed.join(named, "root").select("key", "class_id")
    joined = rows.join(of_key, "key", "left")
    return joined.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class one row of `docs`, that with the smallest doc_id, with all its columns.

    Rows without words all stay; of fully repeated rows one does.
    """
    rows, roots = classes_of_texts(docs)
    counted = rows.where(F.col("key").isNotNull()).groupBy("key", "doc_id", "fingerprint").agg(F.count("*").alias("n"))
    placed = counted.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Nulls last, so that a row with an id stays where there is one.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fingerprint", "n")).alias("best")
    chosen = checkpoint(placed.groupBy("root").agg(best).select("best.*"))

    def among(df: DataFrame, others: DataFrame, how: str) -> DataFrame:
        # Both sides come from `docs`, so columns can be told apart by new names only.
        others = others.select(F.col("doc_id").alias("its_id"), F.col("fingerprint").alias("its_text"))
        same = (F.col("fingerprint") == F.col("its_text")) & F.col("doc_id").eqNullSafe(F.col("its_id"))
        return df.join(others, same, how)

    # Those that go are fewer than those that stay, so while they are few no text is shuffled.
    gone = checkpoint(among(counted, chosen, "left_anti").select("doc_id", "fingerprint"))
    text = text_of("text")
    keyed = docs.select(whole(), "doc_id", fingerprint(text).alias("fingerprint"), has_words(text).alias("has_words"))
    wordless = keyed.where("not has_words").select("row.*")
    kept = among(keyed.where("has_words"), _if_small(gone), "left_anti")
    repeated = checkpoint(chosen.where("n > 1").select("doc_id", "fingerprint"))
    if repeated.isEmpty():
        return kept.select("row.*").unionByName(wordless)
    repeated = _if_small(repeated)
    again = among(kept, repeated, "left_semi").dropDuplicates(["fingerprint"])
    return among(kept, repeated, "left_anti").unionByName(again).select("row.*").unionByName(wordless)

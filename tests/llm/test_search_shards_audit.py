"""Ranked search, Hilbert shards and the source audit against plain versions; ids at the ends of their range."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from restitch.llm import chat, hilbert_shards, lexical_search, linear, packing, pii, source_audit, warc
from restitch.llm.oracles import ORACLES
from restitch.llm.queries import QUERIES
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"
NEW = ["op11_lexical_search", "op12_hilbert_shards", "op13_source_audit"]
BIG = [2**53, 2**53 + 1, 2**63 - 1, -(2**63), None]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    assert name in ORACLES and name in QUERIES
    assert compare(spark, SF, name).startswith("ok")


# ---- search


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def best_documents(docs, items):
    counted = [(doc_id, Counter(words(text))) for doc_id, text in docs]
    sizes = [c.total() for _, c in counted]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    rows = []
    for item_id, text in items:
        found = []
        for (doc_id, tf), n in zip(counted, sizes, strict=True):
            score = 0
            for t in words(text):
                if tf[t]:
                    m = 25 + (75 * n * n_docs) // total
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        rows += [(item_id, k, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(found)[:10], 1)]
    return sorted(rows, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    term = lambda: rng.choice(["a", "A1", "Straße", "É", "é", "北京", "x" * 30, "b_", "c-d", "don't", "K", "ǅ"])
    prose = lambda n: rng.choice(["", " ", "\n"]) + rng.choice([" ", ", ", "  "]).join(term() for _ in range(n))
    docs = [(k, prose(rng.randrange(30))) for k in range(80)] + [(i, "a b é 北京") for i in BIG]
    docs += [(7, "same same"), (7, "same same"), (90, None), (91, ""), (92, "."), (93, "K " * 5000)]
    items = [(k, prose(rng.randrange(1, 8))) for k in range(20)] + [(50, None), (51, "..."), (52, "same a same"), (None, "é"), (2**63 - 1, "a")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted(map(tuple, lexical_search.search(frame, bench).collect()), key=str)
    assert got == best_documents(docs, items)
    # The same out of many small batches of items.
    assert sum(1 for _ in lexical_search.batches(bench, most_bytes=20)) > 5
    monkeypatch.setattr(lexical_search, "batches", lambda b, real=lexical_search.batches: real(b, most_items=9))
    assert sorted(map(tuple, lexical_search.search(frame, bench).collect()), key=str) == got


def test_best_keeps_ties_by_id(monkeypatch):
    monkeypatch.setattr(lexical_search, "MOST_CANDIDATES", 15)
    best, rng, rows = lexical_search.Best(3), random.Random(1), []
    for _ in range(30):
        ids = [rng.choice([None, rng.randrange(100)]) for _ in range(4)]
        scores = np.array([[rng.randrange(3) for _ in range(3)] for _ in ids], np.int64)
        best.add(scores, ids)
        rows += [(item, -int(s[item]), i is None, i or 0) for s, i in zip(scores, ids, strict=True) for item in range(3) if s[item] > 0]
    want = [r for item in range(3) for r in sorted(r for r in rows if r[0] == item)[: lexical_search.TOP]]
    assert [(a, -b, bool(c), d) for a, b, c, d in best.cut().T.tolist()] == want


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, b in ((docs.where("false"), bench), (docs, bench.where("false"))):
        assert lexical_search.search(d, b).collect() == []


# ---- shards


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_goes_from_neighbour_to_neighbour(spark, dimensions, bits):
    side = 1 << bits
    cells = spark.range(side**dimensions)
    cells = cells.select(*[F.expr(f"int(id div {side**k} % {side})").alias(f"x{k}") for k in range(dimensions)])
    at = hilbert_shards.hilbert_index([F.col(f"x{k}") for k in range(dimensions)], bits)
    rows = cells.withColumn("at", at).orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(side**dimensions))
    assert all(sum(abs(a[k] - b[k]) for k in range(dimensions)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("law", hilbert_shards.LAWS)
def test_shards_are_even_and_narrow(spark, tmp_path, law):
    rng = random.Random(2)
    rows = [(k, "w" * rng.randrange(50), rng.choice("abcd"), rng.randrange(1000), 0) for k in range(2000)]
    rows += [(5000, "copy", "a", 7, 0)] * 700 + [(i, None, None, None, 1) for i in BIG]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, shard int").repartition(7)
    sharded = hilbert_shards.shard_documents(docs, {"lang": F.col("lang"), "n": F.col("n")}, 16, law)
    got = sharded.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t or "") + 16) for i, t, *_ in rows)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    counts, sizes = [len(p) for p in by_shard.values()], [sum(r.size for r in p) for p in by_shard.values()]
    assert len(by_shard) == 16 and (max(counts) - min(counts) <= 1 if law == "rows" else max(sizes) - min(sizes) <= 2 * 66)
    # A box of both dimensions needs few of the files, and more of files sorted by one of them alone.
    index = hilbert_shards.ranges(sharded, "lang", "n").collect()
    hits = [x for x in index if x.least_n is not None and x.least_n <= 120 and x.largest_n >= 80]
    assert len(hits) <= 10
    hilbert_shards.write_shards(sharded, str(tmp_path / law))
    assert spark.read.parquet(str(tmp_path / law)).count() == len(rows)


def test_shards_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, None), (None, "", "x")], "doc_id long, text string, lang string")
    dims = {"lang": F.col("lang")}
    got = hilbert_shards.shard_documents(docs, dims).collect()
    assert sorted(r.shard for r in got) == [0, 13, 26] and {r.slot for r in got} == {0}
    assert hilbert_shards.shard_documents(docs.where("false"), dims).collect() == []
    assert hilbert_shards.shard_documents(docs.where("false"), dims, law="bytes").collect() == []


# ---- audit


def letters(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def audit_of(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = letters(text)
        counts[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in df[lang].items() if n >= least}
        sources = {r[1] for r in rows if r[0] == lang}

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", i.decode(), -v, k) for k, (v, i) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


def audited_rows():
    rng = random.Random(6)
    term = lambda: rng.choice(["a", "B", "abcdefgh", "abcdefghi", "abcdefghijklmnop", "abcdefghijklmnopq", "é" * 4, "é" * 8, "é" * 9, "北京", "x1y", "Z" * 40, "y" * 40])
    rows = [(rng.choice(["en", "de"]), rng.choice("stuv"), " ".join(term() for _ in range(rng.randrange(25)))) for _ in range(120)]
    rows += [(None, None, "a a"), ("", "", None), ("fr", "s", "rare"), ("fr", "t", ""), ("fr", "", "12"), ("it", "s", "solo " * 3)]
    return rows + [("en", "s", "copy copy")] * 20


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = audited_rows()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, source string, text string, value int").repartition(6)
    got = source_audit.audit(docs).collect()
    assert sorted(map(tuple, got)) == audit_of(rows, 10)
    # Groups that are too many to be sent to all executors are dealt out.
    monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, source_audit.audit(docs).collect())) == sorted(map(tuple, got))
    assert source_audit.audit(docs.where("false")).collect() == []


@pytest.mark.parametrize("chunk", [30, 1000, 10**6])
def test_counts_do_not_depend_on_how_texts_are_cut(monkeypatch, chunk):
    import pyarrow as pa

    monkeypatch.setattr(source_audit, "CHUNK_BYTES", chunk)
    rows = [tuple(x or "" for x in r) for r in audited_rows()]
    frame = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2].encode() for r in rows])], ["lang", "source", "text"])
    n, documents = Counter(), Counter()
    for batch in source_audit._counted(iter([frame])):
        for r in batch.to_pylist():
            n[r["lang"], r["source"], r["term"].decode()] += r["n"]
            documents[r["lang"], r["source"], r["term"].decode()] += r["documents"]
    assert n == Counter((a, b, t) for a, b, text in rows for t in letters(text))
    assert documents == Counter((a, b, t) for a, b, text in rows for t in set(letters(text)))


def test_radix_order_is_stable():
    rng = np.random.default_rng(1)
    for words_ in (rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 50, 5000).astype(np.uint64), np.zeros(0, np.uint64)):
        assert source_audit.radix_order(words_).tolist() == np.argsort(words_, kind="stable").tolist()


# ---- ids beyond what a float holds, beside a null


def test_ids_pass_unharmed(spark, tmp_path):
    ids = [*BIG, 3]
    turns = spark.createDataFrame([(i, k, r, f"{i}") for i in ids for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.segments(turns.coalesce(1)))
    assert Counter((r.conv_id, r.n_turns) for r in read.collect()) == Counter((i, 2) for i in ids)

    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").coalesce(1)
    assert Counter(r.doc_id for r in packing.packed_documents(docs).collect()) == Counter(ids)

    payload = bytearray(b"p" * 1500)
    pages = [(i, f"http://x/{i}", payload) for i in (2**53, 2**53 + 1)] + [(None, None, bytearray(b"q")), (2**63 - 1, "u", bytearray(b"z" * 100_000))]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, payload binary").coalesce(1), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.resolve_revisits(warc.read_archives(spark, str(tmp_path / "w"))).collect()}
    assert set(got) == {2**53, 2**53 + 1, None, 2**63 - 1}
    assert (got[2**53].refers_to, got[2**53].payload_bytes, got[2**53].problem) == (2**53 + 1, 1500, None)
    assert got[2**53 + 1].refers_to is None and got[2**63 - 1].payload_bytes == 100_000


# ---- scoring by weighted words only


def test_scorer_equals_the_model():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["Wort", "wortreich", "wortreicher", "x", "Éclair", "1234567890", "a_b"]) + rng.choice(["", "s"]) for _ in range(40)) for _ in range(30)]
    rows = linear.Rows.of([linear.features(t) for t in texts])
    ids = np.unique(rows.ids)[::2].astype(np.int64)
    model = linear.Model(ids, np.random.default_rng(1).normal(size=len(ids)), np.zeros(0), -0.3)
    scorer = linear.Scorer(model)
    for _ in range(2):
        assert np.allclose([scorer.score(t, set()) for t in texts], model.predict(rows, np.zeros((len(texts), 0))), atol=1e-12)


# ---- personal data beyond the base


def test_secrets_and_terms_that_point_to_them(spark):
    rng = random.Random(5)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    prose = lambda n: " ".join("".join(rng.choice("aeioumnr") for _ in range(5)) for _ in range(n))
    rows = [(k, f"{prose(30)} zutoken = '{t}' {prose(30)}") for k in range(30) for t in [token()]]
    rows += [(k, prose(60)) for k in range(100, 700)] + [(800, "a" * 40 + " " + "1" * 40 + " " + token()[:31]), (801, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r["term"], r["kind"]) for r in pii.disclosing_terms(docs).collect()] == [("zutoken", "secret")]
    found = {r["row"]["doc_id"]: r for r in pii.spans_report(docs).collect()}
    for doc_id, text in rows:
        want = [f"secret:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{40}", text or "") if doc_id < 100]
        want += [f"term:{m.start()}:{m.end()}" for m in re.finditer("zutoken", text or "")]
        assert sorted(found[doc_id]["spans"].split(",")) == sorted(want or [""])
        assert (found[doc_id]["n_secret"], found[doc_id]["is_private"]) == (int(doc_id < 100), doc_id < 100)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("zutoken" not in clean[k] and "[SECRET]" in clean[k] for k in range(30)) and clean[100] == rows[30][1]


def test_places_of_matches_at_block_borders(spark):
    for n in (0, 1, 63, 64, 65, 4095, 4097, 20_000):
        text = "é" + "".join(f" {'x' * (k % 3)}7" for k in range(n))
        rows = spark.createDataFrame([(text,)], "text string").select(pii.spans_of(F.col("text"), F.lit("x*7")).alias("s")).first()["s"]
        assert [(r["start"], r["stop"]) for r in rows] == [m.span() for m in re.finditer("x*7", text)]

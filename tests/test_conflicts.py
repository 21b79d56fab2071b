"""In-order taking of keyed statements against a plain loop."""

import random

import pytest

from restitch import take_in_order
from restitch.operators import conflicts


def in_order(claims, present):
    taken, verdicts, by_statement = set(present), {}, {}
    for script, seq, key in claims:
        by_statement.setdefault((script, seq), []).append(key)
    for place, keys in sorted(by_statement.items()):
        ok = len(set(keys)) == len(keys) and taken.isdisjoint(keys)
        verdicts[place] = ok
        if ok:
            taken.update(keys)
    return verdicts


def check(spark, claims, present, **options):
    df = spark.createDataFrame([(s, q, *k) for s, q, k in claims], "script_idx long, seq long, k1 int, k2 string")
    there = spark.createDataFrame(list(present), "k1 int, k2 string") if present else None
    got = take_in_order(df, ["k1", "k2"], there, **options).collect()
    assert len(got) == len({(r.script_idx, r.seq) for r in got})
    assert {(r.script_idx, r.seq): r.taken for r in got} == in_order(claims, present)


@pytest.mark.parametrize("n_keys", [4, 40, 400])
def test_random(spark, n_keys):
    rng = random.Random(n_keys)
    key = lambda: (rng.randrange(n_keys // 2), rng.choice("ab"))
    claims = [(s, q, key()) for s in range(3) for q in range(40) for _ in range(rng.randrange(1, 4))]
    check(spark, claims, {key() for _ in range(n_keys // 10)})


def test_hot_keys_and_statements(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "HOT_ROWS", 3)
    rng = random.Random(1)
    claims = [(0, q, (1 if q % 3 == 0 else q, "a")) for q in range(60)]
    claims += [(1, 5, (q, "b")) for q in range(30)] + [(2, q, (rng.randrange(40), "b")) for q in range(30)]
    check(spark, claims, {(7, "a")})


@pytest.mark.parametrize("walked", [0, 20, 1000])
def test_chains_and_parts(spark, monkeypatch, walked):
    """Walked in one task or followed link by link: the answer is the same."""
    monkeypatch.setattr(conflicts, "WALK_CLAIMS", walked)
    monkeypatch.setattr(conflicts, "SLOW_ROUND", 0.0)
    rng = random.Random(walked)
    chain = [(0, q, (q + d, "a")) for q in range(70) for d in (0, 1)]
    # Statements that wait for two and for three earlier ones, and a side chain into the long one.
    ladder = [(1, q, (q + d, "b")) for q in range(12) for d in (0, 1, 2)]
    side = [(2, q, (q + d, "c")) for q in range(6) for d in (0, 1)] + [(2, 6, (6, "c")), (2, 6, (35, "a"))]
    check(spark, chain + ladder + side, {(0, "a")})
    check(spark, [(s, q, (rng.randrange(60), "x")) for s in range(2) for q in range(50) for _ in "12"], set())


def test_rounds_do_not_grow_with_a_chain(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "WALK_CLAIMS", 0)
    rounds = []
    settle = conflicts._settled_in_round
    monkeypatch.setattr(conflicts, "_settled_in_round", lambda *a, **k: rounds.append(1) or settle(*a, **k))
    check(spark, [(0, q, (q + d, "a")) for q in range(300) for d in (0, 1)], set())
    assert len(rounds) <= 3


def test_keys_keep_their_types(spark):
    """Instants 100 microseconds apart are different keys, and equal numbers of other columns are no clash."""
    df = spark.sql(
        "select 0L script_idx, id seq, timestamp_micros(1700000000000000 + (id div 2) * 100) at, id % 2 key, id n from range(40)"
    )
    assert all(r.taken for r in take_in_order(df, ["at", "key"]).collect())
    assert [r.taken for r in take_in_order(df, ["at"]).orderBy("seq").collect()] == [q % 2 == 0 for q in range(40)]


def test_several_unique_keys(spark):
    rng = random.Random(3)
    rows = [(q, rng.randrange(60), rng.choice([None, *range(60)]), rng.randrange(30)) for q in range(60) for _ in range(rng.randrange(1, 3))]
    old = [(100, 1, 2), (5, None, 7)]
    taken, want = {("a", 100), ("a", 5), ("b", (1, 2))}, {}
    for q in range(60):
        held = [k for s, a, b, c in rows if s == q for k in ([("a", a)] + ([("b", (b, c))] if b is not None else []))]
        if held:
            want[q] = len(held) == len(set(held)) and taken.isdisjoint(held)
            taken |= set(held) if want[q] else set()
    df = spark.createDataFrame([(0, *r) for r in rows], "script_idx long, seq long, a int, b int, c int")
    got = take_in_order(df, [["a"], ["b", "c"]], spark.createDataFrame(old, "a int, b int, c int")).collect()
    assert {r.seq: r.taken for r in got} == want


def test_nothing_to_take(spark):
    check(spark, [], set())


def test_a_chain_is_followed_at_once_in_blocks(spark, monkeypatch):
    """Nothing looks for the parts of a chain, and what is looked up link by link are the blocks' first links alone."""
    monkeypatch.setattr(conflicts, "WALK_CLAIMS", 0)
    monkeypatch.setattr(conflicts, "BLOCK_BITS", 4)
    monkeypatch.setattr(conflicts, "_parts", None)
    sizes, ends = [], conflicts._ends_of_chains
    monkeypatch.setattr(conflicts, "_ends_of_chains", lambda links: sizes.append(links.count()) or ends(links))
    chain = [(0, q, (q + d, "a")) for q in range(300) for d in (0, 1)]
    side = [(1, q, (q * 7 + d, "a" if d else "b")) for q in range(20) for d in (0, 290)]
    check(spark, chain + side, set())
    assert sizes and max(sizes) <= 40


def test_hot_keys_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "HOT_ROWS", 3)
    monkeypatch.setattr(conflicts, "WALK_CLAIMS", 0)
    rng = random.Random(5)
    claims = [(0, q, (1 if q % 3 == 0 else q, "a")) for q in range(40)]
    claims += [(1, 5, (q, "b")) for q in range(30)] + [(2, q, (rng.randrange(25), "b")) for q in range(30)]
    check(spark, claims, {(7, "a")})


def test_keys_of_one_row_take_part_in_no_round(spark, monkeypatch):
    monkeypatch.setattr(conflicts, "WALK_CLAIMS", 0)
    rows = []
    settle = conflicts._settled_in_round
    monkeypatch.setattr(conflicts, "_settled_in_round", lambda claims, *a, **k: rows.append(claims.count()) or settle(claims, *a, **k))
    check(spark, [(0, q, (q, "a")) for q in range(50)] + [(1, 0, (70, "a")), (1, 1, (70, "a"))], {(80, "a")})
    assert rows == [2]

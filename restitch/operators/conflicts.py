"""Which statements a keyed table takes when a dump is run in order.

A statement is taken as a whole if none of its keys is in the table yet, from before
or from an earlier statement; otherwise it fails as a whole and leaves no key behind. A
table may have several unique keys; a statement fails if it clashes in any of them. Rows
with a null in a key don't clash in that key.

Keys that one row alone holds, and that are not in the table, decide nothing and are left out. The
rest gets numbers: a key's number stands for one value of one key, in its own type, and
statements are numbered in run order. All further work is on these.

Then rounds: statements that come first for all of their keys are taken, others that hold
a key of a taken one fail. What is left waits for earlier statements. Where a statement
waits for a single one, it is taken just if that one isn't, so whole chains of these are
settled at once: blocks of statements next to each other shorten their chains side by side, and what
goes from block to block looks up the one it waits for, then the one that waits for, twice as far
each time (pointer jumping), until the chain's beginning says which of them, in turn,
are taken. What waits for several at once is split into parts that share no key; parts
of bounded size are walked in order, many at a time, and larger ones go on in rounds. A
rest of that size is walked as it is. All ways give the same answer, and nothing depends on
how many rounds there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restitch import session
from restitch.session import checkpoint

STATEMENT = ("script_idx", "seq")

# A value shared by more rows than this, or than one in HOT_SHARE of all, is hot. There
# are at most HOT_SHARE hot values, so their facts are small enough to be broadcast.
HOT_ROWS = 100_000
HOT_SHARE = 10_000

# Parts of statements that hold at most so many keys in all are walked, each in one task.
WALK_CLAIMS = 200_000
# Chains are followed, and parts looked for, after rounds that leave more than this share open.
SLOW_ROUND = 0.25
# Chains are followed at once where fewer statements than this share of those in chains come first.
FEW_LEADS = 0.1
# Blocks of 2 to the power of this many numbers shorten their chains in one task each.
BLOCK_BITS = 20


def _staged(df: DataFrame) -> DataFrame:
    return session.stage(df, "claims")


def _look_up(rows: DataFrame, facts: DataFrame, on: Sequence[str], n_rows: int, how: str = "inner") -> DataFrame:
    """Join facts about single values (`n` rows each; staged) to rows, whatever the share of one value.

    Facts of hot values travel to the rows; all others meet their rows in a shuffle.
    """
    on = list(on)
    hot_above = max(HOT_ROWS, n_rows // HOT_SHARE)
    if n_rows <= hot_above or facts.where(F.col("n") > hot_above).isEmpty():
        return rows.join(facts.drop("n"), on, how)
    hot = F.broadcast(facts.where(F.col("n") > hot_above))
    cold = facts.where(F.col("n") <= hot_above)
    rare = rows.join(hot.select(*on), on, "left_anti").join(cold.drop("n"), on, how)
    return rows.join(hot.drop("n"), on).unionByName(rare)


def _contested(claims: DataFrame, names: Sequence[str], present: DataFrame | None) -> DataFrame:
    """`(key, n, gone)` for each value of a key that several rows hold, or that is in the table."""
    values = claims.groupBy(*names).agg(F.count("*").alias("n"))
    if present is None:
        return values.where("n > 1").withColumn("gone", F.lit(False))
    there = present.select(*names).distinct().withColumn("there", F.lit(True))
    met = values.join(there, list(names), "left").withColumn("gone", F.coalesce("there", F.lit(False))).drop("there")
    return met.where("n > 1 or gone")


def _numbered_claims(
    claims: DataFrame, statement: Sequence[str], unique: Sequence[Sequence[str]], present: DataFrame | None
) -> tuple[DataFrame, DataFrame, bool]:
    """Claims on contested keys `(at, key, n, gone)`, `n` times each; their statements, with numbers that grow in run order; whether a key is hot."""
    held, n_rows, most = [], 0, 0
    for k, names in enumerate(unique):
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
        columns = [f"key_{i}" for i in range(len(names))]
        named = [F.col(c).alias(key) for c, key in zip(names, columns, strict=True)]
        rows = claims.where(full).select(*statement, *named)
        old = None if present is None else present.where(full).select(*named)
        values = checkpoint(_contested(rows, columns, old))
        n_values, n, n_hottest = values.agg(F.count("*"), F.sum("n"), F.max("n")).first()
        if n_values:
            values = values.withColumn("key", F.monotonically_increasing_id() * len(unique) + k)
            held.append(_look_up(rows, values, columns, n).select(*statement, "key", "gone"))
            n_rows, most = n_rows + n, max(most, n_hottest)
    if not held:
        none = claims.sparkSession.createDataFrame([], "at long, key long, n long, gone boolean")
        return none, claims.select(*statement).withColumn("at", F.lit(0).cast("long")).limit(0), False
    rows = _staged(reduce(DataFrame.unionByName, held))
    placed = rows.groupBy(*statement).agg(F.count("*").alias("n")).orderBy(*statement)
    placed = _staged(placed.withColumn("at", F.monotonically_increasing_id()))
    numbered = _look_up(rows, placed, statement, n_rows).groupBy(*statement, "at", "key")
    numbered = numbered.agg(F.count("*").alias("n"), F.max("gone").alias("gone")).drop(*statement)
    return _staged(numbered), placed.select(*statement, "at"), most > HOT_ROWS


def _heads(claims: DataFrame, n_rows: int, hot: bool) -> DataFrame:
    """Claims with the first and second statement that hold their key."""
    if not hot:
        by_key = Window.partitionBy("key").orderBy("at")
        ranked = claims.select("at", "key", F.first("at").over(by_key).alias("first"), F.row_number().over(by_key).alias("rank"))
        return ranked.select("at", "first", (F.col("rank") == 2).alias("is_second"), (F.col("rank") > 2).alias("is_later"))
    firsts = _staged(claims.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    ranked = _staged(_look_up(claims, firsts, ["key"], n_rows))
    later = ranked.where(F.col("at") > F.col("first"))
    seconds = _staged(later.groupBy("key").agg(F.min("at").alias("second"), F.count("*").alias("n")))
    headed = _look_up(ranked, seconds, ["key"], n_rows, "left")
    is_second, is_later = F.col("at") == F.col("second"), F.col("at") > F.col("second")
    return headed.select("at", "first", F.coalesce(is_second, F.lit(False)).alias("is_second"), F.coalesce(is_later, F.lit(False)).alias("is_later"))


def _shortened(links: pd.DataFrame) -> pd.DataFrame:
    """Each link followed as far as these links go."""
    links = links.sort_values("at")
    at, up, odd = (links[c].to_numpy(copy=True) for c in ("at", "up", "odd"))
    onward = np.minimum(np.searchsorted(at, up), len(at) - 1)
    more = at[onward] == up
    while more.any():
        here = np.flatnonzero(more)
        to = onward[here]
        odd[here] ^= odd[to]
        up[here], onward[here], more[here] = up[to], onward[to], more[to]
    return pd.DataFrame({"at": at, "up": up, "odd": odd})


def _ends_of_chains(links: DataFrame) -> DataFrame:
    """`(at, up, odd)` for links of that kind: the end of each chain, and whether it is an odd number of steps away."""
    known = links.select(F.col("at").alias("up"), F.lit(True).alias("more"))
    jumps = _staged(links.join(known, "up", "left").select("at", "up", "odd", F.coalesce("more", F.lit(False)).alias("more")))
    while not jumps.where("more").isEmpty():
        onward = jumps.select(F.col("at").alias("up"), F.col("up").alias("further"), F.col("odd").alias("too"), F.col("more").alias("still"))
        moved = jumps.where("more").join(onward, "up")
        moved = moved.select("at", F.col("further").alias("up"), (F.col("odd") != F.col("too")).alias("odd"), F.col("still").alias("more"))
        # What has arrived is looked up, but looks up nothing more.
        jumps = _staged(jumps.where("not more").unionByName(moved))
    return jumps.drop("more")


def _settled_along_chains(links: DataFrame, leads: DataFrame, n_links: int, n_leads: int) -> DataFrame:
    """Verdicts on what waits for a statement in `leads`, itself or through others that wait for one: `links (at, up)`."""
    links = links.withColumn("odd", F.lit(True))
    kind = "at long, up long, odd boolean"
    block = F.shiftright("at", BLOCK_BITS).alias("block")
    short = _staged(links.groupBy(block).applyInPandas(_shortened, kind))
    exits = _staged(short.groupBy("up").agg(F.count("*").alias("n")))
    middle = _staged(short.join(exits.select(F.col("up").alias("at")), "at", "left_semi"))
    if middle.count() <= WALK_CLAIMS:
        ends = middle.groupBy(F.lit(True)).applyInPandas(_shortened, kind)
    else:
        ends = _ends_of_chains(middle)
    ends = ends.select(F.col("at").alias("up"), F.col("up").alias("end"), F.col("odd").alias("too"))
    ended = exits.join(ends, "up", "left").select("up", "n", F.coalesce("end", "up").alias("at"), F.coalesce("too", F.lit(False)).alias("too"))
    # Many chains may have one end, so a small table travels to them.
    sure = _staged(ended.join(F.broadcast(leads) if n_leads <= WALK_CLAIMS else leads, "at", "left_semi").drop("at"))
    return _look_up(short, sure, ["up"], n_links).select("at", (F.col("odd") == F.col("too")).alias("taken"))


def _parts(claims: DataFrame, n_rows: int) -> DataFrame:
    """`(at, part)`: statements connected by keys have one part, the least statement's number.

    Large-star and small-star steps in turn (Kiveris et al. 2014).
    """
    firsts = claims.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    edges = _look_up(claims, _staged(firsts), ["key"], n_rows).where("at <> first").select(F.col("at").alias("a"), F.col("first").alias("b"))
    edges, before = checkpoint(edges.distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("low"))
        wide = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        wide = wide.where("a <> b").distinct()
        low = wide.groupBy("a").agg(F.min("b").alias("low"))
        others = wide.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = checkpoint(low.select("a", F.col("low").alias("b")).unionByName(others).distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    placed = claims.select("at").distinct().join(edges.select(F.col("a").alias("at"), F.col("b").alias("part")), "at", "left")
    return placed.select("at", F.coalesce("part", "at").alias("part"))


def _walk(claims: pd.DataFrame) -> pd.DataFrame:
    claims = claims.sort_values("at")
    at, keys = claims["at"].to_numpy(), claims["key"].tolist()
    firsts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    taken: set[int] = set()
    verdicts = []
    for begin, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(keys)], strict=True):
        held = keys[begin:end]
        verdicts.append(taken.isdisjoint(held))
        if verdicts[-1]:
            taken.update(held)
    return pd.DataFrame({"at": at[firsts], "taken": verdicts})


def _settled_by_walking(claims: DataFrame, n_rows: int) -> DataFrame:
    """Verdicts on the statements of all parts that are small enough for one task."""
    if n_rows <= WALK_CLAIMS:
        return _staged(claims.groupBy(F.lit(True)).applyInPandas(_walk, "at long, taken boolean"))
    placed = claims.join(_parts(claims, n_rows), "at")
    small = placed.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= WALK_CLAIMS).select("part")
    return _staged(placed.join(small, "part").groupBy("part").applyInPandas(_walk, "at long, taken boolean"))


def _settled_in_round(claims: DataFrame, n_rows: int, hot: bool, chains: bool) -> DataFrame:
    """Verdicts of one round: those that come first are taken, and with `chains` what waits for one of them in line."""
    headed = _heads(claims, n_rows, hot)
    waits_for = F.when(F.col("is_second"), F.col("first"))
    told = headed.groupBy("at").agg(
        F.min(F.col("first") == F.col("at")).alias("leads"),
        F.max("is_later").alias("many"),
        F.min(waits_for).alias("up"),
        F.max(waits_for).alias("up_too"),
    )
    told = _staged(told.select("at", "leads", "up", (~F.col("leads") & ~F.col("many") & (F.col("up") == F.col("up_too"))).alias("in_line")))
    leads, links = told.where("leads").select("at"), told.where("in_line").select("at", "up")
    n_leads, n_links = told.agg(F.count_if("leads"), F.count_if("in_line")).first()
    done = leads.withColumn("taken", F.lit(True))
    if n_links and (chains or n_leads < FEW_LEADS * n_links):
        done = done.unionByName(_settled_along_chains(links, leads, n_links, n_leads))
    return done


def clashing(
    claims: DataFrame,
    keys: Sequence[str] | Sequence[Sequence[str]],
    present: DataFrame | None = None,
    statement: Sequence[str] = STATEMENT,
) -> DataFrame:
    """The statements in `claims` that fail, by the columns in `statement`; see `take_in_order`."""
    unique = [list(keys)] if all(isinstance(k, str) for k in keys) else [list(k) for k in keys]
    names = list(dict.fromkeys(c for k in unique for c in k))
    # Columns get names of their own, so key columns may be called like those of the statement.
    placed = [f"statement_{i}" for i in range(len(statement))]
    own = [F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(names)]
    claims = claims.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(statement, placed, strict=True)], *own)
    if present is not None:
        present = present.select(*own)
    unique = [[f"own_{names.index(c)}" for c in k] for k in unique]

    numbered, statements, hot = _numbered_claims(claims, placed, unique, present)
    failed = _staged(numbered.where("n > 1 or gone").select("at").distinct())
    settled = [failed]
    still = _staged(numbered.select("at", "key").join(failed, "at", "left_anti"))
    n_open, n_before, tries = still.count(), None, 0
    while n_open:
        if n_open <= WALK_CLAIMS:
            settled.append(_settled_by_walking(still, n_open).where("not taken").select("at"))
            break
        # After slow rounds, chains are followed, then parts looked for; these stay too large until rounds have taken them apart.
        tries = tries + 1 if n_before is not None and n_open > SLOW_ROUND * n_before else 0
        if tries % 3 == 2:
            done = _settled_by_walking(still, n_open)
        else:
            done = _settled_in_round(still, n_open, hot, chains=tries % 3 == 1)
        # The key tells of all who hold it whether one of them is taken.
        marked = _staged(still.join(done, "at", "left"))
        settled.append(marked.where("not taken").select("at").distinct())
        left = marked.where("taken is null").select("at", "key")
        if left.isEmpty():
            break
        taken_keys = marked.where("taken").select("key")
        lost = _staged(left.join(taken_keys, "key", "left_semi").select("at").distinct())
        settled.append(lost)
        still = _staged(left.join(lost, "at", "left_anti"))
        n_before, n_open = n_open, still.count()
    lost = statements.join(reduce(DataFrame.unionByName, settled), "at", "left_semi")
    return lost.select(*[F.col(p).alias(c) for c, p in zip(statement, placed, strict=True)])


def take_in_order(
    claims: DataFrame,
    keys: Sequence[str] | Sequence[Sequence[str]],
    present: DataFrame | None = None,
    statement: Sequence[str] = STATEMENT,
) -> DataFrame:
    """`(script_idx, seq, taken)` for every statement in `claims` (a row per row to insert).

    `keys` are the columns of the key, or several lists of these. Rows of `present` have the same
    columns. `statement` names the columns that tell statements apart and put them in order.
    """
    lost = clashing(claims, keys, present, statement).withColumn("lost", F.lit(True))
    told = claims.select(*statement).distinct().join(lost, list(statement), "left")
    return told.select(*statement, F.col("lost").isNull().alias("taken"))

"""What happens to every statement of a run: applied, failed or skipped, and why."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch.operators.conflicts import clashing
from restitch.operators.restore import POSITION, Target, statement_problems, typed_rows
from restitch.session import checkpoint

_PLACE = [*POSITION, "unit"]


@dataclass(frozen=True)
class Settled:
    """`outcomes (script_idx, seq, table_name, status, reason)`, and the rows `left_out (script_idx, seq, row_no)` of statements that ignore clashes."""

    outcomes: DataFrame
    left_out: DataFrame


def _key_text(column: Column, data_type: T.DataType) -> Column:
    """A key column as text that is equal just where its values are."""
    return F.hex(column) if isinstance(data_type, T.BinaryType) else column.cast("string")


def _keys(target: Target, prefix: str) -> Column:
    """`array<struct<index, value>>`: the row's value of each unique key, NULL where a part is."""
    types = {f.name: f.dataType for f in target.schema.fields}

    def one(index: int, names) -> Column:
        parts = [_key_text(F.col(f"{prefix}`{c}`"), types[c]) for c in names]
        whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        return F.struct(F.lit(index).alias("index"), F.when(whole, F.array(*parts)).alias("value"))

    return F.array(*[one(k, names) for k, names in enumerate([n for n in (target.keys, *target.unique) if n])])


def settle(parsed: DataFrame, targets: Mapping[str, Target]) -> Settled:
    """Settle all statements. Clashes of all tables are settled at once, on (table, key, value).

    A row of a statement that ignores clashes stands for itself. Statements that replace or update
    rows hold their keys from then on, whatever was there.
    """
    outcomes = statement_problems(parsed, targets)
    none = parsed.sparkSession.createDataFrame([], "script_idx long, seq long, row_no long")
    keyed = {t: target for t, target in targets.items() if target.keys or target.unique}
    if not keyed:
        return Settled(outcomes.select(*POSITION, "table_name", "status", "reason"), none)
    outcomes = checkpoint(outcomes)
    claims, present = [], []
    for table, target in keyed.items():
        name = F.lit(table).alias("table_name")
        unit = F.when(F.col("mode") == "ignore", F.col("row_no").cast("long") + 1).otherwise(F.lit(0).cast("long")).alias("unit")
        rows = typed_rows(parsed, table, target)
        claims.append(rows.select(*POSITION, unit, "mode", name, F.explode(_keys(target, "row.")).alias("k")))
        if target.existing is not None:
            present.append(target.existing.select(name, F.explode(_keys(target, "")).alias("k")))
    columns = ["table_name", F.col("k.index").alias("index"), F.col("k.value").alias("value")]
    sound = outcomes.where("status = 'ok'").select(*POSITION)
    held = reduce(DataFrame.unionByName, claims).join(sound, POSITION, "left_semi").select(*_PLACE, "mode", *columns)
    held = checkpoint(held)
    there = reduce(DataFrame.unionByName, present).select(*columns).where("value is not null") if present else None
    key = ["table_name", "index", "value"]
    place = F.struct(*_PLACE)
    firm = held.where("mode in ('replace', 'update')")
    open_claims = held.where("mode in ('insert', 'ignore')")
    late = None
    if not firm.isEmpty():
        # From the first statement on that sets a key whatever is there, the key is taken for all others.
        since = firm.groupBy(*key).agg(F.min(place).alias("since"))
        late = checkpoint(open_claims.join(since, key).where(place > F.col("since")).select(*_PLACE).distinct())
        open_claims = open_claims.join(late, _PLACE, "left_anti")
    clash = clashing(open_claims.select(*_PLACE, *key), key, there, statement=_PLACE)
    clash = checkpoint(clash if late is None else clash.unionByName(late))
    failed = clash.where("unit = 0").select(*POSITION, F.lit(True).alias("clash"))
    outcomes = outcomes.join(failed, POSITION, "left").select(
        *(*POSITION, "table_name"),
        F.when(F.col("clash"), "failed").otherwise(F.col("status")).alias("status"),
        F.when(F.col("clash"), "duplicate_key").otherwise(F.col("reason")).alias("reason"),
    )
    left_out = clash.where("unit > 0").select(*POSITION, (F.col("unit") - 1).alias("row_no"))
    return Settled(outcomes, left_out)


def resolve(parsed: DataFrame, targets: Mapping[str, Target], stop_on_error: bool = False) -> DataFrame:
    """`(script_idx, seq, table_name, status, reason)` per statement that was run.

    By default a failing statement is passed over. With `stop_on_error` the run ends at
    the first failure, in later scripts too: that statement is the last one listed.
    No foreign key is ever checked. `parsed` is read several times; stage it first.
    """
    outcomes = settle(parsed, targets).outcomes
    return until_first_failure(outcomes) if stop_on_error else outcomes


def until_first_failure(outcomes: DataFrame) -> DataFrame:
    """Outcomes up to and including the first failure in run order."""
    outcomes = checkpoint(outcomes)
    place = F.struct(*POSITION)
    stop = outcomes.where("status = 'failed'").agg(F.min(place)).scalar()
    return outcomes.withColumn("stop", stop).where(F.col("stop").isNull() | (place <= F.col("stop"))).drop("stop")


def applied_rows(
    parsed: DataFrame, outcomes: DataFrame, table: str, target: Target, left_out: DataFrame | None = None
) -> DataFrame:
    """Rows of the applied statements that insert, to be added to the table."""
    rows = _applied(parsed, outcomes, table, target)
    if target.keys or target.unique:
        # Without keys there is nothing to replace or to update.
        rows = rows.where("mode in ('insert', 'ignore')")
    if left_out is not None:
        rows = rows.join(left_out, [*POSITION, "row_no"], "left_anti")
    return rows.select("row.*")


def _applied(parsed: DataFrame, outcomes: DataFrame, table: str, target: Target) -> DataFrame:
    applied = outcomes.where("status = 'ok'").select(*POSITION)
    return typed_rows(parsed, table, target).join(applied, POSITION, "left_semi")


def table_after(parsed: DataFrame, settled: Settled, table: str, target: Target) -> DataFrame:
    """All rows of a table with one key after a run, with rows replaced and updated in run order.

    For each key the rows that are met in order make one: a row that comes first, or replaces, sets all columns;
    an update sets some and adds to others. So a column is what the last that set it says, and what was
    added since: two aggregations, whatever the number of rows of a key.
    """
    names = [f.name for f in target.schema.fields]
    at = F.struct(*(F.col(c).cast("long").alias(c) for c in (*POSITION, "row_no")))
    all_rows = _applied(parsed, settled.outcomes, table, target).join(settled.left_out, [*POSITION, "row_no"], "left_anti")
    events = all_rows.select(at.alias("at"), "mode", "row", "updates")
    if target.existing is not None:
        before = F.struct(*(F.lit(-1).cast("long").alias(c) for c in (*POSITION, "row_no")))
        old = target.existing.select(before.alias("at"), F.lit("insert").alias("mode"), F.struct(*(F.col(f"`{c}`").alias(c) for c in names)).alias("row"))
        events = events.unionByName(old.withColumn("updates", F.lit(None).cast(events.schema["updates"].dataType)))
    keys = [f"k{i}" for i in range(len(target.keys))]
    events = checkpoint(events.select(*(F.col(f"row.`{c}`").alias(k) for c, k in zip(target.keys, keys, strict=True)), "*"))
    firsts = events.groupBy(*keys).agg(F.min("at").alias("first"))
    known = events.join(firsts, keys).withColumn("sets_all", (F.col("mode") != "update") | (F.col("at") == F.col("first")))
    value = {}
    for i, name in enumerate(names):
        new = F.col(f"updates.c{i}")
        sets = F.when(F.col("sets_all"), F.struct("at", F.col(f"row.`{name}`").alias("value")))
        value[i] = sets.when(new.isNotNull() & ~new["adds"], F.struct("at", new["value"].alias("value")))
    known = checkpoint(known)
    last = known.groupBy(*keys).agg(*[F.max(value[i]).alias(f"s{i}") for i in value])
    adding = [i for i, f in enumerate(target.schema.fields) if isinstance(f.dataType, T.NumericType) and f.name not in target.keys]
    added = known.where("not sets_all").where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"updates.c{i}.adds"), F.lit(False)) for i in adding], F.lit(False)))
    if adding and not added.isEmpty():
        late = added.join(last.select(*keys, *[F.col(f"s{i}.at").alias(f"t{i}") for i in adding]), keys)
        sums = []
        for i in adding:
            counts = F.coalesce(F.col(f"updates.c{i}.adds"), F.lit(False)) & (F.col("at") > F.col(f"t{i}"))
            amount = F.col(f"updates.c{i}.value")
            # Adding NULL makes NULL.
            sums += [F.sum(F.when(counts, amount)).alias(f"a{i}"), F.max(counts & amount.isNull()).alias(f"n{i}")]
        last = last.join(late.groupBy(*keys).agg(*sums), keys, "left")
        for i in adding:
            total = F.col(f"s{i}.value") + F.coalesce(F.col(f"a{i}"), F.lit(0))
            total = F.when(F.coalesce(F.col(f"n{i}"), F.lit(False)), None).otherwise(total)
            last = last.withColumn(f"v{i}", total.cast(target.schema.fields[i].dataType))
    else:
        adding = []
    final = [F.col(f"v{i}" if i in adding else f"s{i}.value").alias(name) for i, name in enumerate(names)]
    return last.select(*final)


def failures(outcomes: DataFrame, statements: DataFrame) -> DataFrame:
    """Failed statements with their text and reason."""
    failed = outcomes.where("status = 'failed'").select(*POSITION, "reason")
    return statements.select(*POSITION, "text").join(failed, POSITION)

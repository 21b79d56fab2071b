"""Rows of INSERT statements that are too long to be put together in one place.

The statement is taken as a sequence of pieces: its lines, and of lines that are not whole their
fragments. Where a piece begins inside a string or a note, its brackets and commas mean
nothing, so each piece is summed up first for every state that it may be entered in (plain text,
either kind of string, either kind of note): the state it leaves, how brackets nest, and whether
it closes one. These are functions from state to state, and functions compose: running compositions
per chunk and statement, then over one row per chunk, give each piece the state it is really
entered in. The depth of brackets and the number of tuples closed so far are prefix sums in the same
two steps. Pieces between two places where a bracket closes at depth zero belong
together; they are a few tuples, whose text is joined and parsed like that of any statement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restitch.functions.inserts import (
    GROUP_OF_TUPLES,
    bare_text,
    insert_columns,
    insert_head,
    insert_mode,
    insert_table,
    leaves,
    statement_kind,
    tuple_values,
    tuples_of,
)
from restitch.operators.restore import POSITION, STATEMENT_COLUMNS, parse
from restitch.operators.segment import Segmentation
from restitch.session import checkpoint, shuffle_partitions, stage

# States a piece may be entered in: text, ' string, " string, /* note, note to the end of the line.
STATES = 5
IDENTITY = sum(s * STATES**s for s in range(STATES))
# Tables of long statements and lines are sent to all executors up to so many rows.
BROADCAST_ROWS = 500_000
# Characters in which the names of table and columns are looked for.
HEAD_CHARS = 1 << 17
# Tuples of one group of pieces are numbered below this; a piece can't hold as many.
GROUP_ROWS = 1 << 31

UPDATES = "array<struct<column: string, adds: boolean, source: string, value: struct<kind: string, text: string>>>"

_CHUNK = [*POSITION, "chunk"]
_ORDER = ["line_no", "pos", "part"]


def _few(rows: DataFrame) -> DataFrame:
    rows = checkpoint(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def statement_pieces(segmentation: Segmentation, fragments: DataFrame | None = None) -> DataFrame:
    """`(script_idx, seq, chunk, line_no, pos, part, text)` of statements without text; pieces end with a line break or `),`."""
    long = _few(segmentation.long_statements().select(*POSITION))
    lines = segmentation.statement_lines().join(long, POSITION, "left_semi")
    zero = F.lit(0).cast("long")
    whole = lines.where("whole").select(
        *_CHUNK, F.col("pos").alias("line_no"), zero.alias("pos"), zero.cast("int").alias("part"), F.concat("text", F.lit("\n")).alias("text")
    )
    if fragments is None:
        return whole
    # Where a line starts with a note, its text is what follows the note.
    kept_from = segmentation.lines.where("not whole").select("script_idx", F.col("pos").alias("line_no"), "kept_from", "kept_from_versioned")
    start = F.col("kept_from" if not segmentation.keep_versioned else "kept_from_versioned").alias("start")
    cut = lines.where("not whole").select(*POSITION, F.col("pos").alias("line_no")).join(kept_from, ["script_idx", "line_no"])
    cut = _few(cut.select(*POSITION, "line_no", start))
    last = fragments.groupBy("script_idx", "line_no").agg(F.max(F.struct("chunk", "pos", "part")).alias("last"))
    cut = _few(cut.join(last, ["script_idx", "line_no"]))
    place = F.struct("chunk", "pos", "part")
    text = F.when(place == F.col("start"), F.substring_index("text", "*/", -1)).otherwise(F.col("text"))
    text = F.when(place == F.col("last"), F.concat(text, F.lit("\n"))).otherwise(text)
    parts = fragments.join(cut, ["script_idx", "line_no"]).where(F.col("start").isNull() | (place >= F.col("start")))
    return whole.unionByName(parts.select(*_CHUNK, *_ORDER, text.alias("text")))


def _composed(first: int, then: int) -> int:
    """The function `then` after the function `first`, both as digits to base `STATES`."""
    return sum(then // STATES ** (first // STATES**s % STATES) % STATES * STATES**s for s in range(STATES))


def _running(frames: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Replace `code` by the composition of the codes before it within the rows of equal `keys`, which follow each other."""
    group, state = None, IDENTITY
    for frame in frames:
        codes = frame.column("code").to_numpy()
        columns = np.stack([frame.column(k).to_numpy() for k in keys])
        new = np.ones(len(codes), bool)
        new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
        out, at = np.empty(len(codes), np.int32), 0
        for row in np.flatnonzero(new | (codes != IDENTITY)).tolist():
            out[at:row] = state
            if new[row] and (mine := columns[:, row].tolist()) != group:
                group, state = mine, IDENTITY
            out[row] = state
            state = _composed(state, int(codes[row]))
            at = row + 1
        out[at:] = state
        place = frame.schema.get_field_index("code")
        yield frame.set_column(place, "code", pa.array(out))


def _running_codes(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with `code` composed up to each row, exclusive, within `keys`."""
    parts = shuffle_partitions(rows.sparkSession)
    sorted_rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(lambda frames: _running(frames, keys), rows.schema)


def _digit(code: Column, state: Column) -> Column:
    power = F.element_at(F.array(*[F.lit(STATES**s) for s in range(STATES)]), state + 1)
    return F.call_function("div", code, power).cast("int") % STATES


def _summed(text: Column) -> Column:
    """For each state of entry what a piece does: state of exit, change of depth, whether it closes a bracket."""

    def told(bare: Column, entered: Column) -> Column:
        opened = F.length(bare) - F.length(F.replace(bare, F.lit("("), F.lit("")))
        closed = F.length(bare) - F.length(F.replace(bare, F.lit(")"), F.lit("")))
        return F.struct(
            F.when(bare.isNull(), entered).otherwise(leaves(bare)).cast("int").alias("exit"),
            F.coalesce(opened - closed, F.lit(0)).alias("delta"),
            F.coalesce(closed > 0, F.lit(False)).alias("closes"),
        )

    # Bare texts are bound first, as each is looked at several times.
    bare = F.array(*[bare_text(text, s) for s in range(STATES)])
    return F.transform(bare, told)


def _offsets(rows: DataFrame, amount: str) -> DataFrame:
    """For each chunk of a statement the sum of `amount` over the chunks before."""
    earlier = Window.partitionBy(*POSITION).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*_CHUNK).agg(F.sum(amount).alias("amount"))
    return sums.select(*_CHUNK, F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("before"))


def _grouped(pieces: DataFrame) -> DataFrame:
    """`(script_idx, seq, group_no, text, ends_plain)`: pieces put together up to where a bracket closes at depth zero."""
    steps = pieces.select(*_CHUNK, *_ORDER, _summed(F.col("text")).alias("steps"))
    code = sum((F.col("steps")[s]["exit"] * STATES**s for s in range(1, STATES)), F.col("steps")[0]["exit"]).cast("int")
    steps = stage(steps.withColumn("code", code), "steps")
    running = _running_codes(steps.select(*_CHUNK, *_ORDER, "code"), _CHUNK, _ORDER).withColumnRenamed("code", "before")
    narrow = checkpoint(running.join(steps, [*_CHUNK, *_ORDER]))
    # One row per chunk and statement: what the whole chunk does.
    after = [_digit(F.col("code"), _digit(F.col("before"), F.lit(s))) * STATES**s for s in range(STATES)]
    whole = sum(after[1:], after[0]).cast("int")
    chunks = narrow.groupBy(*_CHUNK).agg(F.max_by(whole, F.struct(*_ORDER)).alias("code"))
    entries = _running_codes(chunks, POSITION, ["chunk"]).select(*_CHUNK, _digit(F.col("code"), F.lit(0)).alias("entry"))
    step = F.element_at("steps", _digit(F.col("before"), F.col("entry")) + 1)
    known = checkpoint(narrow.join(entries, _CHUNK).select(*_CHUNK, *_ORDER, step.alias("step")).select(*_CHUNK, *_ORDER, "step.*"))
    up_to = Window.partitionBy(*_CHUNK).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum("delta").over(up_to) + F.col("before")
    deep = known.join(_offsets(known, "delta"), _CHUNK).withColumn("depth", depth)
    ends = (F.col("exit") == 0) & (F.col("depth") == 0) & F.col("closes")
    cut = checkpoint(deep.select(*_CHUNK, *_ORDER, "exit", "depth", ends.cast("long").alias("ends")))
    group_no = F.sum("ends").over(up_to) - F.col("ends") + F.col("before")
    numbered = cut.join(_offsets(cut, "ends"), _CHUNK).withColumn("group_no", group_no)
    place = [*_CHUNK, *_ORDER]
    texts = pieces.join(numbered.select(*place, "group_no", ((F.col("exit") == 0) & (F.col("depth") == 0)).alias("plain")), place)
    return texts.groupBy(*POSITION, "group_no").agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY chunk, line_no, pos, part)").alias("text"),
        F.max_by("plain", F.struct("chunk", *_ORDER)).alias("ends_plain"),
    )


def _heads(pieces: DataFrame) -> DataFrame:
    """`(script_idx, seq, kind, table_name, column_names, head)` from the beginning of each statement."""
    starts = pieces.groupBy(*POSITION).agg(F.min("chunk").alias("chunk"))
    size = F.sum(F.length("text")).over(Window.partitionBy(*_CHUNK).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    early = pieces.join(starts, _CHUNK).withColumn("reached", F.coalesce(size, F.lit(0)))
    lead = early.where(F.col("reached") < HEAD_CHARS).groupBy(*POSITION).agg(
        F.expr("listagg(text, '') WITHIN GROUP (ORDER BY line_no, pos, part)").alias("lead")
    )
    lead = lead.withColumn("lead", F.left("lead", F.lit(2 * HEAD_CHARS)))
    kind = F.when(statement_kind(F.col("lead"), F.lit(False)) == "other", "other").otherwise("insert")
    return lead.select(
        *POSITION,
        kind.alias("kind"),
        F.when(kind == "insert", insert_table(F.col("lead"))).alias("table_name"),
        F.when(kind == "insert", insert_columns(F.col("lead"))).alias("column_names"),
        F.when(kind == "insert", insert_mode(F.col("lead"))).alias("mode"),
        F.when(kind == "insert", insert_head(F.col("lead"))).alias("head"),
    )


def parse_long(segmentation: Segmentation, fragments: DataFrame | None = None) -> DataFrame:
    """Rows like those of `parse`, of the statements that `statements()` gives without text.

    An INSERT is sound if all its groups are tuples and commas alone, with one comma from each
    group to the next, and it ends in plain text; else it is one row of kind `syntax`.
    """
    pieces = stage(statement_pieces(segmentation, fragments), "pieces")
    heads = checkpoint(_heads(pieces))
    inserts = heads.where("kind = 'insert'")
    groups = _grouped(pieces.join(_few(inserts.select(*POSITION)), POSITION, "left_semi"))
    groups = groups.join(_few(inserts.select(*POSITION, "head")), POSITION)
    is_first = F.col("group_no") == 0
    body = F.when(is_first, F.col("text").substr(F.length("head") + 1, F.length("text"))).otherwise(F.col("text"))
    groups = groups.withColumn("body", body)
    groups = groups.withColumns(
        {
            "before": F.regexp_extract("body", GROUP_OF_TUPLES, 1) != "",
            "after": F.regexp_extract("body", GROUP_OF_TUPLES, 3) != "",
            "some": F.regexp_extract("body", GROUP_OF_TUPLES, 2) != "",
            "fits": F.col("body").rlike(GROUP_OF_TUPLES),
            "tuples": tuples_of(F.col("body")),
        }
    )
    groups = stage(groups.select(*POSITION, "group_no", "ends_plain", "before", "after", "some", "fits", "tuples"), "groups")
    # A comma stands between groups of tuples, so those before and after a border are one in all.
    behind = groups.select(*POSITION, (F.col("group_no") + 1).alias("group_no"), F.col("after").alias("comma"), F.col("some").alias("tuples_before"))
    bordered = groups.select(*POSITION, "group_no", "before", "after", "some", "fits", "ends_plain").join(behind, [*POSITION, "group_no"], "left")
    one = F.coalesce("comma", F.lit(False)).cast("int") + F.col("before").cast("int")
    wanted = (F.col("some") & F.coalesce("tuples_before", F.lit(False))).cast("int")
    last = F.struct("group_no", "ends_plain", "after")
    judged = bordered.groupBy(*POSITION).agg(
        F.min(F.col("fits") & (one == wanted)).alias("sound"), F.max("some").alias("some"), F.max(last).alias("last")
    )
    good = F.col("sound") & F.col("some") & F.col("last.ends_plain") & ~F.col("last.after")
    verdicts = heads.join(judged.select(*POSITION, good.alias("good")), POSITION, "left")
    kind = F.when(F.col("kind") == "other", "other").when(F.coalesce("good", F.lit(False)), "insert").otherwise("syntax")
    verdicts = checkpoint(verdicts.select(*POSITION, kind.alias("kind"), "table_name", "column_names", "mode"))
    # A clause for rows that are there makes a long statement one of kind `syntax`.
    verdicts = verdicts.withColumn("updates", F.lit(None).cast(UPDATES))
    rows = groups.select(*POSITION, "group_no", F.posexplode("tuples").alias("at", "row"))
    rows = rows.join(_few(verdicts.where("kind = 'insert'")), POSITION)
    number = F.col("group_no") * GROUP_ROWS + F.col("at")
    parsed = rows.select(
        *(*POSITION, *STATEMENT_COLUMNS),
        number.alias("row_no"),
        F.explode(F.array(tuple_values(F.col("row")))).alias("values"),
    )
    none = verdicts.where("kind <> 'insert'").select(
        *POSITION, *STATEMENT_COLUMNS, F.lit(None).cast("long").alias("row_no"), F.lit(None).cast(parsed.schema["values"].dataType).alias("values")
    )
    return parsed.unionByName(none)


def parse_all(segmentation: Segmentation, fragments: DataFrame | None = None, statements: DataFrame | None = None) -> DataFrame:
    """Rows of all statements, of any length."""
    statements = segmentation.statements() if statements is None else statements
    rows = parse(statements.where("not too_long")).withColumn("row_no", F.col("row_no").cast("long"))
    if not segmentation.any_long:
        return rows
    return rows.unionByName(parse_long(segmentation, fragments))

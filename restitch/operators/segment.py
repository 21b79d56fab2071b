"""Script lines -> statements, as prefix scans over chunks.

Reading a script line by line carries three things along: whether a block comment is
open, how deep BEGIN/END blocks are nested, and the delimiter in force. Few lines
change any of them. Each has a summary per chunk that does not depend on the text
before the chunk:

* comment: where the chunk leaves the reader, once for "closed at entry" and once for
  "open at entry";
* depth: the total of the steps and the lowest prefix sum (depth never falls below
  zero, so a chunk maps depth E to max(E + total, total - lowest));
* delimiter: the last directive, and the entry depth up to which it is at depth zero.

So the work is: (1) one narrow pass that classifies lines; (2) windows over the lines
of a chunk that change the state; (3) windows over one row per chunk of a script;
(4) one pass that carries the resolved state onto the text. No window ever spans the
lines of a whole script.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from restitch.functions.text import (
    DEFAULT_DELIMITER,
    after_comment,
    block_step,
    directive_token,
    ends_with_terminator,
    has_close,
    outside_comment,
    unicode_trim,
    utf16_length,
)
from restitch.operators.delimiters import SHORTEST_DIRECTIVE, accepted_directives
from restitch.session import checkpoint, checkpoint_partitioned, shuffle_partitions

_CHUNK = ["script_idx", "chunk"]

# Rows of the table of cut chunks (one per file split at most) that may be sent to
# every executor; it is counted first, and joined by shuffle beyond this.
BROADCAST_CHUNKS = 500_000

# Longer statements are not put together in one place. Far below what one value may hold.
MAX_STATEMENT_CHARS = 1 << 24

_BEFORE_ALL_LINES = -(1 << 63)


def _before(*partition: str, order: str = "pos"):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _up_to(*partition: str, order: str = "pos"):
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _odd(count: Column) -> Column:
    return F.pmod(count, F.lit(2)) == 1


def _sum(column: str | Column, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0)).cast("long")


def _lowest(column: str, window) -> Column:
    return F.least(F.lit(0), F.coalesce(F.min(column).over(window), F.lit(0)))


def _comment_scan(rows: DataFrame, swaps: Column, settles: Column, settled: str, before) -> DataFrame:
    """Comment state before each row: `open_0` / `open_1` for a closed / open start.

    A row either settles the state, swaps it, or leaves it alone. The state is that of
    the last settling row (or the start), swapped once per swapping row since.
    """
    scanned = rows.withColumn("swaps", _sum(swaps.cast("int"), before)).withColumn(
        "anchor",
        F.last(
            F.when(settles, F.struct(F.col(settled).alias("open"), F.col("swaps").alias("swaps"))),
            ignorenulls=True,
        ).over(before),
    )
    since_anchor = F.col("anchor.open") != _odd(F.col("swaps") - F.col("anchor.swaps"))
    return (
        scanned.withColumn("open_0", F.coalesce(since_anchor, _odd(F.col("swaps"))))
        .withColumn("open_1", F.coalesce(since_anchor, ~_odd(F.col("swaps"))))
        .drop("swaps", "anchor")
    )


def classify(lines: DataFrame, keep_versioned: bool) -> DataFrame:
    """Everything about a line that does not depend on other lines.

    Lines may bring their number of characters in `chars`, and in `whole` whether `line` is all of
    the line or a stand-in that does what the line does.
    """
    line = F.col("line")
    chars = F.col("chars") if "chars" in lines.columns else utf16_length(line)
    whole = F.col("whole") if "whole" in lines.columns else F.lit(True)
    text, opens = outside_comment(line, F.col("rest"), keep_versioned)
    return (
        lines.select(
            *(*_CHUNK, "pos", "line"),
            chars.alias("chars"),
            whole.alias("whole"),
            has_close(line).alias("closes"),
            after_comment(line, keep_versioned).alias("rest"),
        )
        .withColumns({"text": text, "opens": opens})
        .drop("rest")
        .withColumn("step", block_step(F.col("text")))
        .withColumn("token", directive_token(F.col("text")))
        .withColumn("terminator", ends_with_terminator(F.col("text")))
        # Lines that may change the state carried along; all others only read it.
        .withColumn(
            "changes",
            F.col("opens") | F.col("closes") | (F.col("step") != 0) | F.col("token").isNotNull(),
        )
    )


class Segmentation:
    """The statements of a set of scripts, and the states they are cut by.

    `lines` has `(script_idx, chunk, pos, line)`; reading it twice must give the same
    positions. The narrow line marks and two tables with a row per chunk are
    checkpointed when first needed.

    A statement that reads more than `max_statement_chars` keeps its row, with NULL text and
    `too_long` set, however its lines lie in chunks; so does one with a line that is not whole. Lines stay in
    `statement_lines()`, and the rows of such an INSERT come from its pieces (`long_inserts`).
    """

    def __init__(
        self, lines: DataFrame, keep_versioned: bool = False, max_statement_chars: int = MAX_STATEMENT_CHARS
    ) -> None:
        self.lines = lines
        self.keep_versioned = keep_versioned
        self.max_statement_chars = max_statement_chars
        self._partitions = shuffle_partitions(lines.sparkSession)

    # ---- lines that change the state ------------------------------------------

    @cached_property
    def marks(self) -> DataFrame:
        """Line marks without the text, partitioned and sorted by chunk."""
        directive = F.col("token").isNotNull()
        narrow = classify(self.lines, self.keep_versioned).select(
            *_CHUNK,
            "pos",
            "opens",
            "closes",
            "step",
            "token",
            F.when(directive, utf16_length(F.col("token"))).alias("token_len"),
            F.when(directive, utf16_length(unicode_trim(F.col("text")))).alias("line_len"),
            "terminator",
            (F.col("text") != "").alias("has_text"),
            "changes",
            "chars",
            "whole",
        )
        placed = narrow.repartition(self._partitions, *_CHUNK).sortWithinPartitions(*_CHUNK, "pos")
        return checkpoint_partitioned(placed)

    @cached_property
    def _changes(self) -> DataFrame:
        """Changing lines with comment state and depth, for either comment state at chunk entry."""
        before, up_to = _before(*_CHUNK), _up_to(*_CHUNK)
        opens, closes = F.col("opens"), F.col("closes")
        scanned = _comment_scan(self.marks.where("changes"), opens & closes, opens != closes, "opens", before)
        scanned = scanned.withColumns(
            {f"step_{e}": F.when(F.col(f"open_{e}"), 0).otherwise(F.col("step")) for e in "01"}
        ).withColumns({f"sum_{e}": F.sum(f"step_{e}").over(up_to).cast("long") for e in "01"})
        return scanned.withColumns(
            {f"low_{e}": _lowest(f"sum_{e}", up_to) for e in "01"}
            | {f"low_before_{e}": _lowest(f"sum_{e}", before) for e in "01"}
        )

    @cached_property
    def _entries(self) -> DataFrame:
        """State at the start of every chunk, with directives of up to nine characters."""
        summary = [F.max("token_len").alias("token_len")]
        for e in "01":
            leaves = F.when(F.col(f"open_{e}"), ~F.col("closes")).otherwise(F.col("opens"))
            directive = F.struct("token", (-F.col(f"low_{e}")).alias("up_to"))
            at_zero = (
                F.col("token").isNotNull()
                & ~F.col(f"open_{e}")
                & (F.col("step") == 0)
                & (F.col(f"sum_{e}") == F.col(f"low_{e}"))
            )
            summary += [
                F.max_by(leaves, "pos").alias(f"leaves_{e}"),
                F.sum(f"step_{e}").alias(f"total_{e}"),
                F.min(f"low_{e}").alias(f"lowest_{e}"),
                F.max_by(directive, F.when(at_zero, F.col("pos"))).alias(f"directive_{e}"),
            ]
        chunks = self.marks.groupBy(*_CHUNK).agg(F.count("*").alias("n_lines"))
        chunks = chunks.join(self._changes.groupBy(*_CHUNK).agg(*summary), _CHUNK, "left").withColumns(
            {
                "leaves_0": F.coalesce("leaves_0", F.lit(False)),
                "leaves_1": F.coalesce("leaves_1", F.lit(True)),
            }
        )

        before = _before("script_idx", order="chunk")
        swaps = F.col("leaves_0") & ~F.col("leaves_1")
        chunks = _comment_scan(chunks, swaps, F.col("leaves_0") == F.col("leaves_1"), "leaves_0", before)

        def chosen(name: str, default: Column | None = None) -> Column:
            value = F.when(F.col("open_0"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
            return (value if default is None else F.coalesce(value, default)).alias(name)

        chunks = (
            chunks.select(
                *_CHUNK,
                "token_len",
                F.col("open_0").alias("entry_open"),
                chosen("total", F.lit(0)),
                chosen("lowest", F.lit(0)),
                chosen("directive"),
            )
            .withColumn("sum_before", _sum("total", before))
            .withColumn("reach", F.col("sum_before") + F.col("lowest"))
            .withColumn("entry_depth", F.col("sum_before") - _lowest("reach", before))
        )
        in_force = F.when(F.col("entry_depth") <= F.col("directive.up_to"), F.col("directive.token"))
        chunks = chunks.withColumn("set_token", in_force).withColumn("entry_delimiter", self._token_before())
        return checkpoint(chunks.select(*_CHUNK, "token_len", "entry_open", "entry_depth", "entry_delimiter"))

    @staticmethod
    def _token_before() -> Column:
        """Delimiter in force at the start of a chunk, from the `set_token` of the chunks before."""
        set_before = F.last("set_token", ignorenulls=True).over(_before("script_idx", order="chunk"))
        return F.coalesce(set_before, F.lit(DEFAULT_DELIMITER))

    def _resolved_changes(self) -> DataFrame:
        """Changing lines, given the comment state and depth their chunk starts with."""

        def chosen(name: str) -> Column:
            value = F.when(F.col("entry_open"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))
            return value.alias(name)

        resolved = self._changes.join(self._entries.drop("token_len"), _CHUNK).select(
            *(*_CHUNK, "pos", "opens", "closes", "token", "token_len", "line_len", "terminator", "has_text"),
            *("entry_depth", "entry_delimiter"),
            F.col("step").alias("line_step"),
            *(chosen(name) for name in ("open", "step", "sum", "low", "low_before")),
        )
        before = F.col("sum") - F.col("step")
        return (
            resolved.withColumn("depth", F.greatest(F.col("entry_depth") + F.col("sum"), F.col("sum") - F.col("low")))
            .withColumn("depth_before", F.greatest(F.col("entry_depth") + before, before - F.col("low_before")))
            .withColumn("kept", ~F.col("open") & F.col("has_text"))
            .withColumn("open_after", F.when(F.col("open"), ~F.col("closes")).otherwise(F.col("opens")))
            .withColumn("free", F.col("kept") & (F.col("line_step") == 0) & (F.col("depth") == 0))
        )

    @cached_property
    def _long_delimiters(self) -> bool:
        longest = self._entries.agg(F.max("token_len")).first()[0]
        return longest is not None and longest > SHORTEST_DIRECTIVE

    @cached_property
    def _accepted(self) -> DataFrame:
        """Directives that take effect, worked out once; only if there are long delimiters."""
        directives = self._resolved_changes().where(F.col("free") & F.col("token").isNotNull())
        return checkpoint(
            accepted_directives(directives.select(*_CHUNK, "pos", "token", "token_len", "line_len"))
        )

    @cached_property
    def _starts(self) -> DataFrame:
        """State at the start of every chunk, placed like the marks."""
        entries = self._entries
        if self._long_delimiters:
            last = self._accepted.groupBy(*_CHUNK).agg(F.max_by("accepted_token", "pos").alias("set_token"))
            entries = entries.join(last, _CHUNK, "left").withColumn("entry_delimiter", self._token_before())
        return entries.select(*_CHUNK, "entry_open", "entry_depth", "entry_delimiter")

    @cached_property
    def _change_states(self) -> DataFrame:
        """State before and after every changing line."""
        resolved = self._resolved_changes()
        if self._long_delimiters:
            resolved = (
                resolved.drop("entry_delimiter")
                .join(self._starts.select(*_CHUNK, "entry_delimiter"), _CHUNK)
                .join(self._accepted, [*_CHUNK, "pos"], "left")
                .withColumn("set_token", F.col("accepted_token"))
            )
        else:
            resolved = resolved.withColumn("set_token", F.when(F.col("free"), F.col("token")))
        in_force = F.last("set_token", ignorenulls=True).over(_up_to(*_CHUNK))
        ends_block = F.col("kept") & (F.col("line_step") == -1) & (F.col("depth") == 0)
        ends_line = F.col("free") & (F.col("delimiter") == DEFAULT_DELIMITER) & F.col("terminator")
        return resolved.withColumn("delimiter", F.coalesce(in_force, F.col("entry_delimiter"))).select(
            *_CHUNK,
            "pos",
            F.col("open").alias("open_before"),
            F.col("open_after").alias("open"),
            "depth_before",
            "depth",
            "delimiter",
            "kept",
            (ends_block | ends_line).alias("ends"),
            (F.col("kept") & (F.col("line_step") == -1) & (F.col("depth_before") == 0)).alias("warned"),
        )

    # ---- carrying the state onto all lines -------------------------------------

    @staticmethod
    def _ready() -> Column:
        """Whether a terminator at a line end counts in this state."""
        return ~F.col("open") & (F.col("depth") == 0) & (F.col("delimiter") == DEFAULT_DELIMITER)

    def _carry(self, rows: DataFrame, changes: DataFrame, starts: DataFrame, group: str, extra: list[str]) -> DataFrame:
        """Give every row of `rows` the state left by the last marker at or before it.

        Markers are the changing lines, and one start per group that also brings the
        counters `ends_so_far` and `chars_done` (within the script) to begin with.
        `extra` names further state columns to carry.
        """
        fields = ["open", "ready", "kept", "ends", *extra]

        def marker(frame: DataFrame, pos: Column, ends: Column, chars: Column) -> DataFrame:
            return frame.select(
                "script_idx",
                group,
                *([] if group == "chunk" else ["chunk"]),
                pos.cast("long").alias("pos"),
                F.lit(False).alias("is_line"),
                F.struct("chunk", pos.cast("long").alias("pos"), *fields).alias("state"),
                ends.cast("long").alias("count_ends"),
                chars.cast("long").alias("count_chars"),
            )

        zero = F.lit(0).cast("long")
        first = F.lit(_BEFORE_ALL_LINES)
        starts = starts.withColumns({"kept": F.lit(False), "ends": F.lit(False)})
        markers = marker(changes.withColumn("ready", self._ready()), F.col("pos"), zero, zero).unionByName(
            marker(starts, first, F.col("first_ends"), F.col("first_chars"))
        )
        together = rows.withColumns({"is_line": F.lit(True), "count_chars": F.col("chars")}).unionByName(
            markers, allowMissingColumns=True
        )

        order = ["pos", "is_line"] if group == "chunk" else ["chunk", "pos", "is_line"]
        ordered = Window.partitionBy("script_idx", group).orderBy(*order)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = (F.col("state.chunk") == F.col("chunk")) & (F.col("state.pos") == F.col("pos"))
        lost = F.raise_error(F.lit("line positions differ between two reads of one script")).cast("boolean")
        carried = together.withColumn("state", F.last("state", ignorenulls=True).over(up_to))
        carried = (
            carried.withColumn("own", own)
            .withColumn(
                "kept",
                F.when(F.col("state").isNull(), lost)
                .when(F.col("own"), F.col("state.kept"))
                .when(F.col("changes"), lost)
                .otherwise(~F.col("state.open") & F.col("has_text")),
            )
            .withColumn(
                "ends",
                F.when(F.col("own"), F.col("state.ends")).otherwise(F.col("state.ready") & F.col("terminator")),
            )
            .withColumn(
                "count_ends",
                F.when(F.col("is_line"), F.col("ends").cast("long")).otherwise(F.col("count_ends")),
            )
        )
        return (
            carried.withColumns(
                {"ends_so_far": _sum("count_ends", before), "chars_done": F.sum("count_chars").over(up_to)}
            )
            .where("is_line")
            .drop("is_line", "count_ends", "count_chars")
        )

    def _carry_marks(self, starts: DataFrame, extra: list[str]) -> DataFrame:
        rows = self.marks.select(*_CHUNK, "pos", "terminator", "has_text", "changes", "chars", "whole")
        starts = starts.withColumn("ready", self._ready())
        placed = starts.repartition(self._partitions, *_CHUNK)
        return self._carry(rows, self._change_states, placed, "chunk", extra)

    @cached_property
    def chunks(self) -> DataFrame:
        """One row per chunk: state and counters at its start, and where its statements are cut.

        A chunk whose predecessor stops inside a statement gives its first lines, up to
        the end of that statement, to the chunk where the statement starts (`home`).
        """
        starts = self._starts.select(
            *_CHUNK,
            F.col("entry_open").alias("open"),
            F.col("entry_depth").alias("depth"),
            F.col("entry_delimiter").alias("delimiter"),
            F.lit(0).alias("first_ends"),
            F.lit(0).alias("first_chars"),
        )
        pieces = (
            self._carry_marks(starts, [])
            .groupBy(*_CHUNK, "ends_so_far")
            .agg(
                F.sum("chars").alias("chars"),
                F.coalesce(F.min(F.when(F.col("kept"), F.col("whole"))), F.lit(True)).alias("whole"),
                F.sum(F.col("kept").cast("long")).alias("kept"),
                F.max("ends").alias("ends"),
                F.max("pos").alias("pos"),
                F.max(F.when(F.col("ends"), F.col("state.open"))).alias("open_at_end"),
                F.max(F.when(F.col("ends"), F.col("state.ready"))).alias("ready_at_end"),
            )
        )
        piece = F.struct("chars", "kept", "ends", "pos", "open_at_end", "ready_at_end")
        chunks = (
            pieces.groupBy(*_CHUNK)
            .agg(
                F.sum(F.col("ends").cast("long")).alias("n_ends"),
                F.sum("chars").alias("chars"),
                F.sum("kept").alias("kept"),
                F.max("chars").alias("longest"),
                F.min("whole").alias("whole"),
                F.min_by(piece, "ends_so_far").alias("head"),
                F.max_by(piece, "ends_so_far").alias("tail"),
            )
            .join(self._starts, _CHUNK)
        )

        in_order = Window.partitionBy("script_idx").orderBy("chunk")
        in_home = Window.partitionBy("script_idx", "home")
        before = _before("script_idx", order="chunk")
        owner = F.when(F.col("owns"), F.struct("chunk", "start_chars", "start_kept"))
        head_done = F.when(F.col("moved"), F.col("chars_before") + F.col("head.chars"))
        head_kept = F.when(F.col("moved"), F.col("kept_before") + F.col("head.kept"))
        chunks = (
            chunks.withColumn("moved", F.coalesce(~F.lag("tail.ends").over(in_order), F.lit(False)))
            .withColumn("owns", ~F.col("moved") | (F.col("n_ends") > 0))
            .withColumn("ends_before", _sum("n_ends", before))
            .withColumn("chars_before", _sum("chars", before))
            .withColumn("kept_before", _sum("kept", before))
            .withColumn("start_chars", F.col("chars_before") + F.col("chars") - F.col("tail.chars"))
            .withColumn("start_kept", F.col("kept_before") + F.col("kept") - F.col("tail.kept"))
            .withColumn("owner", F.last(owner, ignorenulls=True).over(before))
            .withColumn("home", F.when(F.col("moved"), F.col("owner.chunk")).otherwise(F.col("chunk")))
            .withColumn("statement_done", F.max(head_done).over(in_home))
            .withColumn("statement_chars", F.col("statement_done") - F.col("owner.start_chars"))
            .withColumn("statement_kept", F.max(head_kept).over(in_home) - F.col("owner.start_kept"))
            .withColumn("too_long", F.col("moved") & (F.col("statement_chars") > self.max_statement_chars))
        )
        return checkpoint(
            chunks.select(
                *(*_CHUNK, "entry_open", "entry_depth", "entry_delimiter", "n_ends", "head", "moved", "home"),
                *("ends_before", "chars_before"),
                *("statement_done", "statement_chars", "statement_kept", "too_long", "longest", "whole"),
            )
        )

    @cached_property
    def _moves(self) -> tuple[int, int]:
        """How many chunks give lines away, and how many of these to a too long statement."""
        row = self._sizes
        return row["moved"], row["too_long"]

    @cached_property
    def _sizes(self) -> Row:
        longest = F.greatest("longest", F.coalesce("statement_chars", F.lit(0)))
        return self.chunks.agg(
            F.count(F.when(F.col("moved"), 1)).alias("moved"),
            F.count(F.when(F.col("too_long"), 1)).alias("too_long"),
            F.max((longest > self.max_statement_chars) | ~F.col("whole")).alias("any_long"),
        ).first()

    @property
    def any_long(self) -> bool:
        """Whether there may be statements that `statements()` gives without text."""
        return bool(self._sizes["any_long"])

    def _chunk_starts(self) -> DataFrame:
        """Start markers of whole chunks, with the script's counters before them."""
        return self.chunks.select(
            *_CHUNK,
            F.col("entry_open").alias("open"),
            F.col("entry_depth").alias("depth"),
            F.col("entry_delimiter").alias("delimiter"),
            F.col("ends_before").alias("first_ends"),
            F.col("chars_before").alias("first_chars"),
        )

    # ---- results without text ---------------------------------------------------

    def states(self) -> DataFrame:
        """State before and after each line, from the narrow marks alone."""
        extra = ["depth", "delimiter", "open_before", "depth_before", "warned"]
        starts = self._chunk_starts().withColumns(
            {"open_before": F.col("open"), "depth_before": F.col("depth"), "warned": F.lit(False)}
        )
        return self._carry_marks(starts, extra).select(
            *_CHUNK,
            "pos",
            (F.col("ends_so_far") + 1).alias("seq"),
            F.when(F.col("own"), F.col("state.open_before")).otherwise(F.col("state.open")).alias("open_before"),
            F.col("state.open").alias("open_after"),
            "kept",
            F.when(F.col("own"), F.col("state.depth_before")).otherwise(F.col("state.depth")).alias("depth_before"),
            F.col("state.depth").alias("depth_after"),
            F.col("state.delimiter").alias("delimiter"),
            "ends",
            (F.col("own") & F.col("state.warned")).alias("warned"),
            "chars",
            "chars_done",
        )

    def warnings(self) -> DataFrame:
        """END lines met at depth zero: depth stays at zero and a statement ends there."""
        return self.states().where("warned").select(*_CHUNK, "pos", "seq")

    def bounds(self) -> DataFrame:
        """First and last kept line of every statement, without reading the text again."""
        place = F.when(F.col("kept"), F.struct("chunk", "pos"))
        return (
            self._carry_marks(self._chunk_starts(), [])
            .groupBy("script_idx", (F.col("ends_so_far") + 1).alias("seq"))
            .agg(
                F.min(place).alias("first"),
                F.max(place).alias("last"),
                F.count(place).alias("kept_lines"),
                F.max("ends").alias("terminated"),
                F.sum("chars").alias("chars_read"),
                F.max("chars_done").alias("chars_done"),
                F.coalesce(F.min(F.when(F.col("kept"), F.col("whole"))), F.lit(True)).alias("whole"),
            )
            .where("kept_lines > 0")
        )

    def long_statements(self) -> DataFrame:
        """Statements that `statements()` gives without text."""
        return self.bounds().where((F.col("chars_read") > self.max_statement_chars) | ~F.col("whole"))

    # ---- text pass -----------------------------------------------------------------

    def _classified_text(self) -> DataFrame:
        return classify(self.lines, self.keep_versioned).select(
            *_CHUNK, "pos", "text", "terminator", "changes", "chars", "whole", (F.col("text") != "").alias("has_text")
        )

    def _to_home(self, rows: DataFrame) -> DataFrame:
        """Name the chunk whose group each line belongs to, so that no statement is split.

        Lines of too long statements go nowhere; a single group could not hold them.
        """
        moved, too_long = self._moves
        if not moved:
            return rows.withColumn("home", F.col("chunk"))
        moves = self.chunks.where("moved").select(
            *_CHUNK,
            F.col("home").alias("head_home"),
            F.when(F.col("n_ends") > 0, F.col("head.pos")).alias("head_end"),
            "too_long",
        )
        if moved <= BROADCAST_CHUNKS:
            moves = F.broadcast(moves)
        in_head = F.col("head_home").isNotNull() & (
            F.col("head_end").isNull() | (F.col("pos") <= F.col("head_end"))
        )
        routed = rows.join(moves, _CHUNK, "left")
        if too_long:
            routed = routed.where(~(in_head & F.col("too_long")))
        home = F.when(in_head, F.col("head_home")).otherwise(F.col("chunk"))
        return routed.withColumn("home", home).drop("head_home", "head_end", "too_long")

    def _home_starts(self) -> DataFrame:
        """Start markers of the groups `_to_home` makes.

        A chunk that gave its head away starts right behind the end of that statement.
        """
        cut = F.col("moved")
        ready = ~F.col("entry_open") & (F.col("entry_depth") == 0) & (F.col("entry_delimiter") == DEFAULT_DELIMITER)
        return self.chunks.where(~cut | (F.col("n_ends") > 0)).select(
            *_CHUNK,
            F.col("chunk").alias("home"),
            F.when(cut, F.col("head.open_at_end")).otherwise(F.col("entry_open")).alias("open"),
            F.when(cut, F.col("head.ready_at_end")).otherwise(ready).alias("ready"),
            (F.col("ends_before") + cut.cast("long")).alias("first_ends"),
            (F.col("chars_before") + F.when(cut, F.col("head.chars")).otherwise(0)).alias("first_chars"),
        )

    def statement_lines(self) -> DataFrame:
        """Kept lines in script order with their statement: the whole text of any statement."""
        starts = self._chunk_starts().withColumn("ready", self._ready())
        return (
            self._carry(self._classified_text(), self._change_states, starts, "chunk", [])
            .where("kept")
            .select("script_idx", (F.col("ends_so_far") + 1).alias("seq"), "chunk", "pos", "text", "whole")
        )

    def statements(self) -> DataFrame:
        """Statements: kept lines joined by a newline, the terminator left in.

        `chars_read` counts every line since the statement before, dropped ones too;
        `chars_done` is the running count within the script.
        """
        numbered = self._carry(
            self._to_home(self._classified_text()),
            self._to_home(self._change_states),
            self._home_starts(),
            "home",
            [],
        )
        # Within a home a statement may still be long: then its lines are not joined.
        same = Window.partitionBy("script_idx", "home", "ends_so_far")
        sized, fits = numbered, F.lit(True)
        if self.any_long:
            kept_whole = F.min(F.when(F.col("kept"), F.col("whole"))).over(same)
            sized = sized.withColumn("read", F.sum("chars").over(same)).withColumn("all_whole", kept_whole)
            fits = (F.col("read") <= self.max_statement_chars) & F.coalesce("all_whole", F.lit(True))
        joined = (
            sized.withColumn("text", F.when(F.col("kept") & fits, F.col("text")))
            .groupBy("script_idx", "home", (F.col("ends_so_far") + 1).alias("seq"))
            .agg(
                F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY chunk, pos)").alias("text"),
                F.max("ends").alias("terminated"),
                F.sum("chars").alias("chars_read"),
                F.max("chars_done").alias("chars_done"),
                F.max(~fits).alias("too_long"),
                F.max("kept").alias("kept"),
            )
            .where("kept")
            .drop("home", "kept")
        )
        if not self._moves[1]:
            return joined
        too_long = (
            self.chunks.where("too_long")
            .groupBy("script_idx", (F.col("ends_before") + 1).alias("seq"))
            .agg(
                F.lit(None).cast("string").alias("text"),
                F.max(F.col("n_ends") > 0).alias("terminated"),
                F.max("statement_chars").alias("chars_read"),
                F.max("statement_done").alias("chars_done"),
                F.lit(True).alias("too_long"),
                F.max("statement_kept").alias("kept"),
            )
        )
        return joined.join(too_long, ["script_idx", "seq"], "left_anti").unionByName(
            too_long.where("kept > 0").drop("kept")
        )

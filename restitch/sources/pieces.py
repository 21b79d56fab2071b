"""Scripts with lines of any length: text is read in pieces, and a line is put together from what matters of it.

Dumps write whole tables on one line. A reader of lines needs such a line in one place; here scripts
are read in pieces that end with `),`, the end of a tuple in an INSERT, so a line may
run over any number of file splits, and no task holds more than its split and one piece. Pieces are cut at
line breaks into fragments, fragments are numbered by line, and the lines that segmentation looks at are

* the text itself up to `LONG_LINE` characters;
* for longer lines a stand-in: beginning, end, and the comment marks that decide what
  the line does. It has the line's number of characters and is marked as not `whole`.

What a stand-in leaves out is never looked at: a line is judged by how it begins, how it ends, and what
follows its last `*/`. (A line of more than `LONG_LINE` characters that is white space but for
BEGIN, END or DELIMITER counts as text.) Its fragments remain in the table of fragments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restitch.functions.text import COMMENT_CLOSE, COMMENT_OPEN, VERSIONED_OPEN, utf16_length
from restitch.session import pin_file_splits, stage
from restitch.sources.encodings import encoding_of
from restitch.sources.names import read_key
from restitch.sources.scripts import ANY_BREAK, PACKED, script_list, to_read

PIECE_END = "),"
LONG_LINE = 1 << 16
# Characters of the beginning and of the end of a long line that a stand-in keeps.
KEPT = 256
# Stands for what is left out; not white space, and not a mark of the format.
LEFT_OUT = "\x01"
_BOM = 3

_LINE = ["script_idx", "line_no"]


def scan_fragments(spark: SparkSession, paths: Sequence[str], first: int = 0) -> DataFrame:
    """`(script_idx, chunk, pos, part, line_no, text)`, staged once in the shared folder.

    Fragments of a script are in order of `(chunk, pos, part)`; one that doesn't end its line
    ends with `),`.
    """
    listed, known = script_list(spark, paths, first)
    for path, uri in known.items():
        if uri.endswith(PACKED) or encoding_of(spark, uri):
            raise ValueError(f"lines of any length are read from plain UTF-8 files only: {path!r}")
    pin_file_splits(spark)
    pieces = spark.read.option("lineSep", PIECE_END).text(to_read(known)).select(
        read_key().alias("file_key"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )
    # Whether the last piece of a file was closed by the mark shows in the number of bytes only.
    ends = pieces.groupBy("file_key").agg(
        F.max(F.struct("chunk", "pos")).alias("last"),
        (F.sum(F.octet_length("value") + len(PIECE_END)) - F.max("size")).alias("over"),
    )
    closed = F.col("over").isin(0, -_BOM)
    odd = F.raise_error(F.concat(F.lit("bytes missing or doubled in reading "), "file_key")).cast("boolean")
    closed = F.when(F.col("over").isin(0, -_BOM, len(PIECE_END), len(PIECE_END) - _BOM), closed).otherwise(odd)
    # Files are listed by the driver, so there is a row for each already.
    files = listed.join(ends.select("file_key", "last", closed.alias("closed")), "file_key")
    is_last = F.struct("chunk", "pos") == F.col("last")
    text = F.concat(F.make_valid_utf8("value"), F.when(is_last & ~F.col("closed"), "").otherwise(PIECE_END))
    rows = pieces.join(F.broadcast(files), "file_key").select(
        *("script_idx", "chunk", "pos"),
        (is_last & ~F.col("closed")).alias("at_end"),
        F.posexplode(F.split(text, ANY_BREAK)).alias("part", "text"),
    )
    # A line break at the end of the script starts no further line.
    cut = rows.where(~F.col("at_end") | (F.col("part") == 0) | (F.col("text") != "")).drop("at_end")
    in_chunk = Window.partitionBy("script_idx", "chunk").orderBy("pos", "part")
    breaks = F.sum((F.col("part") > 0).cast("long")).over(in_chunk)
    numbered = stage(cut.withColumn("line_no", breaks), "fragments")
    earlier = Window.partitionBy("script_idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("script_idx", "chunk").agg(F.max("line_no").alias("breaks"))
    offsets = offsets.select("script_idx", "chunk", F.coalesce(F.sum("breaks").over(earlier), F.lit(0)).alias("before"))
    return numbered.join(offsets, ["script_idx", "chunk"]).select(
        *("script_idx", "chunk", "pos", "part"), (F.col("line_no") + F.col("before") + 1).alias("line_no"), "text"
    )


def lines_of_fragments(fragments: DataFrame) -> DataFrame:
    """`(script_idx, chunk, pos, line, chars, whole, ...)` for segmentation; `pos` is the number of the line."""
    in_chunk = Window.partitionBy("script_idx", "chunk", "line_no").orderBy("pos", "part")
    up_to = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = fragments.withColumn("size", F.length("text"))
    sized = sized.withColumn("reached", F.sum("size").over(up_to)).withColumn(
        "total", F.sum("size").over(Window.partitionBy("script_idx", "chunk", "line_no"))
    )
    # First what a chunk holds of a line: all of it if it is little, else its two ends.
    sized = sized.withColumns(
        {
            "all": F.when(F.col("total") <= LONG_LINE, F.col("text")),
            "begins": F.when(F.col("reached") - F.col("size") < KEPT, F.left("text", F.lit(KEPT))),
            "ends": F.when(F.col("total") - F.col("reached") < KEPT, F.right("text", F.lit(KEPT))),
        }
    )
    closed = F.struct("chunk", "pos", "part", F.substring_index("text", COMMENT_CLOSE, -1).alias("rest"))
    here = sized.groupBy("script_idx", "chunk", "line_no").agg(
        F.expr("listagg(all, '') WITHIN GROUP (ORDER BY pos, part)").alias("all"),
        F.expr("listagg(begins, '') WITHIN GROUP (ORDER BY pos, part)").alias("begins"),
        F.expr("listagg(ends, '') WITHIN GROUP (ORDER BY pos, part)").alias("ends"),
        F.sum(utf16_length(F.col("text"))).alias("chars"),
        F.max("total").alias("size"),
        F.max(F.when(F.col("text").contains(COMMENT_CLOSE), closed)).alias("closed"),
        F.max(F.struct("chunk", "pos", "part")).alias("last"),
    )
    here = here.withColumns({c: F.coalesce(c, F.lit("")) for c in ("all", "begins", "ends")})
    # Then the line: a row for each chunk that it runs over, of bounded size.
    lines = here.groupBy(*_LINE).agg(
        F.min("chunk").alias("first_chunk"),
        F.sum("size").alias("size"),
        F.sum("chars").alias("chars"),
        *[F.expr(f"listagg({c}, '') WITHIN GROUP (ORDER BY chunk)").alias(c) for c in ("all", "begins", "ends")],
        F.max("closed").alias("closed"),
        F.max("last").alias("last"),
    )
    begins, ends = F.left("begins", F.lit(KEPT)), F.right("ends", F.lit(KEPT))
    closes = F.col("closed").isNotNull()
    shut = F.concat(F.lit(COMMENT_CLOSE), F.col("closed.rest"))
    in_last = F.struct("closed.chunk", "closed.pos", "closed.part") == F.col("last")
    # What follows the last closing mark, as far as it counts. A fragment that others follow ends with `),`.
    after = F.when(in_last, shut).otherwise(F.concat(shut, F.lit(LEFT_OUT), ends))
    opened = F.when(begins.startswith(VERSIONED_OPEN), VERSIONED_OPEN).otherwise(COMMENT_OPEN)
    stand_in = (
        F.when(closes & begins.startswith(COMMENT_OPEN), F.concat(opened, after))
        .when(closes, F.concat(begins, F.lit(f"{LEFT_OUT}{COMMENT_CLOSE}{LEFT_OUT}"), ends))
        .otherwise(F.concat(begins, F.lit(LEFT_OUT), ends))
    )
    whole = F.col("size") <= LONG_LINE
    # Where the text of a long line begins that a note leads, with versioned notes dropped or kept.
    kept_from = F.when(closes & begins.startswith(COMMENT_OPEN), F.struct("closed.chunk", "closed.pos", "closed.part"))
    return lines.select(
        "script_idx",
        F.col("first_chunk").alias("chunk"),
        F.col("line_no").alias("pos"),
        F.when(whole, F.col("all")).otherwise(stand_in).alias("line"),
        "chars",
        whole.alias("whole"),
        F.when(~whole, kept_from).alias("kept_from"),
        F.when(~whole & ~begins.startswith(VERSIONED_OPEN), kept_from).alias("kept_from_versioned"),
    )

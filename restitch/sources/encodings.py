"""Scripts in UTF-16 and UTF-32, known by the byte-order mark they begin with.

A split of such a file starts anywhere, also inside a character, and the bytes of a line break may turn up
across two characters. So lines are first cut wherever the bytes of `\\n` are, and the sizes of these pieces,
summed along a chunk and then along one row per chunk, give the place of each in the file. A break
that does not end on a whole number of code units is none: the pieces around it are one line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restitch.session import file_system_entry
from restitch.sources.names import read_key


@dataclass(frozen=True)
class Wide:
    """An encoding with code units of several bytes."""

    name: str
    unit: int
    mark: bytes


# The longer marks first: the one of UTF-32, little end first, begins with that of UTF-16. Fixed values of Unicode.
WIDE = (
    Wide("UTF-32LE", 4, b"\xff\xfe\x00\x00"),
    Wide("UTF-32BE", 4, b"\x00\x00\xfe\xff"),
    Wide("UTF-16LE", 2, b"\xff\xfe"),
    Wide("UTF-16BE", 2, b"\xfe\xff"),
)


def encoding_of(spark: SparkSession, uri: str) -> Wide | None:
    """The encoding the first bytes of a file tell; None stands for UTF-8."""
    path_class, settings = file_system_entry(spark)
    path = path_class(uri)
    stream = path.getFileSystem(settings).open(path)
    try:
        read = [stream.read()]
        # Few files begin like a mark; of others one byte is enough.
        if read[0] in {w.mark[0] for w in WIDE}:
            read += [stream.read() for _ in range(3)]
    finally:
        stream.close()
    head = bytes(b for b in read if b >= 0)
    return next((w for w in WIDE if head.startswith(w.mark)), None)


def _text(value: Column, wide: Wide) -> Column:
    """Bytes as text; units that make no character become U+FFFD."""
    width = 2 * wide.unit
    digits = F.hex(value)
    digits = F.substring(digits, F.lit(1), F.length(digits) - F.length(digits) % width)
    if wide.name.endswith("LE"):
        pair = "(..)"
        digits = F.regexp_replace(digits, pair * wide.unit, "".join(f"${k}" for k in range(wide.unit, 0, -1)))
    units = F.regexp_replace(digits, f"({'.' * width})", "$1 ")
    if wide.unit == 2:
        units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
        units = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
        whole, charset = units, "UTF-16BE"
    else:
        whole = F.regexp_replace(units, "(?:0000D[89A-F]..|00(?:1[1-9A-F]|[2-9A-F].)....|(?!00)........) ", "0000FFFD ")
        charset = "UTF-32"
    cut_off = F.when(F.octet_length(value) % wide.unit != 0, "�").otherwise("")
    return F.concat(F.decode(F.unhex(F.replace(whole, F.lit(" "), F.lit(""))), charset), cut_off)


def wide_lines(spark: SparkSession, files: list[str], wide: Wide) -> DataFrame:
    """`(file_key, chunk, pos, line)` of files in one encoding; `pos` tells the place in bytes."""
    unit = wide.unit
    pieces = (
        spark.read.option("encoding", wide.name)
        .option("lineSep", "\n")
        .text(files)
        .select(
            read_key().alias("file_key"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("id"),
            F.col("_metadata.file_size").alias("size"),
            F.col("value").cast("binary").alias("bytes"),
        )
    )
    in_chunk = Window.partitionBy("file_key", "chunk").orderBy("id")
    placed = pieces.withColumn("reached", F.sum(F.octet_length("bytes") + unit).over(in_chunk))
    # Breaks are counted once it is known where a chunk's first piece starts, for each of the few ways it can lie.
    breaks = [F.sum(((F.col("reached") + k) % unit == 0).cast("long")).alias(f"breaks_{k}") for k in range(unit)]
    chunks = placed.groupBy("file_key", "chunk").agg(F.max("reached").alias("held"), F.max("size").alias("size"), *breaks)
    of_file = Window.partitionBy("file_key")
    earlier = of_file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.withColumns(
        {
            "start": F.coalesce(F.sum("held").over(earlier), F.lit(0)),
            # The last piece counts a break that need not be there.
            "over": F.sum("held").over(of_file) - F.col("size"),
        }
    )
    here = F.coalesce(*(F.when(F.col("start") % unit == k, F.col(f"breaks_{k}")) for k in range(unit)))
    starts = starts.withColumn("before", F.coalesce(F.sum(here).over(earlier), F.lit(0)))
    odd = F.raise_error(F.concat(F.lit("bytes missing or doubled in reading "), "file_key")).cast("long")
    start = F.when(F.col("over").isin(0, unit), F.col("start")).otherwise(odd).alias("start")
    placed = placed.join(starts.select("file_key", "chunk", start, "before"), ["file_key", "chunk"])
    end = F.col("start") + F.col("reached")
    broken = (end % unit == 0).cast("long")
    placed = placed.select(
        *("file_key", "chunk", "bytes", "size"),
        (end - unit - F.octet_length("bytes")).alias("at"),
        (F.col("before") + F.sum(broken).over(in_chunk) - broken).alias("line_no"),
    )
    # A break that is none belongs to the line. Pieces are put together in the order of their places.
    joined = F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("digits"))))
    digits = F.array_join(F.transform(joined, lambda p: p["digits"]), "\n".encode(wide.name).hex())
    lines = placed.groupBy("file_key", "line_no").agg(
        F.min("chunk").alias("chunk"), F.min("at").alias("at"), F.max("size").alias("size"), F.unhex(digits).alias("bytes")
    )
    value = F.when(F.col("at") == 0, F.substring("bytes", len(wide.mark) + 1, 1 << 30)).otherwise(F.col("bytes"))
    # The mark alone is no line.
    text = lines.where(F.col("size") > len(wide.mark)).select("file_key", "chunk", "at", _text(value, wide).alias("text"))
    # What is left of line breaks: `\r` in `\r\n`, which ends the line only, and `\r` alone.
    parts = F.split(F.regexp_replace("text", r"\r\z", ""), "\r")
    return text.select("file_key", "chunk", "at", F.posexplode(parts).alias("part", "line")).select(
        # Each part but the last ends with a break of one unit, so these places are in order, and below the next line's.
        *("file_key", "chunk", (F.col("at") + F.col("part") * unit).alias("pos"), "line")
    )

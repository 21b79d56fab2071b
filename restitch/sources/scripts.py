"""Script sources: text files, table columns, and the ordered script list.

Every source yields lines as `(script_idx, chunk, pos, line)`. A chunk is a part of
one script small enough for one task: a file split, or a range of positions. Lines
of a script are ordered by `(chunk, pos)`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restitch.session import file_system_entry, listed_in_few_tasks, pin_file_splits
from restitch.sources.encodings import WIDE, encoding_of, wide_lines
from restitch.sources.names import file_key, read_key

ANY_BREAK = r"\r\n|\n|\r"

# Endings of packed files.
PACKED = (".gz", ".bz2")

# The list of scripts is sent to every executor in parts of so many; each part is a scan of its own.
LIST_PART = 500_000

# So many files are looked up at a time; each is some calls to the file system.
LOOK_UPS = 16


def _each(look_up: Callable[[SparkSession, str], Any], spark: SparkSession, names: Sequence[str]) -> dict[str, Any]:
    """What `look_up` says of each name, many at a time."""
    file_system_entry(spark)
    once = list(dict.fromkeys(names))
    with ThreadPoolExecutor(LOOK_UPS) as pool:
        return dict(zip(once, pool.map(lambda name: look_up(spark, name), once), strict=True))


def _resolve(spark: SparkSession, path: str) -> str:
    """Qualified name of an existing script file; a missing one is an error."""
    path_class, settings = file_system_entry(spark)
    hadoop_path = path_class(path)
    fs = hadoop_path.getFileSystem(settings)
    if not fs.isFile(hadoop_path):
        raise FileNotFoundError(f"script file not found: {path!r}")
    if hadoop_path.getName().startswith(("_", ".")):
        raise ValueError(f"Spark ignores files named like this: {path!r}")
    # Not as a URI, which would escape blanks and brackets.
    return fs.makeQualified(hadoop_path).toString()


def _as_pattern(path: str) -> str:
    """A pattern that only this path fits; Spark takes the paths it reads as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _resolved(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    return _each(_resolve, spark, paths)


def to_read(known: dict[str, str]) -> list[str]:
    """Each file once, however often and in whatever spelling it is listed."""
    return [_as_pattern(uri) for uri in dict.fromkeys(known.values())]


def script_list(spark: SparkSession, paths: Sequence[str], first: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """`(script_idx, script_path, file_key)` in run order, counted from `first`, and the qualified name of each path."""
    known = _resolved(spark, paths)
    rows = [(idx, path, known[path]) for idx, path in enumerate(paths, first)]
    listed = spark.createDataFrame(rows, "script_idx long, script_path string, uri string")
    return listed.withColumn("file_key", file_key(F.col("uri"))).drop("uri"), known


def manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The scripts in run order with their sizes; a path listed twice runs twice."""
    listed, known = script_list(spark, paths)
    with listed_in_few_tasks(spark):
        files = spark.read.format("binaryFile").load(to_read(known))
    sizes = files.select(read_key().alias("file_key"), F.col("length").alias("file_bytes"))
    unread = F.raise_error(F.concat(F.lit("script file not read: "), "script_path")).cast("long")
    size = F.coalesce("file_bytes", unread).alias("file_bytes")
    return listed.join(sizes, "file_key", "left").select("script_idx", "script_path", size)


def scan_scripts(spark: SparkSession, paths: Sequence[str], first: int = 0) -> DataFrame:
    """Lines of script files, counted from `first`. Large files are read as many splits at once.

    Each distinct file is read once; the list (driver-side by nature) is joined on.
    A byte-order mark tells UTF-16 and UTF-32, else a file is read as UTF-8. Bytes that make no
    character become replacement characters. Files packed with gzip or bzip2 (`.gz`, `.bz2`) are
    unpacked on the way, bzip2 in several splits; what they hold is read as UTF-8.
    """
    pin_file_splits(spark)
    parts = [_scan_part(spark, paths[at : at + LIST_PART], first + at) for at in range(0, len(paths), LIST_PART)]
    return reduce(DataFrame.unionByName, parts) if parts else _scan_part(spark, [], first)


def _scan_part(spark: SparkSession, paths: Sequence[str], first: int) -> DataFrame:
    listed, known = script_list(spark, paths, first)
    if not paths:
        return listed.select("script_idx", *[F.lit(0).cast("long").alias(c) for c in ("chunk", "pos")], F.col("script_path").alias("line"))
    told = _each(encoding_of, spark, list(known.values()))
    scanned = []
    if narrow := [_as_pattern(uri) for uri, wide in told.items() if wide is None]:
        with listed_in_few_tasks(spark):
            texts = spark.read.text(narrow)
        scanned.append(
            texts.select(
                read_key().alias("file_key"),
                F.col("_metadata.file_block_start").alias("chunk"),
                F.monotonically_increasing_id().alias("pos"),
                F.make_valid_utf8("value").alias("line"),
            )
        )
    for wide in WIDE:
        if files := [_as_pattern(uri) for uri, found in told.items() if found == wide]:
            scanned.append(wide_lines(spark, files, wide))
    scanned = reduce(DataFrame.unionByName, scanned)
    # The argument list of a run, held by the driver already. A shuffle on the file name
    # would send all lines of a script to one task.
    return scanned.join(F.broadcast(listed), "file_key").select("script_idx", "chunk", "pos", "line")


def lines_from_column(df: DataFrame, script_id: str, text: str) -> DataFrame:
    """Treat every row as one script held in a text column."""
    parts = F.split(F.col(text), ANY_BREAK)
    # A final line break ends the last line; it does not start another one.
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(
        F.col(script_id).cast("long").alias("script_idx"),
        F.lit(0).cast("long").alias("chunk"),
        F.posexplode(lines).alias("pos", "line"),
    ).withColumn("pos", F.col("pos").cast("long"))


def lines_from_rows(df: DataFrame, script_id: str, pos: str, line: str, chunk_span: int) -> DataFrame:
    """Treat table rows as lines, ordered by the unique position column `pos`.

    A chunk covers `chunk_span` positions, so no task holds more lines than that of
    one script, however much of the table the script owns.
    """
    position = F.col(pos).cast("long")
    return df.select(
        F.col(script_id).cast("long").alias("script_idx"),
        (position - F.pmod(position, F.lit(chunk_span))).alias("chunk"),
        position.alias("pos"),
        F.col(line).alias("line"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add `line_no`, counted from 1 within each script.

    Lines are ranked inside chunks; a window over one row per chunk gives the offset.
    """
    in_chunk = Window.partitionBy("script_idx", "chunk").orderBy("pos")
    earlier = Window.partitionBy("script_idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("script_idx", "chunk").agg(F.count("*").alias("n_lines"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0))).drop("n_lines")
    return (
        lines.withColumn("rank", F.row_number().over(in_chunk))
        .join(offsets, ["script_idx", "chunk"])
        .withColumn("line_no", F.col("offset") + F.col("rank"))
        .drop("rank", "offset")
    )

"""The registered queries: each runs a part of the package over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import samples
from restitch import (
    Segmentation,
    Target,
    append_rows,
    failures,
    insert_rows,
    lines_from_column,
    lines_of_fragments,
    manifest,
    parse,
    parse_all,
    prepare_database,
    resolve,
    rows_of,
    run_scripts,
    scan_fragments,
    scan_scripts,
    settle,
    stage,
    statement_progress,
    table_after,
    take_in_order,
)
from restitch.sources.scripts import number_lines
from restitch.sources.tables import table_name

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("price_cents", T.LongType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
ACCOUNTS = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("cents", T.LongType()),
    ]
)


def _event_scripts(spark: SparkSession, sf_dir: str, keep_versioned: bool = False) -> Segmentation:
    return Segmentation(samples.event_lines(spark, sf_dir), keep_versioned)


def _as_orders(rows: DataFrame) -> DataFrame:
    price = (F.col("price_cents") / F.lit(100.0)).alias("o_totalprice")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", price, "o_orderdate", "o_orderpriority")


# ---- sources -------------------------------------------------------------------


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.write_scripts(samples.order_lines(spark, sf_dir))
    return number_lines(scan_scripts(spark, paths)).select("script_idx", "line_no", "line")


def script_lines_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.write_packed_scripts(samples.order_lines(spark, sf_dir))
    return number_lines(scan_scripts(spark, paths)).select("script_idx", "line_no", "line")


def script_lines_utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.write_utf16_scripts(samples.order_lines(spark, sf_dir))
    return number_lines(scan_scripts(spark, paths)).select("script_idx", "line_no", "line")


def script_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = samples.write_scripts(samples.order_lines(spark, sf_dir))
    return manifest(spark, [*paths, paths[0]]).select("script_idx", "file_bytes")


def script_long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines too long for one task: their size, whether they are kept whole, and how they begin and end."""
    lines = lines_of_fragments(scan_fragments(spark, samples.write_one_line_scripts(spark, sf_dir)))
    begins, ends = F.left("line", F.lit(40)).alias("begins"), F.right("line", F.lit(40)).alias("ends")
    return lines.select("script_idx", F.col("pos").alias("line_no"), "chars", "whole", begins, ends)


# ---- lines to statements --------------------------------------------------------


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir).statement_lines().select("script_idx", "pos", "text")


def kept_lines_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir, keep_versioned=True).statement_lines().select("script_idx", "pos", "text")


def comment_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir).states().select("script_idx", "pos", "open_before", "open_after")


def block_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir).states().select("script_idx", "pos", "depth_before", "depth_after")


def block_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir).warnings().select("script_idx", "pos", "seq")


def delimiter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_scripts(spark, sf_dir).states().select("script_idx", "pos", "delimiter")


def statement_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _event_scripts(spark, sf_dir)
        .bounds()
        .select(
            "script_idx",
            "seq",
            F.col("first.pos").alias("first_pos"),
            F.col("last.pos").alias("last_pos"),
            "kept_lines",
            "terminated",
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["script_idx", "seq", "text", "terminated", "chars_read"]
    return _event_scripts(spark, sf_dir).statements().select(*columns)


def unterminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements(spark, sf_dir).where(~F.col("terminated")).drop("terminated")


def statements_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_from_column(samples.read(spark, sf_dir, "documents"), "doc_id", "text")
    return Segmentation(lines).statements().select("script_idx", "seq", "text", "terminated", "chars_read")


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = samples.event_lines(spark, sf_dir)
    scripts = lines.groupBy("script_idx").agg(F.sum(F.octet_length("line") + 1).alias("file_bytes"))
    return statement_progress(Segmentation(lines).bounds(), scripts)


# ---- statements to tables --------------------------------------------------------


def restore_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements = Segmentation(samples.order_lines(spark, sf_dir)).statements()
    return _as_orders(insert_rows(statements, "orders", ORDERS))


def restore_long_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each script is one INSERT on one line; its rows come from pieces, and no text of it is put together."""
    fragments = scan_fragments(spark, samples.write_one_line_scripts(spark, sf_dir))
    parsed = parse_all(Segmentation(lines_of_fragments(fragments)), fragments)
    return _as_orders(rows_of(parsed, "orders", ORDERS))


def restore_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a database that holds other rows, which the overwrite removes."""
    database = f"restored_{uuid.uuid4().hex}"
    paths = samples.write_scripts(samples.order_lines(spark, sf_dir))
    prepare_database(spark, database)
    orders = samples.read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("price_cents")
    old = orders.select("o_orderkey", "o_custkey", "o_orderstatus", cents, "o_orderdate", "o_orderpriority")
    append_rows(old, database, "orders")
    targets = {"orders": Target(ORDERS, ["o_orderkey"])}
    run_scripts(spark, paths, database, targets, if_exists="overwrite")
    return _as_orders(spark.table(table_name(database, "orders")))


def _after_clashes(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The table after a dump of clashing rows; 25 of the keys are in it already."""
    there = samples.read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 350).cast("int").alias("id"), F.col("n_name").alias("name"), F.lit(7).cast("long").alias("cents")
    )
    parsed = stage(parse(Segmentation(samples.clashing_lines(spark, sf_dir, mode)).statements()))
    target = Target(ACCOUNTS, ["id"], there)
    return table_after(parsed, settle(parsed, {"accounts": target}), "accounts", target)


def restore_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_clashes(spark, sf_dir, "ignore")


def restore_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_clashes(spark, sf_dir, "replace")


def restore_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_clashes(spark, sf_dir, "update")


def _accounts(spark: SparkSession, sf_dir: str, stop_on_error: bool = False) -> tuple[DataFrame, DataFrame]:
    """Statements and outcomes of the damaged dump; 25 keys are in the table already."""
    there = samples.read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 350).cast("int").alias("id"))
    statements = Segmentation(samples.account_lines(spark, sf_dir)).statements()
    targets = {"accounts": Target(ACCOUNTS, ["id"], there)}
    return statements, resolve(stage(parse(statements)), targets, stop_on_error)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir)[1].select("script_idx", "seq", "status", "reason")


def outcomes_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, stop_on_error=True)[1].select("script_idx", "seq", "status", "reason")


def failed_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements, found = _accounts(spark, sf_dir)
    return failures(found, statements).select("script_idx", "seq", "text", "reason")


def resume_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items keyed by order and line, inserted supplier by supplier and part by part."""
    claims = samples.read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("script_idx"), F.col("l_partkey").alias("seq"), "l_orderkey", "l_linenumber"
    )
    return take_in_order(claims, ["l_orderkey", "l_linenumber"])


def resume_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement per event that inserts its instant and that of the next event: each waits for the one before."""
    events = samples.read(spark, sf_dir, "events")
    own = events.select(F.lit(0).cast("long").alias("script_idx"), F.col("event_id").alias("seq"), "ts")
    following = events.where("event_id > 0").select(F.lit(0).cast("long").alias("script_idx"), (F.col("event_id") - 1).alias("seq"), "ts")
    return take_in_order(own.unionByName(following), ["ts"])


def resume_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders a statement, into a table that takes each date once, and each customer once per status."""
    orders = samples.read(spark, sf_dir, "orders")
    script = F.expr("o_orderkey div 3000").alias("script_idx")
    claims = orders.select(script, F.expr("o_orderkey div 3").alias("seq"), "o_orderdate", "o_custkey", "o_orderstatus")
    there = orders.where("o_orderkey % 100 = 99").select("o_orderdate", (F.col("o_custkey") + 1).alias("o_custkey"), "o_orderstatus")
    return take_in_order(claims, [["o_orderdate"], ["o_custkey", "o_orderstatus"]], there)


QUERIES = {
    "script_lines": script_lines,
    "script_lines_packed": script_lines_packed,
    "script_lines_utf16": script_lines_utf16,
    "script_manifest": script_manifest,
    "script_long_lines": script_long_lines,
    "comment_state": comment_state,
    "kept_lines": kept_lines,
    "kept_lines_versioned": kept_lines_versioned,
    "block_depth": block_depth,
    "block_warnings": block_warnings,
    "delimiter_state": delimiter_state,
    "statement_bounds": statement_bounds,
    "statements": statements,
    "unterminated": unterminated,
    "statements_documents": statements_documents,
    "statement_progress": progress,
    "restore_rows": restore_rows,
    "restore_long_insert": restore_long_insert,
    "restore_overwrite": restore_overwrite,
    "restore_ignore": restore_ignore,
    "restore_replace": restore_replace,
    "restore_upsert": restore_upsert,
    "outcomes": outcomes,
    "outcomes_stop": outcomes_stop,
    "failures": failed_statements,
    "resume_statements": resume_statements,
    "resume_chain": resume_chain,
    "resume_unique": resume_unique,
}

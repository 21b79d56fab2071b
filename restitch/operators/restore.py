"""Statements -> rows of the target tables.

INSERT statements with literal rows become rows. Other statements would need the
server's own engine; they keep a row in the outcomes, marked as skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch import session
from restitch.functions.inserts import (
    EXPRESSION,
    insert_columns,
    insert_mode,
    insert_table,
    insert_tuples,
    insert_updates,
    statement_kind,
    tuple_values,
    typed,
)

POSITION = ["script_idx", "seq"]
# What all rows of a statement share.
STATEMENT_COLUMNS = ["kind", "table_name", "column_names", "mode", "updates"]


@dataclass(frozen=True)
class Target:
    """A table a dump is restored into: its columns, its key, the rows it holds already, and further unique keys.

    Without a key nothing can clash, so all rows that fit are taken.
    """

    schema: T.StructType
    keys: Sequence[str] = ()
    existing: DataFrame | None = None
    unique: Sequence[Sequence[str]] = ()


def parse(statements: DataFrame) -> DataFrame:
    """One row per tuple of every INSERT, and one row with NULL `row_no` per other statement."""
    text = F.col("text")
    is_insert = F.col("kind") == "insert"
    return (
        statements.select(*POSITION, "text", statement_kind(text, F.col("too_long")).alias("kind"))
        .withColumn("table_name", F.when(F.col("kind").isin("insert", "syntax"), insert_table(text)))
        .withColumn("column_names", F.when(is_insert, insert_columns(text)))
        .withColumn("mode", F.when(is_insert, insert_mode(text)))
        .withColumn("updates", F.when(F.col("mode") == "update", insert_updates(text)))
        .withColumn("tuples", F.when(is_insert, insert_tuples(text)))
        .select(*POSITION, *STATEMENT_COLUMNS, F.posexplode_outer("tuples").alias("row_no", "row"))
        # Values come out of a generator, so that no filter or column repeats the work.
        .select(
            *(*POSITION, *STATEMENT_COLUMNS, "row_no"),
            F.explode(F.array(tuple_values(F.col("row")))).alias("values"),
        )
    )


def stage(parsed: DataFrame) -> DataFrame:
    """Write parsed rows to the shared folder once; outcomes and loads then read columns of it."""
    return session.stage(parsed, "parsed")


def _value_of(field: T.StructField, at: int) -> Column:
    """The value for a column: by place, or by name if the statement lists names."""
    listed = F.array_position("column_names", F.lit(field.name.lower())).cast("int")
    # Found in the row by its place.
    return F.when(F.size("column_names") == 0, F.get("values", F.lit(at))).otherwise(F.get("values", listed - 1))


def typed_rows(parsed: DataFrame, table: str, target: Target) -> DataFrame:
    """`(script_idx, seq, row_no, mode, problem, row, updates)`: rows for one table in its types.

    `row` holds the columns of the table, so their names clash with nothing; `problem` says what keeps a
    row out, if anything. A column the statement does not list is NULL. `updates` has for each
    column, by its place, what the clause for rows that are there does: NULL, or whether it adds, and the value.
    """
    fields = target.schema.fields
    known = F.array(*(F.lit(f.name.lower()) for f in fields))
    expected = F.when(F.size("column_names") == 0, len(fields)).otherwise(F.size("column_names"))
    raw = [_value_of(f, i) for i, f in enumerate(fields)]
    rows = parsed.where((F.col("kind") == "insert") & (F.col("table_name") == table)).select(
        *(*POSITION, "row_no", "mode", "values", "column_names", F.col("updates").alias("clause")),
        F.struct(*(value.alias(f"c{i}") for i, value in enumerate(raw))).alias("raw"),
    )

    def assigned(i: int, field: T.StructField) -> Column:
        mine = F.get(F.filter("clause", lambda u: u["column"] == field.name.lower()), F.lit(0))
        source = F.coalesce(*(F.when(mine["source"] == f.name.lower(), F.col(f"raw.c{k}")) for k, f in enumerate(fields)))
        value = F.when(mine["source"].isNotNull(), source).otherwise(mine["value"])
        told = F.struct(mine["adds"].alias("adds"), typed(value, field.dataType).alias("value"), value["text"].isNotNull().alias("given"))
        return F.when(mine.isNotNull(), told).alias(f"c{i}")

    row = F.struct(*(typed(F.col(f"raw.c{i}"), f.dataType).alias(f.name) for i, f in enumerate(fields)))
    updates = F.struct(*(assigned(i, f) for i, f in enumerate(fields)))
    rows = rows.withColumns({"row": row, "updates": updates})
    unfit, null_key, odd_clause = F.lit(False), F.lit(False), F.lit(False)
    for i, field in enumerate(fields):
        new = F.col(f"updates.c{i}")
        unfit = unfit | (F.col(f"raw.c{i}.text").isNotNull() & F.col(f"row.`{field.name}`").isNull())
        unfit = unfit | F.coalesce(new["given"] & new["value"].isNull(), F.lit(False))
    for key in target.keys:
        null_key = null_key | F.col(f"row.`{key}`").isNull()
        at = [f.name for f in fields].index(key)
        odd_clause = odd_clause | F.col(f"updates.c{at}").isNotNull()
    odd_clause = odd_clause | F.exists("clause", lambda u: u["column"].isNull() | ~F.array_contains(known, u["column"]))
    # Which row is meant by several keys, the server alone could tell.
    several = F.col("mode").isin("replace", "update") & F.lit(bool(target.unique))
    problem = (
        F.when(F.size("values") != expected, "arity")
        .when(F.size(F.array_except("column_names", known)) > 0, "unknown_column")
        .when(F.exists("values", lambda v: v["kind"] == EXPRESSION), "expression")
        .when(several | F.coalesce(odd_clause, F.lit(False)), "unsupported")
        .when(unfit, "cast")
        .when(null_key, "null_key")
    )
    return rows.withColumn("problem", problem).select(*POSITION, "row_no", "mode", "problem", "row", "updates")


def insert_rows(statements: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """All rows the dump holds for one table, whatever else they clash with."""
    return rows_of(parse(statements), table, schema)


def rows_of(parsed: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """`insert_rows` of statements that are parsed already."""
    rows = typed_rows(parsed, table, Target(schema))
    return rows.where(F.col("problem").isNull() | (F.col("problem") == "unsupported")).select("row.*")


def statement_problems(parsed: DataFrame, targets: Mapping[str, Target]) -> DataFrame:
    """One row per statement: status before keys are looked at (`ok`, `failed`, `skipped`)."""
    heads = parsed.select(*POSITION, "kind", "table_name")
    known = F.col("table_name").isin(*targets)
    heads = heads.withColumn(
        "problem",
        F.when(F.col("kind") == "other", "unsupported")
        .when(F.col("kind").isin("syntax", "too_long"), F.col("kind"))
        .when(~known, "unknown_table"),
    )
    problems = heads.select(*POSITION, "table_name", "problem")
    for table, target in targets.items():
        found = typed_rows(parsed, table, target).select(*POSITION, F.lit(table).alias("table_name"), "problem")
        problems = problems.unionByName(found.where(F.col("problem").isNotNull()))
    return (
        problems.groupBy(*POSITION)
        .agg(F.max("table_name").alias("table_name"), F.min("problem").alias("reason"))
        .withColumn(
            "status",
            F.when(F.col("reason").isNull(), "ok")
            .when(F.col("reason").isin("unsupported", "expression"), "skipped")
            .otherwise("failed"),
        )
    )

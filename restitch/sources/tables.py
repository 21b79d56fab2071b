"""The target database: prepared before a run, appended to at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def table_name(database: str, table: str) -> str:
    return f"{quoted(database)}.{quoted(table)}"


def prepare_database(spark: SparkSession, database: str, if_exists: str = "keep") -> None:
    """Make sure the database is there; with `if_exists="overwrite"` it starts empty."""
    if if_exists not in ("keep", "overwrite"):
        raise ValueError(f"if_exists must be 'keep' or 'overwrite', not {if_exists!r}")
    if spark.catalog.databaseExists(quoted(database)):
        if if_exists == "keep":
            return
        spark.sql(f"DROP DATABASE {quoted(database)} CASCADE")
    spark.sql(f"CREATE DATABASE {quoted(database)}")


def existing_rows(spark: SparkSession, database: str, table: str) -> DataFrame | None:
    name = table_name(database, table)
    return spark.table(name) if spark.catalog.tableExists(name) else None


def append_rows(rows: DataFrame, database: str, table: str) -> None:
    rows.write.mode("append").saveAsTable(table_name(database, table))


def replace_rows(rows: DataFrame, database: str, table: str) -> None:
    """`rows` instead of what the table holds; they must not be read from it."""
    rows.write.mode("overwrite").saveAsTable(table_name(database, table))


def append_jdbc(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """Append over JDBC instead; the caller brings the driver."""
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()

"""Run registered queries against their DuckDB oracles: `python tests/check_queries.py [sf_dir] [name ...]`."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]

    def plain(v: object) -> object:
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted(repr([plain(v) for v in row]) for row in frame.astype(object).values.tolist())


def compare(spark: SparkSession, sf_dir: str, name: str) -> str:
    from __spark_entry__ import oracle_sql, queries

    start = time.time()
    got = queries()[name](spark, sf_dir).toPandas()
    took = time.time() - start
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        db.sql(f"create view {table} as select * from '{path + '/*.parquet' if Path(path).is_dir() else path}'")
    want = db.sql(oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        odd = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"DIFFERS {len(a)} vs {len(b)} rows; only here / only there: {odd}"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype) != str(want[c].dtype)}
    return f"ok {len(a)} rows in {took:.1f} s {types or ''}"


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.001"
    from __spark_entry__ import queries

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", "/tmp/restitch-check-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    for query in args[1:] or queries():
        print(f"{query:24s}", compare(session, folder, query), flush=True)

"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.session import checkpoint, shared_folder

_BUCKETS = 1 << 24


_HELD: dict[str, Any] = {}


def of_worker(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks under `name`, made when it is first asked for.

    Workers live on from stage to stage, so only the last name's is kept: the caches of operators that
    run one after the other don't add up.
    """
    if name not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            # Give freed memory back to the system, where the C library can.
            getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)
        _HELD[name] = make()
    return _HELD[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(row: str = "row") -> Column:
    """All columns of the input as one struct."""
    return F.struct("*").alias(row)


def text_of(column: str) -> Column:
    """Text with null taken as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files, below the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_sample(df: DataFrame, most: int, *key: str) -> DataFrame:
    """About `most` rows of `df` at most, chosen by a hash of `key`; all rows if there are no more.

    For fitting models only. The number of rows stays below 1.2 times `most` but for chance.
    """
    total = df.count()
    if total <= most:
        return df
    keep = int(_BUCKETS * most / total)
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(_BUCKETS)) < keep)


__all__ = ["bounded_sample", "checkpoint", "of_worker", "scratch", "table", "text_of", "whole"]

"""How files are told apart in a scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_key(name: Column) -> Column:
    return F.regexp_replace(name, "^file:/+", "file:/")


def read_key() -> Column:
    """Key of the file a row was read from; its metadata give the name as an escaped URI."""
    escaped = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return file_key(F.url_decode(escaped))

"""How far a run is after each statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statement_progress(statements: DataFrame, scripts: DataFrame) -> DataFrame:
    """Characters read so far in the script, as a percentage of its bytes, file k of n.

    `statements` needs `chars_done` (both `statements()` and `bounds()` have it);
    `scripts` has a row per script. Characters leave out line ends, so a script with
    line ends stays below 100.
    """
    return (
        statements.join(scripts.select("script_idx", "file_bytes"), "script_idx")
        .select(
            "script_idx",
            "seq",
            "chars_read",
            "chars_done",
            "file_bytes",
            (F.col("script_idx") + 1).alias("file_no"),
            scripts.agg(F.count("*")).scalar().alias("file_count"),
            F.try_divide(F.col("chars_done") * 100.0, F.col("file_bytes")).alias("percent"),
        )
    )

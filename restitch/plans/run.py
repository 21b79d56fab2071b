"""The whole run: scripts -> statements -> outcomes -> tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.operators import outcomes as _outcomes
from restitch.operators.long_inserts import parse_all
from restitch.operators.progress import statement_progress
from restitch.operators.restore import POSITION, Target, stage
from restitch.operators.segment import MAX_STATEMENT_CHARS, Segmentation
from restitch.session import checkpoint
from restitch.sources.pieces import lines_of_fragments, scan_fragments
from restitch.sources.scripts import manifest, scan_scripts
from restitch.sources.tables import append_rows, existing_rows, prepare_database, replace_rows


# A run that may stop early reads so many bytes of scripts first; less is not worth jobs of its own.
FIRST_BYTES = 1 << 30


@dataclass(frozen=True)
class Run:
    """Reports of a finished run."""

    statements: DataFrame
    outcomes: DataFrame
    failures: DataFrame
    progress: DataFrame


def prefixes(sizes: Sequence[int], first_bytes: int) -> list[int]:
    """Numbers of scripts to read up to: `first_bytes` at least, then twice as many bytes each time."""
    ends, read, goal = [], 0, first_bytes
    for count, size in enumerate(sizes, 1):
        read += size
        if read >= goal:
            ends.append(count)
            goal = 2 * read
    return ends if ends and ends[-1] == len(sizes) else [*ends, len(sizes)]


@dataclass(frozen=True)
class _Part:
    """What is read of scripts next to each other in the list."""

    bounds: DataFrame
    statements: DataFrame
    parsed: DataFrame


def run_scripts(
    spark: SparkSession,
    paths: Sequence[str],
    database: str,
    targets: Mapping[str, Target],
    *,
    if_exists: str = "keep",
    stop_on_error: bool = False,
    keep_versioned: bool = False,
    long_lines: bool = False,
    max_statement_chars: int = MAX_STATEMENT_CHARS,
) -> Run:
    """Restore script files, in list order, into the tables of a database.

    Rows already in a table count as there before the run, so a run that broke off is
    finished by running it again: what is there already fails on its key and is passed over.

    With `stop_on_error` scripts are read in parts of the list that double in size, up to the one with the first
    failure: at most twice the bytes before that failure (`FIRST_BYTES` at least), and one script more. The
    reports end there too. Without it all are read at once.

    With `long_lines` scripts are read in pieces, so that a line may be of any length; they are staged
    once more for that.
    """
    scripts = manifest(spark, paths)
    ends = [len(paths)]
    if stop_on_error:
        sizes = [row["file_bytes"] for row in scripts.orderBy("script_idx").collect()]
        ends = prefixes(sizes, FIRST_BYTES)

    def read(first: int, end: int) -> _Part:
        fragments = scan_fragments(spark, paths[first:end], first) if long_lines else None
        lines = lines_of_fragments(fragments) if long_lines else scan_scripts(spark, paths[first:end], first)
        segmentation = Segmentation(lines, keep_versioned, max_statement_chars)
        statements = segmentation.statements()
        return _Part(segmentation.bounds(), statements, stage(parse_all(segmentation, fragments, statements)))

    def all_of(parts: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, parts)

    parts = [read(0, ends[0])]
    prepare_database(spark, database, if_exists)
    targets = {
        table: replace(target, existing=existing_rows(spark, database, table)) for table, target in targets.items()
    }
    while True:
        parsed = all_of([part.parsed for part in parts])
        # Settled before anything is written: appending changes what the tables hold.
        settled = _outcomes.settle(parsed, targets)
        outcomes = _outcomes.until_first_failure(settled.outcomes) if stop_on_error else settled.outcomes
        outcomes = checkpoint(outcomes)
        if len(parts) == len(ends) or not outcomes.where("status = 'failed'").isEmpty():
            break
        parts.append(read(ends[len(parts) - 1], ends[len(parts)]))
    left_out = checkpoint(settled.left_out)
    statements, bounds = all_of([part.statements for part in parts]), all_of([part.bounds for part in parts])
    if stop_on_error:
        # What comes after the failure was read for nothing, if at all, and is not told of.
        run = outcomes.select(*POSITION)
        statements, bounds = statements.join(run, POSITION, "left_semi"), bounds.join(run, POSITION, "left_semi")
    changed = parsed.where("mode in ('replace', 'update')").select("table_name").distinct()
    changed = {row["table_name"] for row in changed.where(F.col("table_name").isin(*targets)).collect()}
    for table, target in targets.items():
        if table in changed and target.keys and not target.unique:
            rows = stage(_outcomes.table_after(parsed, _outcomes.Settled(outcomes, left_out), table, target))
            replace_rows(rows, database, table)
        else:
            append_rows(_outcomes.applied_rows(parsed, outcomes, table, target, left_out), database, table)
    return Run(
        statements=statements,
        outcomes=outcomes,
        failures=_outcomes.failures(outcomes, statements),
        progress=statement_progress(bounds, scripts),
    )

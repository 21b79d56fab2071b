"""Restore SQL dump scripts with Spark: lines -> statements -> rows -> tables."""

from restitch.operators.conflicts import take_in_order
from restitch.operators.long_inserts import parse_all
from restitch.operators.outcomes import Settled, applied_rows, failures, resolve, settle, table_after, until_first_failure
from restitch.operators.progress import statement_progress
from restitch.operators.restore import Target, insert_rows, parse, rows_of, stage
from restitch.operators.segment import Segmentation
from restitch.plans.run import Run, run_scripts
from restitch.sources.pieces import lines_of_fragments, scan_fragments
from restitch.sources.scripts import lines_from_column, lines_from_rows, manifest, scan_scripts
from restitch.sources.tables import append_rows, prepare_database

__all__ = [
    "Run",
    "Segmentation",
    "Settled",
    "Target",
    "append_rows",
    "applied_rows",
    "failures",
    "insert_rows",
    "lines_from_column",
    "lines_from_rows",
    "lines_of_fragments",
    "manifest",
    "parse",
    "parse_all",
    "prepare_database",
    "resolve",
    "rows_of",
    "run_scripts",
    "scan_fragments",
    "scan_scripts",
    "settle",
    "stage",
    "statement_progress",
    "table_after",
    "take_in_order",
    "until_first_failure",
]

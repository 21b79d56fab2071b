"""Delimiter directives when some delimiter is longer than a directive line may be.

A directive counts only if its line is at least as long as the delimiter in force.
The shortest directive line has nine characters, so only delimiters of ten and more
can shut a later directive out, and only then is this module used. Which directives
count depends on the one before, so each chunk is first summed up as a step function
from "length of the delimiter at entry" to "delimiter at exit"; the few steps of a
script are then followed in order, and each chunk is resolved from its entry.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

SHORTEST_DIRECTIVE = 9

_STEPS = "script_idx long, chunk long, line_len long, token_len long"
_ENTRIES = "script_idx long, chunk long, entry_len long"
_ACCEPTED = "script_idx long, chunk long, pos long, token string"


def _nearest_at_least(lengths: list[int], wanted: int) -> int:
    """Index of the last entry >= wanted in a falling list, or -1."""
    low, high = 0, len(lengths)
    while low < high:
        mid = (low + high) // 2
        if lengths[mid] >= wanted:
            low = mid + 1
        else:
            high = mid
    return low - 1


def _chunk_steps(directives: pd.DataFrame) -> pd.DataFrame:
    """A row per record line length: length of the exit delimiter if that line counts first."""
    rows = directives.sort_values("pos")
    line_lens, token_lens = rows["line_len"].tolist(), rows["token_len"].tolist()
    exit_len = list(token_lens)
    # Stack of later lines longer than all lines before them; the nearest one on top.
    stack_lens: list[int] = []
    stack_lines: list[int] = []
    for i in range(len(rows) - 1, -1, -1):
        follower = _nearest_at_least(stack_lens, token_lens[i])
        if follower >= 0:
            exit_len[i] = exit_len[stack_lines[follower]]
        while stack_lens and stack_lens[-1] <= line_lens[i]:
            stack_lens.pop()
            stack_lines.pop()
        stack_lens.append(line_lens[i])
        stack_lines.append(i)
    return pd.DataFrame(
        {
            "script_idx": rows["script_idx"].iloc[0],
            "chunk": rows["chunk"].iloc[0],
            "line_len": stack_lens,
            "token_len": [exit_len[line] for line in stack_lines],
        }
    )


def _chunk_entries(steps: pd.DataFrame) -> pd.DataFrame:
    """Length of the delimiter in force at the start of each chunk of one script."""
    entry, entries = 1, []
    for chunk, part in steps.sort_values(["chunk", "line_len"]).groupby("chunk", sort=True):
        entries.append((chunk, entry))
        reached = part[part["line_len"] >= entry]
        if len(reached):
            entry = int(reached["token_len"].iloc[0])
    return pd.DataFrame(entries, columns=["chunk", "entry_len"]).assign(script_idx=steps["script_idx"].iloc[0])[
        ["script_idx", "chunk", "entry_len"]
    ]


def _accepted_in_chunk(directives: pd.DataFrame) -> pd.DataFrame:
    rows = directives.sort_values("pos")
    current, keep = int(rows["entry_len"].iloc[0]), []
    for line_len, token_len in zip(rows["line_len"], rows["token_len"], strict=True):
        counts = line_len >= current
        keep.append(counts)
        if counts:
            current = token_len
    return rows.loc[keep, ["script_idx", "chunk", "pos", "token"]]


def accepted_directives(directives: DataFrame) -> DataFrame:
    """Directives that take effect, out of `(script_idx, chunk, pos, token, token_len, line_len)`.

    Only directive lines come here. Groups are single chunks, or the steps of one
    script, which are no more than the records of its chunks.
    """
    by_chunk = directives.groupBy("script_idx", "chunk")
    steps = by_chunk.applyInPandas(_chunk_steps, _STEPS)
    entries = steps.groupBy("script_idx").applyInPandas(_chunk_entries, _ENTRIES)
    return (
        directives.join(entries, ["script_idx", "chunk"])
        .groupBy("script_idx", "chunk")
        .applyInPandas(_accepted_in_chunk, _ACCEPTED)
        .withColumnRenamed("token", "accepted_token")
    )


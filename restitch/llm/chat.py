"""Chat formatting: a state machine checks the order of roles, a template gives text segments with loss flags.

A template is declarative: what opens a turn, what ends it, which roles are trained on, and
which role may follow which. Texts may hold the template's own control strings: in a text,
every `<`, backslashes, `|` gets one backslash more, so `<|` never occurs inside a text and
the change can be undone. In role names, backslashes and newlines are escaped as well.

Turns are read in the order of `turn` (nulls first, then role and text). One conversation
may hold any share of the rows: turns are streamed in sorted order, never gathered.
Null texts and roles count as empty; a null conversation is a conversation of its own;
repeated rows are turns of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """Each turn is `opening + role + after_role + text + closing`; only texts of `trained` roles bear loss."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    trained: frozenset[str] = frozenset({"assistant"})
    # From the role before (START at the beginning) to the roles that may come next.
    follows: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            START: frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "tool"}),
            "tool": frozenset({"assistant"}),
        }
    )
    # Roles that a conversation may end with.
    ends: frozenset[str] = frozenset({"assistant"})


CHATML = Template()

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


# Ids pass through Python as text: pandas would turn a column with a null into floats.
SEGMENTS = "conv_id string, turn_no long, part int, text string, loss boolean, in_order boolean"


def format_turns(frames: Iterator[pd.DataFrame], template: Template = CHATML) -> Iterator[pd.DataFrame]:
    """Three segments per turn; `in_order` tells whether the turns so far follow the template."""
    conv, state, turn_no, good = object(), START, 0, True
    for frame in frames:
        out = []
        for conv_id, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
            if conv_id != conv:
                conv, state, turn_no, good = conv_id, START, 0, True
            good = good and role in template.follows.get(state, ())
            state = role
            head = template.opening + escape_role(role) + template.after_role
            out += [
                (conv_id, turn_no, 0, head, False, good),
                (conv_id, turn_no, 1, escape(text), role in template.trained, good),
                (conv_id, turn_no, 2, template.closing, False, good),
            ]
            turn_no += 1
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])


def segments(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of `conversations (conv_id, turn, role, text)`, sorted within partitions, a conversation in one."""
    turns = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    named = ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")
    return named.mapInPandas(lambda it: format_turns(it, template), SEGMENTS).withColumn("conv_id", F.col("conv_id").cast("long"))


READ = (
    "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, in_order boolean"
)


class _Reader:
    """Reads one conversation's formatted text piece by piece and keeps digests only."""

    def __init__(self, conv_id: str | None, template: Template):
        self.conv_id, self.template = conv_id, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest, self.trained, self.good, self.role = "", "", True, ""

    def add(self, text: str, loss: bool, in_order: bool) -> None:
        self.chars += len(text)
        self.rest += text
        self.trained += text if loss else ""
        self.good = self.good and in_order
        end = self.rest.find(self.template.closing)
        while end >= 0:
            self.turn(self.rest[:end])
            self.rest = self.rest[end + len(self.template.closing) :]
            end = self.rest.find(self.template.closing)

    def turn(self, formatted: str) -> None:
        if not formatted.startswith(self.template.opening):
            raise ValueError(f"conversation {self.conv_id}: a turn doesn't start with {self.template.opening!r}")
        head, _, body = formatted[len(self.template.opening) :].partition(self.template.after_role)
        self.role = unescape_role(head)
        self.turns.update(f"{self.role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        trained = unescape(self.trained)
        self.loss.update(trained.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(trained)
        self.trained = ""

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: text after the last turn")
        good = self.good and self.role in self.template.ends
        return (
            *(self.conv_id, self.n_turns, self.turns.hexdigest()),
            *(self.loss_chars, self.loss.hexdigest(), self.chars, good),
        )


def read_segments(frames: Iterator[pd.DataFrame], template: Template = CHATML) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    frame_of = lambda rows: pd.DataFrame(rows, columns=names)
    reader = None
    for frame in frames:
        out = []
        for conv_id, text, loss, good in zip(*(frame[c] for c in ("conv_id", "text", "loss", "in_order")), strict=True):
            if reader is None or reader.conv_id != conv_id:
                out += [reader.row()] if reader else []
                reader = _Reader(conv_id, template)
            reader.add(text, bool(loss), bool(good))
        if out:
            yield frame_of(out)
    if reader:
        yield frame_of([reader.row()])


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation what its formatted segments hold, parsed from their text and loss flags.

    `formatted` is the output of `segments`, whose order it relies on.
    """
    columns = formatted.select(F.col("conv_id").cast("string").alias("conv_id"), "text", "loss", "in_order")
    return columns.mapInPandas(lambda it: read_segments(it, template), READ).withColumn("conv_id", F.col("conv_id").cast("long"))

"""Brute force for tests: walk a script line by line and fold one state."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# White space outside ASCII, as numbers: it is hard to tell apart in an editor.
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = "\t\n\x0b\x0c\r " + "".join(map(chr, _WIDE_SPACE))


@dataclass
class Walk:
    versioned: bool = False
    in_comment: bool = False
    depth: int = 0
    delimiter: str = ";"
    warnings: int = 0
    done: list[tuple] = field(default_factory=list)
    trace: list[tuple] = field(default_factory=list)

    def visible(self, line: str) -> str:
        if self.in_comment:
            self.in_comment = "*/" not in line
            return ""
        for _ in range(2):
            if line.startswith("--"):
                return ""
            if not line.startswith("/*") or (self.versioned and line.startswith("/*!")):
                return line
            if "*/" not in line:
                self.in_comment = True
                return ""
            line = line.rpartition("*/")[2].strip(_SPACE)
        return line

    def closes_statement(self, text: str) -> bool:
        bare = text.strip(_SPACE)
        if not bare:
            return False
        word = bare.strip(";").strip(_SPACE).lower()
        if word == "begin":
            self.depth += 1
            return False
        if word == "end":
            self.warnings += self.depth == 0
            self.depth = max(0, self.depth - 1)
            return self.depth == 0
        if self.depth or len(bare) < len(self.delimiter):
            return False
        if bare.startswith("DELIMITER"):
            named = bare[len("DELIMITER") :].lstrip(_SPACE)
            self.delimiter = re.match(f"[^{_SPACE}]*", named).group()
        return self.delimiter == ";" and bare.endswith(";")

    def run(self, lines: list[str]) -> "Walk":
        parts, chars = [], 0
        for line in lines:
            chars += len(line.encode("utf-16-le")) // 2
            before = (self.in_comment, self.depth)
            text = self.visible(line)
            ends = False
            if text:
                parts.append(text)
                ends = self.closes_statement(text)
            self.trace.append((*before, self.in_comment, self.depth, self.delimiter, bool(text), ends))
            if ends:
                self.done.append(("\n".join(parts), True, chars))
                parts, chars = [], 0
        if parts:
            self.done.append(("\n".join(parts), False, chars))
        return self

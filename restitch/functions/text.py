"""Column expressions over script lines: trimming, lengths, comments, keywords.

Everything here stays in built-in functions. Regular expressions use possessive
quantifiers, so that no line, however long, makes the matcher backtrack or recurse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the script syntax.
LINE_COMMENT = "--"
COMMENT_OPEN = "/*"
COMMENT_CLOSE = "*/"
VERSIONED_OPEN = "/*!"
DEFAULT_DELIMITER = ";"

_OUTER_SPACE = r"(?U)\A\s++|\s++\z"
_BEGIN = r"(?U)\A\s*+;*+\s*+[bB][eE][gG][iI][nN]\s*+;*+\s*+\z"
_END = r"(?U)\A\s*+;*+\s*+[eE][nN][dD]\s*+;*+\s*+\z"
_DIRECTIVE = r"(?U)\A\s*+DELIMITER\s*+(\S*+)"


def _visible_ascii(char: Column) -> Column:
    return F.ascii(char).between(33, 126)


def unicode_trim(text: Column) -> Column:
    """Remove Unicode white space at both ends. Callers keep it off the common path."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units; characters outside the basic plane count twice."""
    wide = F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2)
    chars = F.char_length(text).cast("long")
    return F.when(F.octet_length(text) == chars, chars).otherwise(wide)


def _opens_block(text: Column, keep_versioned: bool) -> Column:
    leads = text.startswith(COMMENT_OPEN)
    return leads & ~text.startswith(VERSIONED_OPEN) if keep_versioned else leads


def has_close(line: Column) -> Column:
    return line.contains(COMMENT_CLOSE)


def after_comment(line: Column, keep_versioned: bool) -> Column:
    """What follows a block comment the line starts with and closes; NULL for other lines.

    The comment is cut through the last closing mark of the line.
    """
    cut = unicode_trim(F.substring_index(line, COMMENT_CLOSE, -1))
    return F.when(_opens_block(line, keep_versioned) & has_close(line), cut)


def outside_comment(line: Column, rest: Column, keep_versioned: bool) -> tuple[Column, Column]:
    """For a line met outside any comment: the text it leaves, and whether it opens one.

    `rest` is `after_comment(line)`. It holds no closing mark, so it is looked at once
    more and no further.
    """
    seen = F.coalesce(rest, line)
    leads = _opens_block(seen, keep_versioned)
    text = F.when(leads | seen.startswith(LINE_COMMENT), F.lit("")).otherwise(seen)
    return text, leads


def _may_start_with(text: Column, letters: str) -> Column:
    """False if the first character is visible ASCII and none of `letters`."""
    return ~_visible_ascii(text) | F.left(text, F.lit(1)).isin(*letters)


def block_step(text: Column) -> Column:
    """+1 for a line that is just BEGIN, -1 for one that is just END, else 0."""
    step = F.when(text.rlike(_BEGIN), 1).when(text.rlike(_END), -1).otherwise(0)
    return F.when(_may_start_with(text, ";bBeE"), step).otherwise(0)


def directive_token(text: Column) -> Column:
    """Delimiter named by a DELIMITER line (may be empty); NULL for other lines."""
    named = _may_start_with(text, "D") & text.rlike(_DIRECTIVE)
    return F.when(named, F.regexp_extract(text, _DIRECTIVE, 1))


def ends_with_terminator(text: Column) -> Column:
    plain = text.endswith(DEFAULT_DELIMITER)
    spaced = ~plain & ~_visible_ascii(F.right(text, F.lit(1))) & (text != "")
    return F.when(spaced, unicode_trim(text).endswith(DEFAULT_DELIMITER)).otherwise(plain)

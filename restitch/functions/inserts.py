"""Column expressions that take INSERT statements apart.

Strings may hold quotes, commas, parentheses and line breaks, so tuples and values are
found by patterns that know strings. All loops are possessive: the matcher runs them
flat, whatever the length of a statement, and never backtracks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = r"""(?:'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+")"""
_NAME = r"(?:`(?:[^`]++|``)++`|[\w$]++)"
_NOTES = r"(?:\s++|--[^\n]*+\n|#[^\n]*+\n|/\*(?:[^*]++|\*(?!/))*+\*/)*+"
_COLUMNS = rf"\(\s*+{_NAME}\s*+(?:,\s*+{_NAME}\s*+)*+\)"
_CALL = rf"""\((?:{_STRING}|[^()'"]++)*+\)"""
_TUPLE = rf"""\((?:{_STRING}|[^()'"]++|{_CALL})*+\)"""
_VALUE = rf"""(?:{_STRING}|[^(),'"]++|{_CALL})++"""
_HEAD = (
    rf"(?siU)\A{_NOTES}(?:INSERT\s++(?:IGNORE\s++)?+|REPLACE\s++)(?:INTO\s++)?+(?:{_NAME}\s*+\.\s*+)?+({_NAME})\s*+"
    rf"({_COLUMNS})?+\s*+VALUES?+\s*+"
)
_TUPLES = rf"{_NOTES}{_TUPLE}(?:{_NOTES},{_NOTES}{_TUPLE})*+{_NOTES}"
# Assignments of a clause for rows that are there: a value of the new row or a literal, set or added.
_NEW = rf"VALUES\s*+\(\s*+{_NAME}\s*+\)"
_PLAIN = rf"(?:{_STRING}|[-+]?+[\d.]++(?:E[-+]?+\d++)?+|NULL)"
_ASSIGNED = rf"{_NAME}\s*+=\s*+(?:{_NEW}|{_PLAIN}|{_NAME}\s*+\+\s*+(?:{_NEW}|{_PLAIN}))"
_CLAUSE = rf"ON\s++DUPLICATE\s++KEY\s++UPDATE\s++({_ASSIGNED}(?:\s*+,\s*+{_ASSIGNED})*+)\s*+"
_COMPLETE = rf"{_HEAD}{_TUPLES}(?:{_CLAUSE})?+;*+\s*+\z"
_UPSERT = rf"{_HEAD}{_TUPLES}(?:AS\s++|ON\s++DUPLICATE\s++)"
_ONE_ASSIGNED = rf"(?siU)\A({_NAME})\s*+=\s*+(?:({_NAME})\s*+\+\s*+)?+(?:VALUES\s*+\(\s*+({_NAME})\s*+\)|({_PLAIN}))\s*+\z"

# What stands between pieces: up to one comma before a run of tuples, and one comma or the terminator behind.
GROUP_OF_TUPLES = rf"(?siU)\A{_NOTES}(,?+){_NOTES}({_TUPLE}(?:{_NOTES},{_NOTES}{_TUPLE})*+)?+{_NOTES}(,?+){_NOTES};*+\s*+\z"

# A piece of a statement by the state it is entered in: what leaves that state, and what in plain text isn't plain.
# A mark stands for what is taken out, with the opening of what isn't closed.
_MARK = "\x01"
_NOT_PLAIN = (
    r"(?s)'(?:[^'\\]++|\\.|'')*+'|\"(?:[^\"\\]++|\\.|\"\")*+\"|`(?:[^`]++|``)*+`|/\*(?:[^*]++|\*(?!/))*+\*/|(?:--|#)[^\n]*+\n"
    r"|(')(?:[^'\\]++|\\.|'')*+\z|(\")(?:[^\"\\]++|\\.|\"\")*+\z|(/\*)(?:[^*]++|\*(?!/))*+\z|(--|#)[^\n]*+\z"
)
_LEAVES_STATE = [
    None,
    r"(?s)\A(?:[^'\\]++|\\.|'')*+'",
    r"(?s)\A(?:[^\"\\]++|\\.|\"\")*+\"",
    r"(?s)\A(?:[^*]++|\*(?!/))*+\*/",
    r"\A[^\n]*+\n",
]

_LITERAL = rf"(?si)\A\s*+(?:_[a-z0-9]++\s*+)?+({_STRING})\s*+\z"
_HEX = r"(?i)\A\s*+(?:_[a-z0-9]++\s++)?+(?:0x([0-9a-f]*+)|x'([0-9a-f]*+)')\s*+\z"
_BITS = r"(?i)\A\s*+b'([01]*+)'\s*+\z"
_NUMBER = r"\A\s*+[-+]?+(?:\d++(?:\.\d*+)?+|\.\d++)(?:[eE][-+]?+\d++)?+\s*+\z"
_NULL = r"(?i)\A\s*+NULL\s*+\z"
_TRUTH = r"(?i)\A\s*+(TRUE|FALSE)\s*+\z"

# What a letter behind a backslash stands for. A percent or low line keeps
# its backslash; every other character stands for itself.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}

# Kinds of values.
TEXT, HEX, EXPRESSION = "text", "hex", "expression"


def _unquote_name(name: Column) -> Column:
    inner = F.replace(name.substr(F.lit(2), F.length(name) - 2), F.lit("``"), F.lit("`"))
    return F.when(name.startswith("`"), inner).otherwise(name)


def statement_kind(text: Column, too_long: Column) -> Column:
    """What restoring can do with a statement.

    `insert`: literal rows; `syntax`: begins like that but breaks off or goes wrong;
    `too_long`: has no text; `other`: anything else, which the server alone could run.
    """
    return (
        F.when(too_long, "too_long")
        .when(~text.rlike(_HEAD), "other")
        .when(text.rlike(_COMPLETE), "insert")
        .when(text.rlike(_UPSERT), "other")
        .otherwise("syntax")
    )


def insert_table(text: Column) -> Column:
    """Table an INSERT names, without its database."""
    return _unquote_name(F.regexp_extract(text, _HEAD, 1))


def insert_mode(text: Column) -> Column:
    """What a row whose key is there already does: `insert` fails its statement, `ignore` is left out,
    `replace` takes the place of the other, `update` changes it."""
    return (
        F.when(text.rlike(rf"(?siU)\A{_NOTES}REPLACE\s"), "replace")
        .when(text.rlike(rf"(?siU)\A{_NOTES}INSERT\s++IGNORE\s"), "ignore")
        # The whole text is matched only where the clause can be.
        .when(text.rlike("(?iU)DUPLICATE") & (F.regexp_extract(text, _COMPLETE, 3) != ""), "update")
        .otherwise("insert")
    )


def insert_updates(text: Column) -> Column:
    """Assignments for rows that are there, as `array<struct<column, adds, source, value>>`.

    `source` names a column of the new row, or is NULL and `value` a literal. An assignment that adds to another
    column than its own has no column.
    """

    def assigned(one: Column) -> Column:
        name, base, source, literal = (F.regexp_extract(one, _ONE_ASSIGNED, k) for k in (1, 2, 3, 4))
        column = F.lower(_unquote_name(name))
        own = (base == "") | (F.lower(_unquote_name(base)) == column)
        return F.struct(
            F.when(own, column).alias("column"),
            (base != "").alias("adds"),
            F.when(source != "", F.lower(_unquote_name(source))).alias("source"),
            F.when(source == "", tuple_values(F.concat(F.lit("("), literal, F.lit(")")))[0]).alias("value"),
        )

    clause = F.regexp_extract(text, _COMPLETE, 3)
    return F.transform(F.regexp_extract_all(clause, F.lit(rf"(?siU){_ASSIGNED}"), F.lit(0)), assigned)


def insert_columns(text: Column) -> Column:
    """Column names an INSERT lists, in lower case; an empty array if it lists none."""
    names = F.regexp_extract_all(F.regexp_extract(text, _HEAD, 2), F.lit(rf"(?U){_NAME}"), F.lit(0))
    return F.transform(names, lambda name: F.lower(_unquote_name(name)))


def insert_head(text: Column) -> Column:
    """An INSERT up to its first tuple."""
    return F.regexp_extract(text, _HEAD, 0)


def tuples_of(text: Column) -> Column:
    """The tuples in text that holds nothing but tuples, notes and commas."""
    plain = F.regexp_replace(text, rf"(?s)({_TUPLE})|/\*(?:[^*]++|\*(?!/))*+\*/|(?:--|#)[^\n]*+\n", "$1")
    plain = F.when(text.rlike(r"/\*|--|#"), plain).otherwise(text)
    return F.regexp_extract_all(plain, F.lit(rf"(?s){_TUPLE}"), F.lit(0))


def bare_text(piece: Column, state: int) -> Column:
    """What is plain text in a piece entered in `state`; NULL if the piece doesn't leave that state."""
    rest = piece
    if state:
        rest = F.when(piece.rlike(_LEAVES_STATE[state]), F.regexp_replace(piece, _LEAVES_STATE[state], ""))
    return F.regexp_replace(rest, _NOT_PLAIN, f"{_MARK}$1$2$3$4")


def leaves(bare: Column) -> Column:
    """The state that a piece is left in, by the end of its bare text."""
    return (
        F.when(bare.endswith(f"{_MARK}'"), 1)
        .when(bare.endswith(f'{_MARK}"'), 2)
        .when(bare.endswith(f"{_MARK}/*"), 3)
        .when(bare.endswith(f"{_MARK}--") | bare.endswith(f"{_MARK}#"), 4)
        .otherwise(0)
    )


def insert_tuples(text: Column) -> Column:
    """The parenthesised tuples of an INSERT, as text."""
    return tuples_of(F.regexp_extract(text, rf"{_HEAD}({_TUPLES})", 3))


def _unescape(literal: Column) -> Column:
    """Content of a quoted literal.

    Pairs of backslashes are split off first: in what is left, every backslash
    belongs to the character behind it.
    """

    def plain(part: Column) -> Column:
        single = F.regexp_replace(part, r"\\'|''", "'")
        part = F.when(literal.startswith("'"), single).otherwise(F.regexp_replace(part, r'\\"|""', '"'))
        for letter, meaning in ESCAPES.items():
            part = F.replace(part, F.lit("\\" + letter), F.lit(meaning))
        return F.regexp_replace(part, r"(?s)\\([^%_])", "$1")

    body = literal.substr(F.lit(2), F.length(literal) - 2)
    return F.array_join(F.transform(F.split(body, r"\\\\"), plain), "\\")


def tuple_values(row: Column) -> Column:
    """Values of one tuple as `array<struct<kind, text>>`; text is NULL for NULL."""

    def found(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))

    def value(raw: Column) -> Column:
        # One closed string without escapes: its second quote is its last character.
        simple = raw.startswith("'") & (F.locate("'", raw, 2) == F.length(raw)) & ~raw.contains("\\")
        digits = F.concat(F.regexp_extract(raw, _HEX, 1), F.regexp_extract(raw, _HEX, 2))
        return (
            F.when(simple, found(TEXT, raw.substr(F.lit(2), F.length(raw) - 2)))
            .when(raw.rlike(_NUMBER), found(TEXT, F.regexp_replace(raw, r"\s++", "")))
            .when(raw.rlike(_NULL), found(TEXT, F.lit(None)))
            .when(raw.rlike(_LITERAL), found(TEXT, _unescape(F.regexp_extract(raw, _LITERAL, 1))))
            .when(raw.rlike(_TRUTH), found(TEXT, F.when(raw.rlike("(?i)true"), "1").otherwise("0")))
            .when(raw.rlike(_BITS), found(TEXT, F.conv(F.regexp_extract(raw, _BITS, 1), 2, 10)))
            .when(raw.rlike(_HEX), found(HEX, digits))
            .otherwise(found(EXPRESSION, F.lit(None)))
        )

    inside = row.substr(F.lit(2), F.length(row) - 2)
    return F.transform(F.regexp_extract_all(inside, F.lit(rf"(?s){_VALUE}"), F.lit(0)), value)


def typed(value: Column, data_type: T.DataType) -> Column:
    """A tuple value as a column of the target type; NULL if it does not fit."""
    text, is_hex = value["text"], value["kind"] == HEX
    if isinstance(data_type, T.BinaryType):
        return F.when(is_hex, F.unhex(text)).otherwise(F.encode(text, "UTF-8"))
    if isinstance(data_type, T.StringType):
        return F.when(is_hex, F.unhex(text).cast("string")).otherwise(text)
    number = F.when(is_hex, F.conv(text, 16, 10)).otherwise(text)
    if isinstance(data_type, T.BooleanType):
        return number.try_cast("double") != 0
    return number.try_cast(data_type)

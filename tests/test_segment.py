"""Segmentation against inline cases and against the sequential walk."""

import random

import pytest
from pyspark.sql import functions as F

from restitch import Segmentation, lines_from_rows
from tests.sequential import Walk

ROUTINE = """
create procedure refill (in lot int)
BEGIN
    set @left := lot;
    update bins set stock = stock + 1 where stock < lot;
    select max(stock) from bins;
END
"""
NOTED = """
create event nightly on schedule every 1 day do
BEGIN
-- old visits go
    delete from visits where age > 90;
END
BEGIN
-- and so do their totals
    truncate totals;
END
"""

# name, versioned comments kept, script, statements
CASES = [
    ("one open", False, "delete from bins", ["delete from bins"]),
    ("one closed", False, "delete from bins;", ["delete from bins;"]),
    ("two closed", False, "\ndelete from bins;\ncall refill(3);\n", ["delete from bins;", "call refill(3);"]),
    (
        "terminator alone",
        False,
        "\ndelete from bins\n;\ncall refill(3);\n",
        ["delete from bins\n;", "call refill(3);"],
    ),
    ("block stays whole", False, ROUTINE, [ROUTINE.strip("\n")]),
    (
        "block counted once",
        False,
        NOTED,
        [
            "create event nightly on schedule every 1 day do\nBEGIN\n    delete from visits where age > 90;\nEND",
            "BEGIN\n    truncate totals;\nEND",
        ],
    ),
    ("versioned dropped", False, "/*!40000 lock bins */", []),
    ("versioned kept", True, "/*!40000 lock bins */", ["/*!40000 lock bins */"]),
    ("long comment dropped", False, "/*!50001 note\nBEGIN\n x;\nEND*/\n", []),
    ("comment leaves terminator", False, "/*!40101 SET NAMES utf8 */;", [";"]),
    ("line ends only", False, "select 1; select 2;", ["select 1; select 2;"]),
    ("trailing comment hides end", False, "select 3; -- t\nselect 4;", ["select 3; -- t\nselect 4;"]),
    ("cut at last close", False, "/* a */ y; /* b */\nz;", ["z;"]),
    ("rest opens again", False, "/* a */ /* b\nx\ny */ t;\nz;", ["z;"]),
    ("begin; is a block", False, "BEGIN;\ninsert 1;\nCOMMIT;\ninsert 2;", ["BEGIN;\ninsert 1;\nCOMMIT;\ninsert 2;"]),
    ("stray end", False, "select case when 1\nend\nfrom t;", ["select case when 1\nend", "from t;"]),
    ("end with mark", False, "BEGIN\nx;\nEND //\ny;", ["BEGIN\nx;\nEND //\ny;"]),
    (
        "end inside delimiter mode",
        False,
        "DELIMITER ;;\nBEGIN\na;\nEND;;\nDELIMITER ;",
        ["DELIMITER ;;\nBEGIN\na;\nEND;;", "DELIMITER ;"],
    ),
    ("blank tail", False, "select 1;\n\n  ", ["select 1;", "  "]),
    ("block stuck", True, "/*!50001 x\nBEGIN\nEND*/", ["/*!50001 x\nBEGIN\nEND*/"]),
    (
        "long delimiter is never left",
        False,
        "DELIMITER $$$$$$$$$$$$\nx\nDELIMITER ;\ny;",
        ["DELIMITER $$$$$$$$$$$$\nx\nDELIMITER ;\ny;"],
    ),
    ("long delimiter left", False, "DELIMITER $$$$$$$$$$$$\nx\n DELIMITER ;          -- \nDELIMITER ;       ;\ny;", None),
    ("empty", False, "", []),
    ("blank lines", False, "\n\n", []),
    ("no word boundary", False, "DELIMITERfoo\na;\nDELIMITER\nb;\nDELIMITER ;\nc;", None),
    ("unicode space", False, "a;\u00a0\nb ;　\n\u00a0BEGIN \nq;\nend\u00a0; ", None),
    ("wide characters", False, "insert '\U0001f600 é';\nx", None),
    ("dotless letters", False, "BEGİN\nx;\nENđ\ny;", None),
]

SHAPES = [
    "BEGIN", "end", " END;; ", "/* a", "b */ tail;", "-- c;", " -- kept;", "", "  ", "/*!40101 SET x */;",
    "/* a */ y;", "/* a */ /* b", "DELIMITER ;;", "DELIMITER ;", "q /* mid */;", "/* a */ lost; /* b */", "END //",
    ";", "a; b;", "/* a */ -- d", "z; -- t", "e */", "v", "v;", "/*", "*/", "/*/", "/* x */ /*! y", "\tbegin;",
    "DELIMITER", ";;", "/*! open", "\u00a0", "x;\u00a0", "/*! a */ /* b */", "--", "/**/",
]
LONG_SHAPES = ["DELIMITER $$$$$$$$$$$$", "DELIMITER ;  -- pad pad pad", "DELIMITER abcdefghijklmno", "DELIMITER ;", "y;", "BEGIN", "end"]


def as_lines(spark, scripts, span):
    rows = [(i, p, line) for i, lines in enumerate(scripts) for p, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "s long, p long, line string").repartition(5)
    return lines_from_rows(df, "s", "p", "line", span)


def found(seg, n):
    out = [[] for _ in range(n)]
    for r in sorted(seg.statements().collect()):
        assert not r.too_long
        out[r.script_idx].append((r.text, r.terminated, r.chars_read))
        assert r.seq == len(out[r.script_idx])
    return out


@pytest.mark.parametrize("versioned, span", [(False, 1), (False, 3), (True, 1), (False, 1000)])
def test_inline_cases(spark, versioned, span):
    cases = [c for c in CASES if c[1] == versioned]
    scripts = [c[2].split("\n") for c in cases]
    got = found(Segmentation(as_lines(spark, scripts, span), versioned), len(cases))
    for case, lines, statements in zip(cases, scripts, got, strict=True):
        walk = Walk(versioned).run(lines)
        assert statements == walk.done, case[0]
        if case[3] is not None:
            assert [s[0] for s in statements] == case[3], case[0]


@pytest.mark.parametrize("versioned, span", [(False, 1), (True, 4), (False, 7), (True, 1000)])
def test_random_scripts(spark, versioned, span):
    rng = random.Random(span * 2 + versioned)
    scripts = [rng.choices(SHAPES, k=rng.randrange(1, 30)) for _ in range(400)]
    seg = Segmentation(as_lines(spark, scripts, span), versioned)
    walks = [Walk(versioned).run(lines) for lines in scripts]
    assert found(seg, len(scripts)) == [w.done for w in walks]
    states = seg.states().select(
        "script_idx", "pos", "open_before", "depth_before", "open_after", "depth_after", "delimiter", "kept", "ends", "warned"
    ).collect()
    warned = [0] * len(scripts)
    for r in states:
        assert tuple(r[2:9]) == walks[r.script_idx].trace[r.pos]
        warned[r.script_idx] += r.warned
    assert warned == [w.warnings for w in walks]
    assert seg.warnings().count() == sum(warned)


@pytest.mark.parametrize("span", [1, 6, 1000])
def test_long_delimiters(spark, span):
    rng = random.Random(span)
    scripts = [rng.choices(LONG_SHAPES, k=rng.randrange(1, 20)) for _ in range(300)]
    scripts += [rng.choices(SHAPES, k=20) for _ in range(50)]
    scripts += [
        [f"DELIMITER {'$' * rng.randrange(1, 30)}{' ' * rng.randrange(0, 3)}{'-' * rng.randrange(0, 20)}" for _ in range(25)]
        for _ in range(100)
    ]
    got = found(Segmentation(as_lines(spark, scripts, span)), len(scripts))
    assert got == [Walk().run(lines).done for lines in scripts]


def test_statement_lines_and_bounds(spark):
    rng = random.Random(9)
    scripts = [rng.choices(SHAPES, k=40) for _ in range(60)]
    seg = Segmentation(as_lines(spark, scripts, 6))
    whole = {(r.script_idx, r.seq): r for r in seg.statements().collect()}
    pieces = {}
    for r in sorted(seg.statement_lines().collect(), key=lambda r: (r.script_idx, r.chunk, r.pos)):
        pieces.setdefault((r.script_idx, r.seq), []).append((r.pos, r.text))
    assert {k: r.text for k, r in whole.items()} == {k: "\n".join(t for _, t in v) for k, v in pieces.items()}
    for b in seg.bounds().collect():
        lines = pieces.pop((b.script_idx, b.seq))
        assert (b.first.pos, b.last.pos, b.kept_lines) == (lines[0][0], lines[-1][0], len(lines))
        row = whole[b.script_idx, b.seq]
        assert (b.terminated, b.chars_read) == (row.terminated, row.chars_read)
    assert not pieces


def test_runaway_statement_keeps_its_row(spark):
    runaway = ["a;", "BEGIN"] + ["insert x;"] * 50
    closed = ["BEGIN"] + ["y;"] * 30 + ["end", "b;"]
    comment = ["c;", "/* never closed"] + ["z;"] * 40
    seg = Segmentation(as_lines(spark, [runaway, closed, comment], 8), max_statement_chars=40)
    rows = seg.statements().orderBy("script_idx", "seq").drop("chars_done").collect()
    assert [tuple(r) for r in rows] == [
        (0, 1, "a;", True, 2, False),
        (0, 2, None, False, 455, True),
        (1, 1, None, True, 68, True),
        (1, 2, "b;", True, 2, False),
        (2, 1, "c;", True, 2, False),
    ]
    lines = seg.statement_lines().groupBy("script_idx", "seq").agg(F.count("*")).collect()
    assert sorted(map(tuple, lines)) == [(0, 1, 1), (0, 2, 51), (1, 1, 32), (1, 2, 1), (2, 1, 1)]


def test_chars_done_runs_over_the_script(spark):
    lines = ["select 1;", "-- note", "", "x", "y;", "-- rest"]
    rows = Segmentation(as_lines(spark, [lines], 2)).statements().orderBy("seq").collect()
    assert [(r.chars_read, r.chars_done) for r in rows] == [(9, 9), (10, 19)]

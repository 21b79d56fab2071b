"""INSERT parsing, typing, problems, and whole runs over files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch import Target, insert_rows, parse, resolve, run_scripts
from restitch.operators.restore import statement_problems, typed_rows
from restitch.plans import run as runs


def schema(**types):
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


SCHEMA = schema(
    id=T.IntegerType(),
    name=T.StringType(),
    price=T.DecimalType(10, 2),
    at=T.TimestampNTZType(),
    raw=T.BinaryType(),
    ok=T.BooleanType(),
)
NAMED = schema(id=T.IntegerType(), name=T.StringType())


def statements(spark, texts):
    rows = [(0, i + 1, t, t is None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "script_idx long, seq long, text string, too_long boolean")


def test_values_survive(spark):
    texts = [
        "INSERT INTO `t` VALUES (1,'it''s, (a) \\'quoted\\' \\\\n line\\nend',1.50,'2020-01-02 03:04:05',0x4142,1),\n"
        "(2,'',NULL,NULL,_binary 'x\\0y',FALSE),(3,NULL,-2,'2021-05-06','',TRUE);",
        'insert into db.t (`NAME`, id) values ("say ""hi"", \\"you\\"", 4) , (\'100\\%\\_\', 5)',
        "-- note\n/* more; */ INSERT INTO t VALUES (6,_utf8mb4'é\U0001f600',0x10,'2020-01-01',x'ff',b'1');",
        "INSERT INTO t VALUES (+7,'\\\\',1e2,null,NULL,0);",
    ]
    got = sorted(tuple(r) for r in insert_rows(statements(spark, texts), "t", SCHEMA).collect())
    at = dt.datetime
    assert got == [
        (1, "it's, (a) 'quoted' \\n line\nend", got[0][2], at(2020, 1, 2, 3, 4, 5), bytearray(b"AB"), True),
        (2, "", None, None, bytearray(b"x\0y"), False),
        (3, None, got[2][2], at(2021, 5, 6), bytearray(b""), True),
        (4, 'say "hi", "you"', None, None, None, None),
        (5, "100\\%\\_", None, None, None, None),
        (6, "é\U0001f600", got[5][2], at(2020, 1, 1), bytearray(b"\xff"), True),
        (7, "\\", got[6][2], None, None, False),
    ]
    assert [str(r[2]) for r in got] == ["1.50", "None", "-2.00", "None", "None", "16.00", "100.00"]


def test_long_statement_does_not_exhaust_the_matcher(spark):
    body = ",".join(f"({i},'{chr(92)}'{'x' * 50}'')'{','}1,NULL,NULL,1)" for i in range(20_000))
    long_string = "\\'" * 200_000
    texts = [f"INSERT INTO t VALUES {body};", f"INSERT INTO t VALUES (-1,'{long_string}',1,NULL,NULL,1);"]
    rows = insert_rows(statements(spark, texts), "t", SCHEMA)
    assert rows.count() == 20_001
    assert rows.where("id = -1").select(F.length("name")).first()[0] == 200_000


def test_problems(spark):
    texts = [
        "INSERT INTO t VALUES (1,'a',1,NULL,NULL,1);",
        "INSERT INTO t VALUES (1,'a');",
        "INSERT INTO t VALUES (2,'a',1,NULL,NULL,1),('no','a',1,NULL,NULL,1);",
        "INSERT INTO t VALUES (NULL,'a',1,NULL,NULL,1);",
        "INSERT INTO t VALUES (3,NOW(),1,NULL,NULL,1);",
        "INSERT INTO t (id, nope) VALUES (4, 5);",
        "INSERT INTO u VALUES (1);",
        "INSERT INTO t VALUES (5,'a',1,NULL,NULL,1),(6,'brok",
        "CREATE TABLE t (id int);",
        ";",
        "INSERT IGNORE INTO t VALUES (7,'a',1,NULL,NULL,1);",
        "INSERT INTO t VALUES (8,'a',1,NULL,NULL,1) ON DUPLICATE KEY UPDATE id = 9;",
        None,
        "INSERT INTO t VALUES (9,'a',1,NULL,NULL,1); INSERT INTO t VALUES (10,'a',1,NULL,NULL,1);",
        "INSERT INTO t () VALUES ();",
    ]
    parsed = parse(statements(spark, texts))
    got = {r.seq: (r.status, r.reason) for r in statement_problems(parsed, {"t": Target(SCHEMA, ["id"])}).collect()}
    assert got == {
        1: ("ok", None),
        2: ("failed", "arity"),
        3: ("failed", "cast"),
        4: ("failed", "null_key"),
        5: ("skipped", "expression"),
        6: ("failed", "unknown_column"),
        7: ("failed", "unknown_table"),
        8: ("failed", "syntax"),
        9: ("skipped", "unsupported"),
        10: ("skipped", "unsupported"),
        11: ("ok", None),
        12: ("skipped", "unsupported"),
        13: ("failed", "too_long"),
        14: ("failed", "syntax"),
        15: ("skipped", "unsupported"),
    }
    assert typed_rows(parsed, "t", Target(SCHEMA)).where("seq = 3").count() == 2


DUMP_A = """-- dump
/*!40101 SET NAMES utf8 */;
CREATE TABLE `t` (
  `id` int NOT NULL
);
INSERT INTO `t` VALUES (1,'a'),
(2,'b');
INSERT INTO `t` VALUES (2,'again'),(3,'lost with it');
INSERT INTO `u` VALUES (1,1),(1,2);
INSERT INTO `u` VALUES (7,99);
"""
DUMP_B = "INSERT INTO t VALUES (3,'c');\r\nINSERT INTO t VALUES ('x','bad');\r\nINSERT INTO t VALUES (4,'d')"


@pytest.fixture
def dumps(tmp_path):
    a, b = tmp_path / "a dump.sql", tmp_path / "b.sql"
    a.write_bytes(DUMP_A.encode())
    b.write_bytes(DUMP_B.encode())
    return [str(a), str(b)]


TARGETS = {
    "t": Target(NAMED, ["id"]),
    "u": Target(schema(id=T.IntegerType(), t_id=T.IntegerType()), ["id"]),
}


def table(spark, name):
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_run_resume_overwrite(spark, dumps):
    run = run_scripts(spark, dumps, "shop_1", TARGETS)
    assert table(spark, "shop_1.t") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert table(spark, "shop_1.u") == [(7, 99)]
    got = sorted((r.script_idx, r.seq, r.status, r.reason) for r in run.outcomes.collect())
    assert got == [
        (0, 1, "skipped", "unsupported"),
        (0, 2, "skipped", "unsupported"),
        (0, 3, "ok", None),
        (0, 4, "failed", "duplicate_key"),
        (0, 5, "failed", "duplicate_key"),
        (0, 6, "ok", None),
        (1, 1, "ok", None),
        (1, 2, "failed", "cast"),
        (1, 3, "ok", None),
    ]
    assert {(r.seq, r.text) for r in run.failures.where("script_idx = 1").collect()} == {
        (2, "INSERT INTO t VALUES ('x','bad');")
    }
    last = run.progress.where("script_idx = 1").orderBy(F.desc("seq")).first()
    assert (last.file_no, last.file_count, last.file_bytes) == (2, 2, len(DUMP_B))
    assert last.percent == pytest.approx(100 * (len(DUMP_B) - 4) / len(DUMP_B))

    again = run_scripts(spark, dumps, "shop_1", TARGETS)
    assert table(spark, "shop_1.t") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert again.outcomes.where("status = 'ok'").count() == 0

    run_scripts(spark, dumps[1:], "shop_1", TARGETS, if_exists="overwrite")
    assert table(spark, "shop_1.t") == [(3, "c"), (4, "d")]
    assert table(spark, "shop_1.u") == []


def test_stop_on_error_ends_the_run(spark, dumps):
    run = run_scripts(spark, [dumps[1], dumps[0]], "halted", TARGETS, stop_on_error=True)
    got = sorted((r.script_idx, r.seq, r.status) for r in run.outcomes.collect())
    assert got == [(0, 1, "ok"), (0, 2, "failed")]
    assert table(spark, "halted.t") == [(3, "c")]


def test_prefixes_double():
    assert runs.prefixes([5, 1, 1, 1, 9, 1, 30], 5) == [1, 5, 7]
    assert runs.prefixes([1, 1, 1], 100) == [3]
    assert runs.prefixes([], 5) == [0]


def test_stop_leaves_later_scripts_unread(spark, tmp_path, monkeypatch):
    """Whatever the parts, a run that stops tells the same; scripts far behind the failure are not read."""
    paths = []
    for i in range(9):
        path = tmp_path / f"s{i}.sql"
        # The fourth clashes with the first.
        path.write_bytes(f"INSERT INTO t VALUES ({i % 3},'x');\nINSERT INTO t VALUES ({10 + i},'y');\n".encode())
        paths.append(str(path))
    scanned = []
    scan = runs.scan_scripts
    monkeypatch.setattr(runs, "scan_scripts", lambda spark, paths, first: scanned.append((first, len(paths))) or scan(spark, paths, first))
    told = []
    for k, first_bytes in enumerate((1, 1 << 30)):
        monkeypatch.setattr(runs, "FIRST_BYTES", first_bytes)
        database = f"early_{k}"
        run = run_scripts(spark, paths, database, TARGETS, stop_on_error=True)
        told.append(
            (
                sorted((r.script_idx, r.seq, r.status, r.reason) for r in run.outcomes.collect()),
                sorted((r.script_idx, r.seq, r.text) for r in run.statements.collect()),
                sorted((r.script_idx, r.seq, r.text, r.reason) for r in run.failures.collect()),
                sorted((r.script_idx, r.seq, r.chars_done, r.file_no, r.file_count) for r in run.progress.collect()),
                table(spark, f"{database}.t"),
            )
        )
    assert told[0] == told[1]
    assert told[0][0][-2:] == [(2, 2, "ok", None), (3, 1, "failed", "duplicate_key")]
    assert [r[0] for r in told[0][4]] == [0, 1, 2, 10, 11, 12]
    assert scanned == [(0, 1), (1, 1), (2, 2), (0, 9)]


def test_stop_among_lines_of_any_length(spark, tmp_path, monkeypatch):
    paths = []
    for i in range(3):
        path = tmp_path / f"s{i}.sql"
        path.write_bytes(b"INSERT INTO t VALUES (1,'x'),(2,'y');\n")
        paths.append(str(path))
    monkeypatch.setattr(runs, "FIRST_BYTES", 1)
    run = run_scripts(spark, paths, "early_long", TARGETS, stop_on_error=True, long_lines=True)
    got = sorted((r.script_idx, r.seq, r.status, r.reason) for r in run.outcomes.collect())
    assert got == [(0, 1, "ok", None), (1, 1, "failed", "duplicate_key")]
    assert table(spark, "early_long.t") == [(1, "x"), (2, "y")]


def test_same_script_twice(spark, dumps):
    run = run_scripts(spark, [dumps[1], dumps[1]], "twice", TARGETS)
    got = sorted((r.script_idx, r.seq, r.status) for r in run.outcomes.collect())
    assert got == [(i, s, "ok" if i == 0 and s != 2 else "failed") for i in (0, 1) for s in (1, 2, 3)]


def test_rows_without_key_never_clash(spark):
    parsed = parse(statements(spark, ["INSERT INTO t VALUES (1,'a'),(1,'a');", "INSERT INTO t VALUES (1,'a');"]))
    outcomes = resolve(parsed, {"t": Target(NAMED)})
    assert {r.status for r in outcomes.collect()} == {"ok"}

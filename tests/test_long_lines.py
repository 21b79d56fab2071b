"""Lines and INSERT statements of any length, against the same scripts read line by line."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restitch import Segmentation, Target, parse, run_scripts, scan_scripts
from restitch.operators import long_inserts
from restitch.session import checkpoint
from restitch.sources import pieces


@pytest.fixture
def splits(spark):
    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield cut
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


def value(rng):
    word = "".join(rng.choice(["a", "b", "é", "𝄞", "''", "\\'", "\\\\", '"', ";", "),", "(", ")", ",", "--", "/*", "*/", "#", "`", " "]) for _ in range(rng.randrange(8)))
    return rng.choice([f"'{word}'", str(rng.randrange(1000)), "NULL", "'x'", "'),('", "x'6162'", '"a\'b"', "''"])


def insert(rng, rows, one_line, note=False):
    def tuple_():
        return "(" + ",".join(value(rng) for _ in range(3)) + ")" + (rng.choice(["", " /* n), */", "\n# it's (\n", "\n-- (a),\n"]) if note else "")

    gap = "," if one_line else ",\n"
    return "INSERT INTO `t` (a, b, c) VALUES " + gap.join(tuple_() for _ in range(rows)) + ";"


def script(rng):
    parts = []
    for _ in range(12):
        kind = rng.randrange(9)
        if kind < 4:
            parts.append(insert(rng, rng.randrange(1, 30), kind < 3, rng.random() < 0.3))
        elif kind == 4:
            parts.append("/* note " + "x), " * rng.randrange(40) + "*/ " + insert(rng, 5, True))
        elif kind == 5:
            parts.append("/*!40101 SET a */;\n-- " + "y), " * rng.randrange(30) + ";")
        elif kind == 6:
            parts.append("/* open " + "z), " * rng.randrange(30) + "\n still */ gone;\n")
        elif kind == 7:
            parts.append("UPDATE t SET a = '" + "w), " * rng.randrange(30) + "';")
        else:
            parts.append("BEGIN\n" + "s;\n" * rng.randrange(3) + "END")
    return rng.choice(["\n", "\r\n"]).join(parts) + rng.choice(["", "\n", "),"])


@pytest.mark.parametrize(("size", "keep_versioned"), [(70, False), (1000, True)])
def test_as_if_read_line_by_line(spark, splits, monkeypatch, tmp_path, size, keep_versioned):
    monkeypatch.setattr(pieces, "LONG_LINE", 60)
    monkeypatch.setattr(pieces, "KEPT", 12)
    paths = []
    for k in range(4):
        path = tmp_path / f"s{k}.sql"
        path.write_bytes((b"\xef\xbb\xbf" if k == 1 else b"") + script(random.Random(10 * k + size)).encode())
        paths.append(str(path))
    statements = checkpoint(Segmentation(scan_scripts(spark, paths), keep_versioned).statements())
    splits(size)
    fragments = pieces.scan_fragments(spark, paths)
    segmentation = Segmentation(pieces.lines_of_fragments(fragments), keep_versioned, max_statement_chars=90)
    columns = ["script_idx", "seq", "terminated", "chars_read", "chars_done"]

    def listed(df):
        return sorted(map(tuple, df.select(*columns).collect()))

    assert listed(segmentation.statements()) == listed(statements) == listed(segmentation.bounds())
    short = {(r.script_idx, r.seq): r.text for r in segmentation.statements().where("not too_long").collect()}
    texts = {(r.script_idx, r.seq): r.text for r in statements.collect()}
    assert short and all(texts[k] == t for k, t in short.items()) and len(short) < len(texts)

    def rows(parsed):
        found = parsed.select("script_idx", "seq", "kind", "table_name", "column_names", "row_no", "values").orderBy("script_idx", "seq", "row_no")
        return [(r[0], r[1], r[2], r[3], tuple(r[4] or ()), tuple(map(tuple, r[6] or ()))) for r in found.collect()]

    got, want = rows(long_inserts.parse_all(segmentation, fragments)), rows(parse(statements))
    assert [r for r in got if r[2] == "insert"] == [r for r in want if r[2] == "insert"]
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_one_line_over_many_ranges(spark, splits, tmp_path):
    path = tmp_path / "one.sql"
    path.write_text("INSERT INTO t VALUES " + ",".join(f"({k},'{'),(' * (k % 3)}')" for k in range(20_000)) + ";\n")
    found = []
    for size in (10_000, 50_000):
        splits(size)
        fragments = pieces.scan_fragments(spark, [str(path)])
        assert fragments.select("chunk").distinct().count() >= path.stat().st_size // size
        segmentation = Segmentation(pieces.lines_of_fragments(fragments))
        assert [(r.chars_read, r.terminated, r.too_long) for r in segmentation.statements().collect()] == [(path.stat().st_size - 1, True, True)]
        rows = long_inserts.parse_all(segmentation, fragments)
        found.append([r[0] for r in rows.orderBy("row_no").select(F.col("values")[0]["text"]).collect()])
        assert rows.where(F.col("values")[1]["text"] != F.repeat(F.lit("),("), (F.col("values")[0]["text"].cast("int") % 3))).isEmpty()
    assert found[0] == found[1] == [str(k) for k in range(20_000)]


BROKEN = [
    "INSERT INTO t VALUES (1),(2),,(3);",
    "INSERT INTO t VALUES (1)\n(2),\n(3);",
    "INSERT INTO t VALUES (1),(2",
    "INSERT INTO t VALUES (1),('a);",
    "INSERT INTO t VALUES (1),(2),;",
    "INSERT INTO t VALUES (1),(2) x;",
    "INSERT INTO t VALUES (1),\n(2)\n,(3)\n;",
    "INSERT INTO t VALUES\n;",
]


def test_broken_long_inserts(spark, tmp_path):
    paths = []
    for k, text in enumerate(BROKEN):
        path = tmp_path / f"{k}.sql"
        path.write_text(text)
        paths.append(str(path))
    lines = scan_scripts(spark, paths)

    def kinds(parsed):
        return sorted(tuple(r) for r in parsed.select("script_idx", "kind").distinct().collect())

    want = kinds(parse(Segmentation(lines).statements()))
    assert [kind for _, kind in want] == ["syntax"] * 6 + ["insert", "syntax"]
    assert kinds(long_inserts.parse_all(Segmentation(lines, max_statement_chars=1))) == want


def test_run_with_long_lines(spark, tmp_path):
    path = tmp_path / "run.sql"
    path.write_text("INSERT INTO t VALUES (1,'a'),(2,'b');\nINSERT INTO t VALUES (3,'c),('),(4,'d');\nINSERT INTO t VALUES (4,'e');\nCALL x;\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    found = []
    for k, options in enumerate(({}, {"long_lines": True}, {"long_lines": True, "max_statement_chars": 8})):
        run = run_scripts(spark, [str(path)], f"long_{k}", {"t": Target(schema, ["id"])}, **options)
        rows = sorted(tuple(r) for r in spark.table(f"long_{k}.t").collect())
        found.append((rows, sorted((r.seq, r.status, r.reason) for r in run.outcomes.collect())))
    assert found[0] == found[1] == found[2] and (3, "c),(") in found[0][0]

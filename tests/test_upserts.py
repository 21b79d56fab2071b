"""INSERT IGNORE, REPLACE and ON DUPLICATE KEY UPDATE mixed with plain INSERT, against a plain loop."""

import random

from pyspark.sql import types as T

from restitch import Target, parse, run_scripts, settle, stage, table_after

SCHEMA = T.StructType(
    [
        T.StructField("problem", T.IntegerType()),
        T.StructField("seq", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("values", T.LongType()),
    ]
)
CLAUSES = {
    "seq = VALUES(seq)": lambda old, new: (old[0], new[1], old[2], old[3]),
    "n = n + VALUES(n)": lambda old, new: (old[0], old[1], None if None in (old[2], new[2]) else old[2] + new[2], old[3]),
    "n = n + 5, `values` = VALUES(n)": lambda old, new: (old[0], old[1], None if old[2] is None else old[2] + 5, new[2]),
    "seq = 'a, ON DUPLICATE KEY UPDATE', n = NULL": lambda old, new: (old[0], "a, ON DUPLICATE KEY UPDATE", None, old[3]),
}


def literal(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


def dump(rng, n):
    texts, steps = [], []
    for _ in range(n):
        rows = [(rng.randrange(12), rng.choice(["x", "VALUES(seq)", "y"]), rng.choice([None, 1, 2, 3]), rng.randrange(9)) for _ in range(rng.randrange(1, 4))]
        kind = rng.choice(["INSERT", "INSERT", "INSERT IGNORE", "REPLACE", "UPDATE", "UPDATE", "UPDATE"])
        clause = rng.choice(list(CLAUSES)) if kind == "UPDATE" else None
        head = "INSERT" if clause else kind
        tail = f"\nON DUPLICATE KEY UPDATE {clause}" if clause else ""
        texts.append(f"{head} INTO t VALUES {', '.join('(' + ','.join(map(literal, r)) + ')' for r in rows)}{tail};")
        steps.append((kind, rows, clause))
    return texts, steps


def loop(steps, old):
    table, status = {r[0]: r for r in old}, []
    for kind, rows, clause in steps:
        keys = [r[0] for r in rows]
        fails = kind == "INSERT" and (len(set(keys)) < len(keys) or not table.keys().isdisjoint(keys))
        status.append("failed" if fails else "ok")
        for r in [] if fails else rows:
            if r[0] not in table or kind == "REPLACE":
                table[r[0]] = r
            elif kind == "UPDATE":
                table[r[0]] = CLAUSES[clause](table[r[0]], r)
    return table, status


def test_in_run_order(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        texts, steps = dump(rng, 45)
        old = [(k, "old", k, None) for k in (3, 4, 100)]
        lines = spark.createDataFrame([(0, k, t, False) for k, t in enumerate(texts, 1)], "script_idx long, seq long, text string, too_long boolean")
        target = Target(SCHEMA, ["problem"], spark.createDataFrame(old, SCHEMA))
        parsed = stage(parse(lines))
        settled = settle(parsed, {"t": target})
        want, status = loop(steps, old)
        assert [r.status for r in settled.outcomes.orderBy("seq").collect()] == status and "failed" in status
        assert {r[0]: tuple(r) for r in table_after(parsed, settled, "t", target).collect()} == want


def test_run_replaces_rows_of_a_table(spark, tmp_path):
    path = tmp_path / "d.sql"
    path.write_text("INSERT INTO t VALUES (1,'a',1,1),(2,'b',2,2);\nREPLACE INTO t VALUES (2,'c',3,3);\nINSERT IGNORE INTO t VALUES (1,'no',0,0),(4,'d',4,4);\n")
    for _ in range(2):
        run = run_scripts(spark, [str(path)], "upserts", {"t": Target(SCHEMA, ["problem"])})
        assert sorted(tuple(r) for r in spark.table("upserts.t").collect()) == [(1, "a", 1, 1), (2, "c", 3, 3), (4, "d", 4, 4)]
    assert [r.status for r in run.outcomes.orderBy("seq").collect()] == ["failed", "ok", "ok"]


def test_several_unique_keys_of_a_target(spark):
    texts = ["INSERT INTO t VALUES (1,'a',1,1);", "INSERT INTO t VALUES (2,'a',1,1);", "INSERT INTO t VALUES (2,'a',NULL,1),(3,'a',NULL,1);", "REPLACE INTO t VALUES (9,'z',9,9);"]
    lines = spark.createDataFrame([(0, k, t, False) for k, t in enumerate(texts, 1)], "script_idx long, seq long, text string, too_long boolean")
    settled = settle(stage(parse(lines)), {"t": Target(SCHEMA, ["problem"], unique=[["seq", "n"]])})
    assert [(r.status, r.reason) for r in settled.outcomes.orderBy("seq").collect()] == [("ok", None), ("failed", "duplicate_key"), ("ok", None), ("skipped", "unsupported")]

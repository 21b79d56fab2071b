"""Script files: line ends, splits, order, and the script list."""

import random

import pytest

from restitch import Segmentation, lines_from_column, manifest, scan_scripts
from tests.sequential import Walk
from tests.test_segment import SHAPES


@pytest.fixture
def small_splits(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "64")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_split_file_equals_sequential_walk(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    scripts = [rng.choices(SHAPES, k=80) for _ in range(6)]
    paths = []
    for i, lines in enumerate(scripts):
        path = tmp_path / f"s{i}.sql"
        bom = b"\xef\xbb\xbf" if i % 2 else b""
        path.write_bytes(bom + (end.join(lines) + end * (i % 3 > 0)).encode())
        paths.append(str(path))
    lines = scan_scripts(spark, paths)
    assert lines.select("script_idx", "chunk").distinct().count() > 2 * len(scripts)
    got = [[] for _ in scripts]
    for r in sorted(Segmentation(lines).statements().collect()):
        got[r.script_idx].append((r.text, r.terminated, r.chars_read))
    assert got == [Walk().run(lines).done for lines in scripts]


def test_list_order_repeats_and_sizes(spark, tmp_path):
    a, b = tmp_path / "a.sql", tmp_path / "b c.sql"
    a.write_bytes(b"x;\n")
    b.write_bytes(b"bad \xff byte;\ny;")
    paths = [str(b), str(a), str(b)]
    assert sorted(map(tuple, manifest(spark, paths).collect())) == [
        (0, str(b), 14), (1, str(a), 3), (2, str(b), 14),
    ]
    got = sorted((r.script_idx, r.line) for r in scan_scripts(spark, paths).collect())
    assert got == [(0, "bad � byte;"), (0, "y;"), (1, "x;"), (2, "bad � byte;"), (2, "y;")]


def test_names_are_not_patterns_and_spellings_are_one_file(spark, tmp_path):
    names = ["two[1].sql", "two1.sql", "a{b,c}*?.sql", "plus + 100%25.sql", "back\\slash.sql"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(f"{k};\n".encode() * (k + 1))
    paths = [str(tmp_path / name) for name in names]
    paths += [f"file:{paths[1]}", f"file://{paths[1]}"]
    want = [0, 1, 2, 3, 4, 1, 1]
    got = sorted((r.script_idx, r.line) for r in scan_scripts(spark, paths).collect())
    assert got == [(i, f"{k};") for i, k in enumerate(want) for _ in range(k + 1)]
    assert [r.file_bytes for r in sorted(manifest(spark, paths).collect())] == [3 * (k + 1) for k in want]


def test_missing_script_is_an_error(spark, tmp_path):
    for path in (tmp_path / "none.sql", tmp_path):
        with pytest.raises(FileNotFoundError):
            scan_scripts(spark, [str(path)])


def test_text_column(spark):
    df = spark.createDataFrame([(5, "a;\r\nb\rc;\n"), (6, ""), (7, "\n\n"), (8, "x\n\ny")], "id long, body string")
    rows = Segmentation(lines_from_column(df, "id", "body")).statements().orderBy("script_idx", "seq").collect()
    assert [(r.script_idx, r.seq, r.text, r.terminated) for r in rows] == [
        (5, 1, "a;", True), (5, 2, "b\nc;", True), (8, 1, "x\ny", False),
    ]


def test_a_long_list_is_read_in_few_tasks(spark, tmp_path):
    paths = [tmp_path / f"{k}.sql" for k in range(200)]
    for k, path in enumerate(paths):
        path.write_bytes(f"{k};\n".encode())
    group = "a-long-list"
    spark.sparkContext.setJobGroup(group, "")
    got = scan_scripts(spark, [str(p) for p in paths])
    spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.script_idx, r.line) for r in got.collect()) == [(k, f"{k};") for k in range(200)]

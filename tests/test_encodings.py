"""Scripts in UTF-16 and UTF-32, and packed ones."""

import bz2
import gzip
import random

import pytest

from restitch import Segmentation, scan_fragments, scan_scripts
from restitch.sources.scripts import number_lines
from tests.sequential import Walk
from tests.test_segment import SHAPES
from tests.test_sources import small_splits  # noqa: F401

MARKS = {
    "utf-16-le": b"\xff\xfe",
    "utf-16-be": b"\xfe\xff",
    "utf-32-le": b"\xff\xfe\x00\x00",
    "utf-32-be": b"\x00\x00\xfe\xff",
}
# In these the bytes of a line break turn up across two characters, or near it.
ODD = ["ੁ一x;", "਀਀;", "\u000bਊ਀", "aĀ਀b", "\U0001f600 \U0010ffff;", "ਅ਀" * 9]


def _lines(spark, paths):
    got = [[] for _ in paths]
    for r in sorted(number_lines(scan_scripts(spark, paths)).select("script_idx", "line_no", "line").collect()):
        got[r.script_idx].append(r.line)
    return got


@pytest.mark.parametrize(
    ("encoding", "end"), [*zip(MARKS, ["\n", "\r\n", "\r", "\n"], strict=True), ("utf-16-be", "\n")]
)
def test_marked_files_equal_sequential_walk(spark, tmp_path, small_splits, encoding, end):  # noqa: F811
    rng = random.Random(len(end))
    scripts = [rng.choices(SHAPES + ODD, k=40) for _ in range(4)]
    paths = []
    for i, lines in enumerate(scripts):
        path = tmp_path / f"s{i}.sql"
        text = end.join(lines) + end * (i % 2)
        # One among them is in UTF-8.
        path.write_bytes(text.encode() if i == 2 else MARKS[encoding] + text.encode(encoding))
        paths.append(str(path))
    assert _lines(spark, paths) == [(end.join(x) + end).split(end)[: len(x)] for x in scripts]
    got = [[] for _ in scripts]
    for r in sorted(Segmentation(scan_scripts(spark, paths)).statements().collect()):
        got[r.script_idx].append((r.text, r.terminated, r.chars_read))
    assert got == [Walk().run(lines).done for lines in scripts]


def test_units_that_make_no_character(spark, tmp_path):
    cases = {
        "pairs.sql": (b"\xff\xfe" + b"\x3d\xd8\x3d\xd8\x00\xde" + b"\x00\xde" + b"a\x00" + b"\x3d\xd8", ["�\U0001f600�a�"]),
        "cut.sql": (b"\xff\xfe" + "a\nb".encode("utf-16-le") + b"c", ["a", "b�"]),
        "wide.sql": (b"\x00\x00\xfe\xff" + b"\x00\x00\xd8\x00" + b"\x00\x11\x00\x00" + b"\x01\x00\x00\x41" + b"\x00\x00\x00A", ["�" * 3 + "A"]),
        "mark.sql": (b"\xff\xfe", []),
        "breaks.sql": (b"\xfe\xff" + "\n\r\r\n".encode("utf-16-be"), ["", "", ""]),
        "short.sql": (b"\xff", ["�"]),
        "empty.sql": (b"", []),
    }
    paths = []
    for name, (content, _) in cases.items():
        (tmp_path / name).write_bytes(content)
        paths.append(str(tmp_path / name))
    assert _lines(spark, paths) == [want for _, want in cases.values()]


def test_packed_scripts_in_several_splits(spark, tmp_path):
    rng = random.Random(5)
    lines = [f"{i}:{rng.getrandbits(256):x};" for i in range(60_000)]
    text = "\n".join(lines).encode()
    # The smallest blocks of bzip2, and members of gzip one behind the other.
    (tmp_path / "a.sql.bz2").write_bytes(bz2.compress(text, 1))
    half = len(text) // 2
    (tmp_path / "b.sql.gz").write_bytes(gzip.compress(text[:half]) + gzip.compress(text[half:]))
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "300000")
    try:
        scanned = scan_scripts(spark, [str(tmp_path / "a.sql.bz2"), str(tmp_path / "b.sql.gz")])
        assert scanned.where("script_idx = 0").select("chunk").distinct().count() > 3
        found = number_lines(scanned)
        got = {(r.script_idx, r.line_no, r.line) for r in found.select("script_idx", "line_no", "line").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(s, i, line) for s in (0, 1) for i, line in enumerate(lines, 1)}


def test_lines_of_any_length_ask_for_plain_files(spark, tmp_path):
    (tmp_path / "a.sql").write_bytes(b"\xff\xfea\x00")
    (tmp_path / "b.sql.gz").write_bytes(gzip.compress(b"a"))
    for name in ("a.sql", "b.sql.gz"):
        with pytest.raises(ValueError):
            scan_fragments(spark, [str(tmp_path / name)])

"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

from __spark_entry__ import entry
from catalog.oracles import ORACLES
from catalog.plans import QUERIES
from tests.check_queries import compare

SF_DIR = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    assert compare(spark, SF_DIR, name).startswith("ok")


def test_entry(spark):
    assert entry(spark).count() == 1500


def test_resume_statements_equal_a_plain_loop(spark):
    """What SQL settles in passes, here by one walk over the statements of a larger table."""
    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").collect()
    held: dict[tuple, list] = {}
    for r in rows:
        held.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    gone, want = set(), set()
    for place, keys in sorted(held.items()):
        if len(set(keys)) == len(keys) and gone.isdisjoint(keys):
            gone.update(keys)
            want.add(place)
    got = QUERIES["resume_statements"](spark, folder).collect()
    assert len(got) == len(held) and {(r.script_idx, r.seq) for r in got if r.taken} == want

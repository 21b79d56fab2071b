"""Sharding along a Hilbert curve, so that files hold narrow ranges of several metadata columns at once.

Each dimension is quantised to `2 ** BITS` equally filled bins: the bin of a value is the number of
rows with a smaller value, times `2 ** BITS`, div the number of rows that have a value. Bins grow with
the values, whatever their type, and a value that many rows share has one bin. What tells the bins
apart is the smallest value of each, at most `2 ** BITS` for a dimension. The bins are the
coordinates of a point; rows are put in order of the place of their point on the Hilbert curve
(Skilling 2004, worked out bit by bit in a fold), and the order is cut into runs. Neighbours on the
curve are neighbours in every dimension, so least and largest values of a file (`ranges`) let a reader
skip files by any of the dimensions.

Order has to be exact and no task may hold more than its part: rows are sorted by range over
all tasks, and the rows before a task come from one row per task. Rows of one point are in order of
checksum and id, and at last of a number of the row, so that no run of equal rows is left to one
task. The law is `rows` (counts of shards differ by one at most) or `bytes` (a shard begins with the
first row that has at least its share of all bytes before it, so its size is off by less than the
largest row's).

Null values of a dimension have bin 0 and count in no bin; a null text has no bytes and the checksum of none.
Repeated rows have places of their own, next to each other; which of fully equal rows comes
first doesn't show. Texts are read once, whole, for size and checksum. An empty table gives no rows; with
fewer rows than shards some shards are empty. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restitch.llm.common import checkpoint, text_of

SHARDS = 40
BITS = 5
LAWS = ("rows", "bytes")
# Bytes of a row beside its text.
ROW_BYTES = 16


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    """`rows` in the order of `by`, which must tell all rows apart, with `task` and `place` (from 0 in the task).

    Checkpointed, so both stay what they are.
    """
    done = checkpoint(rows.orderBy(*by)).withColumn("at", F.monotonically_increasing_id())
    return done.select("*", F.shiftright("at", 33).alias("task"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")).drop("at")


def _before(rows: DataFrame, amounts: Mapping[str, Column]) -> DataFrame:
    """For each task of `in_order` what the tasks before it hold: one row per task."""
    sums = rows.groupBy("task").agg(*[F.sum(c).cast("long").alias(name) for name, c in amounts.items()])
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("task", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).cast("long").alias(name) for name in amounts])


def _with_before(rows: DataFrame, amounts: Mapping[str, Column]) -> DataFrame:
    # One row per task of a job, and the driver knows all tasks of a job anyway.
    return rows.join(F.broadcast(checkpoint(_before(rows, amounts))), "task")


def bins(rows: DataFrame, dimension: str, bits: int = BITS) -> DataFrame:
    """`(bin, least)`: the bins that are in use, each with its smallest value; at most `2 ** bits` rows."""
    value = F.col(dimension).alias("value")
    counts = rows.where(F.col(dimension).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    ordered = _with_before(in_order(counts, "value"), {"before": F.col("n")})
    inside = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    total = ordered.agg(F.sum("n")).first()[0] or 1
    numbered = ordered.select("value", smaller.cast("long").alias("smaller"))
    bin_of = F.expr(f"int(smaller * {1 << bits} div {total}L)")
    return numbered.groupBy(bin_of.alias("bin")).agg(F.min("value").alias("least"))


def coordinate(dimension: str, edges: list[tuple[int, object]]) -> Column:
    """Bin of a value, given the smallest value of each bin."""
    found = F.lit(0)
    for number, least in sorted(edges, key=lambda e: e[0]):
        found = F.when(F.col(dimension) >= F.lit(least), number).otherwise(found)
    return found


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of a point with coordinates of `bits` bits each, as a long."""
    n = len(coordinates)
    if n * bits > 62:
        raise ValueError(f"{n} dimensions of {bits} bits do not fit a long")

    def steps(low: int) -> Column:
        return F.sequence(F.lit(bits - 1), F.lit(low), F.lit(-1))

    def swapped(k: int, bit: Column, x: Column) -> Column:
        """Turn or exchange the lower bits of dimensions 0 and k, as bit `bit` of dimension k says."""
        below = F.call_function("shiftleft", F.lit(1).cast("long"), bit) - 1
        one, other = x[0], x[k]
        is_set = F.call_function("shiftright", other, bit).bitwiseAND(F.lit(1)) == 1
        turned = one.bitwiseXOR(below)
        moved = one.bitwiseXOR(other).bitwiseAND(below)
        parts = []
        for i in range(n):
            if k == 0:
                parts.append(F.when(is_set, turned).otherwise(x[0]) if i == 0 else x[i])
            elif i == 0:
                parts.append(F.when(is_set, turned).otherwise(one.bitwiseXOR(moved)))
            elif i == k:
                parts.append(F.when(is_set, other).otherwise(other.bitwiseXOR(moved)))
            else:
                parts.append(x[i])
        return F.array(*parts)

    def one_bit(x: Column, bit: Column) -> Column:
        for k in range(n):
            x = F.transform(F.array(x), partial(swapped, k, bit))[0]
        return x

    def gray(x: Column) -> Column:
        parts = [x[0]]
        for i in range(1, n):
            parts.append(x[i].bitwiseXOR(parts[-1]))
        return F.array(*parts)

    def flips(x: Column) -> Column:
        return F.aggregate(
            steps(1),
            F.lit(0).cast("long"),
            lambda t, bit: F.when(
                F.call_function("shiftright", x[n - 1], bit).bitwiseAND(F.lit(1)) == 1,
                t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit) - 1),
            ).otherwise(t),
        )

    def woven(x: Column) -> Column:
        return F.aggregate(
            steps(0),
            F.lit(0).cast("long"),
            lambda out, bit: F.aggregate(
                x, out, lambda o, c: F.shiftleft(o, 1).bitwiseOR(F.call_function("shiftright", c, bit).bitwiseAND(F.lit(1)))
            ),
        )

    start = F.array(*[c.cast("long") for c in coordinates])
    turned = F.aggregate(steps(1), start, one_bit)
    coded = F.transform(F.array(turned), gray)
    flipped = F.transform(coded, lambda x: F.transform(F.array(flips(x)), lambda t: F.transform(x, lambda c: c.bitwiseXOR(t)))[0])
    return F.transform(flipped, woven)[0]


def measured(docs: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """`(doc_id, size, text_crc32, d0, d1, ...)`: what sharding looks at, with the text read once."""
    body = text_of("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        *[c.alias(f"d{k}") for k, c in enumerate(dimensions.values())],
    )


def shard_rows(rows: DataFrame, dimensions: int, n_shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """`rows` of `measured` with `curve` (the place of their point), `shard` and `slot` (from 0 in the shard)."""
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}, not {law!r}")
    rows = checkpoint(rows.withColumn("row_id", F.monotonically_increasing_id()))
    names = [f"d{k}" for k in range(dimensions)]
    edges = {d: [(r["bin"], r["least"]) for r in bins(rows, d, bits).collect()] for d in names}
    placed = rows.withColumns({f"c{k}": coordinate(d, edges[d]) for k, d in enumerate(names)})
    curve = hilbert_index([F.col(f"c{k}") for k in range(dimensions)], bits)
    placed = placed.withColumn("curve", curve).drop(*[f"c{k}" for k in range(dimensions)])
    ordered = in_order(placed, "curve", "text_crc32", "doc_id", "row_id")
    ordered = _with_before(ordered, {"rows_before": F.lit(1), "bytes_before": F.col("size")})
    at = F.col("rows_before") + F.col("place")
    if law == "rows":
        total = ordered.count()
        shard = F.expr(f"int((rows_before + place) * {n_shards} div {max(total, 1)}L)")
        first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
        cut = ordered.withColumn("shard", shard).withColumn("slot", at - first)
    else:
        inside = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        before = F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        total = ordered.agg(F.sum("size")).first()[0] or 1
        share = F.expr(f"int(bytes_before * {n_shards} div {total}L)")
        cut = ordered.withColumn("at", at).withColumn("bytes_before", before.cast("long"))
        cut = checkpoint(cut.withColumn("shard", share))
        firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))
        # One row per shard.
        cut = cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("at") - F.col("first")).drop("at", "first")
    return cut.drop("row_id", "task", "place", "rows_before", "bytes_before")


def shard_documents(
    docs: DataFrame, dimensions: Mapping[str, Column], n_shards: int = SHARDS, law: str = "rows", bits: int = BITS
) -> DataFrame:
    """`(doc_id, size, text_crc32, <dimensions>, curve, shard, slot)` for every row of `docs (doc_id, text, ...)`."""
    cut = shard_rows(measured(docs, dimensions), len(dimensions), n_shards, law, bits)
    return cut.withColumnsRenamed({f"d{k}": name for k, name in enumerate(dimensions)})


def ranges(sharded: DataFrame, *dimensions: str) -> DataFrame:
    """The index for pruning: rows, bytes, and least and largest value of each dimension by shard."""
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for f, name in ((F.min, "least"), (F.max, "largest"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *ends)


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, its rows in the order of their slots."""
    runs = sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot")
    runs.write.partitionBy("shard").parquet(path)

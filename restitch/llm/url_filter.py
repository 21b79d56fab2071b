"""URL filters: a blocked Bloom filter of listed canonical URLs, exact joins behind it, and host rules before it.

Built-in expressions only. A URL's host is what stands between the first `://` and the next
`/`, `?`, `#` or the end, with A-Z lower-cased; its path goes from there to `?`, `#` or the
end. Null, and URLs without `://`, have an empty host and path; no rule fits them and, as they
have no canonical form, they are allowed.

The canonical form drops scheme, query, fragment, a leading `www.` or `m.` of the host and
slashes at the end, so that the usual variants of an address meet in one.

The filter is a table of blocks of 256 bits (eight lanes of 32); a URL sets one bit in each
lane of one block. It says no for sure, so only possible hits go on to the exact join. Its
table is broadcast while it is below `BROADCAST_BLOCKS`; a larger one is joined by shuffle.

Of rules of equal length that fit, the one given first decides. Repeated rows get equal verdicts, a URL listed
twice counts once, an empty table gives no rows, and an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restitch.llm.common import whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LANES = 8
BITS_PER_URL = 16
# About 64 MB of filter, for some 17 million listed URLs.
BROADCAST_BLOCKS = 1 << 20

# The rules of the query, as (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One form for an address; null where there is no host."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+$", "")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in by_length]
    none = F.lit(None).cast("string")

    def chosen(values: list[str]) -> Column:
        return reduce(lambda other, pair: F.when(pair[0], pair[1]).otherwise(other), list(zip(fits, values, strict=True))[::-1], none)

    return chosen([h + p for _, h, p in by_length]), chosen([v for v, _, _ in by_length])


def _mask(digest: Column, lane: int) -> Column:
    """One bit out of 32, another choice for each lane."""
    bit = F.pmod(F.shiftrightunsigned(digest, 5 * lane), F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of `listed (canonical)`: `(block, lane0 .. lane7)`."""
    digest = F.xxhash64(F.lit(1), "canonical")
    masks = [_mask(digest, k).alias(f"lane{k}") for k in range(LANES)]
    lines = listed.select(block_of("canonical", blocks).alias("block"), *masks)
    return lines.groupBy("block").agg(*[F.bit_or(f"lane{k}").alias(f"lane{k}") for k in range(LANES)])


def block_of(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), column), F.lit(blocks))


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct canonical URLs of `urls (canonical)` that are in `listed (canonical)`."""
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_URL // (32 * LANES)))
    table = bloom_blocks(listed, blocks)
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    digest = F.xxhash64(F.lit(1), "canonical")
    asked = urls.where(F.col("canonical").isNotNull()).distinct().withColumn("block", block_of("canonical", blocks))
    all_set = reduce(lambda a, b: a & b, [F.col(f"lane{k}").bitwiseAND(_mask(digest, k)) != 0 for k in range(LANES)])
    possible = asked.join(table, "block").where(all_set).select("canonical")
    return possible.join(listed, "canonical", "left_semi")


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """Add host, path, canonical, rule, listed and verdict to each row, which is kept in `row`.

    `listed (canonical)` may repeat URLs and hold nulls. A rule's verdict goes before the
    list's; listed URLs are blocked, others allowed.
    """
    listed = listed.where(F.col("canonical").isNotNull()).select("canonical").distinct()
    parts = pages.select(whole(), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    hits = listed_hits(parts.select("canonical"), listed).withColumn("listed", F.lit(True))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return (
        parts.join(hits, "canonical", "left")
        .withColumn("listed", F.coalesce("listed", F.lit(False)))
        .withColumn("rule", name)
        .withColumn("verdict", F.coalesce(verdict, method))
    )

"""Queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restitch.llm import (
    chat,
    decontaminate,
    hilbert_shards,
    lexical_search,
    near_dedup,
    packing,
    pii,
    quality_rules,
    source_audit,
    toxicity,
    url_filter,
    warc,
    weak_quality,
)
from restitch.llm.common import checkpoint, scratch, table

# Hosts with these words in their names make up the list of op4.
LISTED_WORDS = ["casino", "adult", "bets", "spam"]
# Fixed value: what both turns of conversation -1 of op2 say.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    turns = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return chat.read_back(chat.segments(turns.unionByName(extra)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain: low quality, then toxic, then both at once, which the two before nearly tell."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    categories = {"low_quality": low, "toxic": toxic, "toxic_junk": low & toxic}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), categories)
    results = [c for c in judged.columns if c != "row"]
    return judged.select("row.doc_id", *results)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of pages on hosts named for what is not wanted."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of("url"), url_filter.path_of("url")
    listed = pages.where(host.rlike("|".join(LISTED_WORDS))).select(url_filter.canonical(host, path).alias("canonical"))
    judged = url_filter.judge_urls(pages, listed)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "listed")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = scratch(spark, "warc")
    warc.write_archives(pages, path)
    read = checkpoint(warc.read_archives(spark, path))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.resolve_revisits(read).select(*columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return weak_quality.classify_quality(docs).select("row.doc_id", "posterior", "score", "kept")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = pii.spans_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("row.doc_id", *[c for c in report.columns if c != "row"])


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"stats.{s}") for s in stats], "base_failed", "kept", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = {c: F.col(c) for c in ("lang", "source", "n_chars")}
    sharded = hilbert_shards.shard_documents(table(spark, sf_dir, "documents"), dimensions)
    nothing = F.lit(None).cast("int").alias("grown_shard")
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", nothing, "curve")


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_warc": op5_warc,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_lexical_search": op11_lexical_search,
    "op12_hilbert_shards": op12_hilbert_shards,
    "op13_source_audit": op13_source_audit,
}

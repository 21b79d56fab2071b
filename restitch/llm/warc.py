"""WARC archives: records are written with segments and chunked transfer framing, and read back whole.

Writing: one record per row `(page_id, url, payload)`. Of records with equal payloads of at
least `MIN_SHARED` bytes, that with the largest page_id is the response and the others revisit
it; rows that share that page_id are responses each. A response's block (HTTP head and chunked
payload) of more than `SEGMENT_BYTES` goes on in continuation records.

Reading: archives are gzipped files, so each is one stream, cut by Spark at every `WARC/1.`;
where that string stands inside a head (a URL, say) or a block, the blank line after the head
and Content-Length say so and the pieces are joined again. Segments are grouped by origin and ordered by number; numbers and total length are
verified, then the chunk framing is removed. Records that don't add up keep their row with
null payload and a text in `problem`.

Record ids are `urn:page:<page_id>:<row>`, so repeated rows and null ids stay apart. Null
payloads are empty; an empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SHARED = 1000
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 4096
FILE_RECORDS = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_MARK = "WARC/1."
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[at : at + size] for at in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk of another length than it says")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP head")
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    named = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + named.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(page_id: int | str | None, row: int, url: str | None, payload: bytes, holder: int | str | None) -> Iterator[bytes]:
    """The records of one page; `holder` is the page that it revisits."""
    name = "null" if page_id is None else page_id
    rid = f"<urn:page:{name}:{row}>"
    uri = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=response")]
    digest = ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}")
    if holder is not None:
        refers = [("WARC-Refers-To", f"<urn:page:{holder}>"), ("WARC-Profile", PROFILE)]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", rid), *common, digest, *refers], HEAD)
        return
    block = HEAD + chunked(payload)
    parts = [block[at : at + SEGMENT_BYTES] for at in range(0, len(block), SEGMENT_BYTES)]
    number = ("WARC-Segment-Number", 1 if len(parts) > 1 else None)
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", rid), *common, digest, number], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        fields = [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)]
        own = f"<urn:page:{name}:{row}:{k}>"
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), *fields], part)


def _encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for page_id, row, url, payload, holder in frame.itertuples(index=False):
            # The writer ends each row with a line feed, the last byte of a record.
            out += [r[:-1] for r in records(page_id, row, url, bytes(payload), holder)]
        yield pd.DataFrame({"record": out})


def write_archives(pages: DataFrame, path: str) -> None:
    """Write `pages (page_id, url, payload binary)` as gzipped archives below `path`."""
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.when(F.octet_length("payload") >= MIN_SHARED, F.sha1("payload")))
    shared = rows.where(F.col("digest").isNotNull()).groupBy("digest")
    holders = shared.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    row = F.monotonically_increasing_id().alias("row")
    encoded = (
        rows.join(holders, "digest", "left")
        # Ids pass through Python as text: pandas would turn a column with a null into floats.
        .select(F.col("page_id").cast("string"), row, "url", "payload", revisits.cast("string"))
        .mapInPandas(_encode, "record binary")
        .select(F.col("record").cast("string").alias("value"))
    )
    encoded.write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


PARSED = (
    "origin string, page_id string, record_type string, refers_to string, segment int, total long, "
    "payload_bytes long, payload_digest string, block binary, problem string"
)


def _whole_records(frames: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """Records out of the pieces that Spark cut at each mark, batch by batch."""
    file, held, need = None, b"", 0
    for frame in frames:
        out = []
        for name, piece in zip(frame["file"], frame["piece"], strict=True):
            if name != file:
                out += [held] if held else []
                file, held, need = name, b"", 0
                if not piece:  # what stands before the first mark
                    continue
            held = held + _MARK.encode() + piece if held else bytes(piece)
            if not need:
                head, ended, _ = held.partition(b"\r\n\r\n")
                if not ended:  # the mark stood inside the head
                    continue
                length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
                need = len(head) + 4 + (int(length[1]) if length else 0)
            if len(held) >= need:
                out.append(held)
                held, need = b"", 0
        yield out
    if held:
        yield [held]


def _page(urn: str | None) -> str | None:
    found = re.match(r"<urn:page:(-?\d+)", urn or "")
    return found[1] if found else None


def parse_record(raw: bytes) -> tuple:
    """One row of `PARSED`; the payload of a record in one piece is reduced to length and digest unless it is segmented."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        fields[key.strip().lower()] = value.strip()
    rid, kind = fields.get("warc-record-id"), fields.get("warc-type")
    block = rest[: int(fields.get("content-length", 0))]
    segment = int(fields["warc-segment-number"]) if "warc-segment-number" in fields else None
    total = int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None
    origin = fields.get("warc-segment-origin-id", rid)
    problem, size, digest = None, None, None
    if len(block) < int(fields.get("content-length", 0)):
        problem = "record is cut off"
    elif kind == "revisit":
        digest, block = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
    elif segment is None:
        size, digest, problem = _measured(block, fields.get("warc-payload-digest"))
        block = None
    else:
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (origin, _page(origin), kind, _page(fields.get("warc-refers-to")), segment, total, size, digest, block, problem)


def _measured(block: bytes, said: str | None) -> tuple[int | None, str | None, str | None]:
    try:
        payload = payload_of(block)
    except ValueError as wrong:
        return None, None, str(wrong)
    digest = hashlib.sha1(payload).hexdigest()
    if said and said.removeprefix("sha1:") != digest:
        return None, None, "payload of another digest than it says"
    return len(payload), digest, None


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    for raws in _whole_records(frames):
        frame = pd.DataFrame([parse_record(raw) for raw in raws], columns=names)
        whole = {c: "Int64" for c in ("total", "payload_bytes")} | {"segment": "Int32"}
        yield frame.astype(whole)


def reassemble(segments: list[dict], said: str | None) -> tuple[int | None, str | None, str | None]:
    """Length and digest of a payload in segments `{segment, total, block}`, or the problem with them."""
    ordered = sorted(segments, key=lambda s: s["segment"])
    if [s["segment"] for s in ordered] != list(range(1, len(ordered) + 1)):
        return None, None, "segments missing or repeated"
    block = b"".join(s["block"] for s in ordered)
    if ordered[-1]["total"] != len(block):
        return None, None, "segments of another total length than they say"
    return _measured(block, said)


def _join_segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [
            reassemble(list(parts), digest) if len(parts) and problem is None else (size, digest, problem)
            for parts, size, digest, problem in zip(
                frame["parts"], frame["payload_bytes"], frame["payload_digest"], frame["problem"], strict=True
            )
        ]
        size, digest, problem = zip(*rows, strict=True) if rows else ((), (), ())
        out = frame[["page_id", "record_type", "refers_to"]]
        sizes = pd.array([None if pd.isna(s) else int(s) for s in size], dtype="Int64")
        yield out.assign(payload_bytes=sizes, payload_digest=list(digest), problem=list(problem))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """`(page_id, record_type, refers_to, payload_bytes, payload_digest, problem)` of the records below `path`.

    Only segments of longer records are shuffled with their bytes.
    """
    pieces = spark.read.option("lineSep", _MARK).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    parsed = pieces.mapInPandas(_parse, PARSED)
    part = F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block"))
    first = lambda c: F.first(F.when(F.col("record_type") != "continuation", F.col(c)), ignorenulls=True).alias(c)
    grouped = parsed.groupBy("origin").agg(
        F.first("page_id").alias("page_id"),
        *[first(c) for c in ("record_type", "refers_to", "payload_bytes", "payload_digest")],
        F.first("problem", ignorenulls=True).alias("problem"),
        F.collect_list(part).alias("parts"),
    )
    columns = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "problem", "parts"]
    schema = "page_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, problem string"
    read = grouped.select(*columns).mapInPandas(_join_segments, schema)
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Give revisits the length of the payload that they refer to; a digest that differs is a problem."""
    responses = read.where((F.col("record_type") == "response") & F.col("page_id").isNotNull())
    held = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("held_bytes")
    )
    lost = F.col("refers_to").isNotNull() & F.col("held_bytes").isNull()
    return (
        read.join(held, ["refers_to", "payload_digest"], "left")
        .withColumn("payload_bytes", F.coalesce("payload_bytes", "held_bytes"))
        .withColumn("problem", F.when(lost, "revisited payload not found").otherwise(F.col("problem")))
        .drop("held_bytes")
    )

"""WARC archives: writing with segmented, chunk-framed records and reading them back.

Records are written by Spark's text sink, whose row separator is the WARC record separator,
and compressed, so archives land on any file system Spark knows, through its commit protocol;
a task begins a new archive after so many records that none holds over `archive_bytes`. A payload over
`segment_bytes` is split into a first record and continuation records; bodies are framed as
HTTP chunks. Reading streams through archive files by Content-Length, groups continuation
records by their origin's identifier, orders them by segment number, checks the total length
and the digest, and decodes the chunks.

Of rows with equal payloads of at least `min_bytes`, that with the smallest id is a response
and the others revisit it; rows that share this smallest id are all responses. A null payload
is empty. A null id revisits, unless all ids of its payload are null. Each row has a record
of its own, also when rows repeat. Payloads are kept whole, however long; an empty table gives
no records; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
CHUNK = 8192


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c := payload[i : i + CHUNK]), c) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        if len(out[-1]) != size or body[stop + 2 + size : stop + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = stop + 4 + size


def _head(lines: dict) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None).encode() + b"\r\n"


def _records(segment_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for record, key, url, payload, kind, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = payload or b""
                uri = f"<urn:x-record:{record}>"
                shared = {"WARC-Record-ID": uri, "WARC-Date": date, "WARC-Target-URI": (url or "urn:x-none").replace("\r", "%0D").replace("\n", "%0A"), "X-Source-Key": key, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "X-Payload-Length": len(payload)}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                if kind == "revisit":
                    more = {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Key": refers, "Content-Type": "application/http;msgtype=response", "Content-Length": len(http)}
                    out.append(_head(shared | more) + http)
                    continue
                block = http + chunked(payload)
                parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
                more = {"WARC-Type": "response", "WARC-Segment-Number": 1 if len(parts) > 1 else None, "Content-Type": "application/http;msgtype=response", "Content-Length": len(parts[0])}
                out.append(_head(shared | more) + parts[0])
                for k, part in enumerate(parts[1:], 2):
                    more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:x-record:{record}:{k}>", "WARC-Date": date, "WARC-Segment-Origin-ID": uri, "WARC-Segment-Number": k, "WARC-Segment-Total-Length": len(block) if k == len(parts) else None, "Content-Length": len(part)}
                    out.append(_head(more) + part)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload: Column, min_bytes: int = 0, segment_bytes: int = 64 << 10, archive_bytes: int = 512 << 20, date: str = "2024-01-01T00:00:00Z", partitions: int | None = None) -> None:
    """Writes one response or revisit record, with its continuations, for each row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    digested = rows.withColumn("digest", F.sha1("payload"))
    first = digested.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"))
    # only ids and digests meet here; payloads stay where they are and need no shuffle
    again = rows.select("id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).join(first, "digest").filter((F.col("n") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first")))
    again = again.groupBy("id", "digest").agg(F.min("first").alias("first"))
    kinds = digested.alias("d").join(again.alias("a"), F.col("d.id").eqNullSafe(F.col("a.id")) & (F.col("d.digest") == F.col("a.digest")), "left")
    kinds = kinds.select(F.monotonically_increasing_id().alias("record"), F.col("d.id").cast("string").alias("key"), "url", "payload", F.when(F.col("a.digest").isNull(), "response").otherwise("revisit").alias("kind"), F.col("first").cast("string").alias("refers"))
    if partitions:
        kinds = kinds.repartition(partitions)
    # the sink writes a string column's bytes as they are
    kinds.mapInArrow(_records(segment_bytes, date), "record binary").select(F.col("record").cast("string")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, archive_bytes // (segment_bytes + 1024))).text(path)


def parse_archive(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """The records of an archive, by Content-Length, one at a time."""
    f = io.BytesIO(data) if isinstance(data, bytes) else data
    while True:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, v = line.decode().rstrip("\r\n").split(": ", 1)
            head[k] = v
        size = int(head["Content-Length"])
        block = f.read(size)
        if len(block) != size or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
        yield head, block


RECORDS = "warc_type string, record_id string, origin string, segment int, total long, key string, refers string, digest string, payload_bytes long, url string, block binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["warc_type", "record_id", "origin", "segment", "total", "key", "refers", "digest", "payload_bytes", "url", "block"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for data in b.column(0):
            rows, held = [], 0
            raw = data.as_buffer().to_pybytes()
            for h, block in parse_archive(gzip.open(io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else raw):
                rows.append((h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]), number(h.get("WARC-Segment-Number")), number(h.get("WARC-Segment-Total-Length")), h.get("X-Source-Key"), h.get("X-Refers-To-Key"), h.get("WARC-Payload-Digest"), number(h.get("X-Payload-Length")), h.get("WARC-Target-URI"), block))
                held += len(block)
                if held > 4 << 20:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads, digests = [], []
        for kind, block, parts, total in zip(*(b.column(n).to_pylist() for n in ("warc_type", "block", "parts", "total")), strict=True):
            if parts is not None:
                block = b"".join(p["block"] for p in parts)
                if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"segments missing of {kind} record")
            if kind == "revisit":
                payloads.append(None)
                digests.append(None)
                continue
            head, _, body = block.partition(b"\r\n\r\n")
            if b"transfer-encoding: chunked" in head.lower():
                body = dechunked(body)
            payloads.append(body)
            digests.append("sha1:" + base32_sha1(body))
        keep = [b.column(n) for n in ("warc_type", "key", "refers", "digest", "payload_bytes", "url")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(payloads, pa.binary()), pa.array(digests, pa.string())], ["warc_type", "key", "refers", "digest", "payload_bytes", "url", "payload", "found_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows (warc_type, key, refers, digest, payload_bytes, url, payload); a revisit's payload is null.

    A record whose segments do not add up to the total length, or whose payload does not
    match its digest or length, ends the job with an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    records = files.mapInArrow(_parse, RECORDS)
    segment = "array<struct<segment:int,block:binary>>"
    whole = records.filter("segment is null").select("warc_type", "key", "refers", "digest", "payload_bytes", "url", "block", F.lit(None).cast(segment).alias("parts"), "total")
    parts = records.filter("segment is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("warc_type", "key", "refers", "digest", "payload_bytes", "url")),
    )
    joined = whole.unionByName(parts.withColumn("block", F.lit(None).cast("binary")).select(*whole.columns))
    out = joined.mapInArrow(_decode, "warc_type string, key string, refers string, digest string, payload_bytes long, url string, payload binary, found_digest string")
    sound = F.col("found_digest").isNull() | ((F.col("found_digest") == F.col("digest")) & (F.length("payload") == F.col("payload_bytes")))
    return out.withColumn("digest", F.when(sound, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest: "), "url")))).drop("found_digest")

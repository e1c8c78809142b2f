"""WARC archives: a deterministic sharded writer and a streaming reader.

Records are sorted by (id, payload digest, url), nulls last, and cut into shards where the running
sum of payload bytes passes multiples of the shard size, so that the files depend on the records
alone. A shard is written by one task as one gzip member per record and rolls to a new file when the
compressed size is reached. All headers, block and payload digests, and record ids are made anew. A payload
that was seen at an earlier record is written as a revisit: its block keeps the HTTP headers (with
the payload's length), not the payload. Files get their names as ``shards`` says.

Whole payloads are shuffled once, to their shard. What finds equal payloads and shard limits are digests
and lengths; digests are pre-aggregated before they meet, and a digest that a third of the rows
share is one row on one side of a join. The limits on the driver are one key per shard, at most
``MAX_SHARDS``; beyond that a shard grows.

Null payload: empty. Null url: no target URI. A null id sorts last and is read back as null. Of repeated
rows the first is the response and the others revisit it. An empty table gives no file and no row.
Columns other than id, url and payload are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common, shards
from tidewatch.operators import spread

SHARD_BYTES = 32 << 20
MAX_SHARDS = 20_000
# Compressed: below what a shard usually comes to, so that files are sized by it and not by the shard.
FILE_BYTES = 4 << 20
# About the bytes of a record's headers.
HEADER = 512
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("8a3c4f1e-5d0b-4c57-9f0e-2f6b7f1f3d55")


def order_key(df: DataFrame, row_id: str) -> Column:
    """A text that sorts as (id, digest, url) do; nulls last."""
    kind = df.schema[row_id].dataType.typeName()
    if kind in ("byte", "short", "integer", "long"):
        text = F.lpad(F.hex(F.col(row_id).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    else:
        text = F.col(row_id).cast("string")
    url = F.concat(F.col("url").isNull().cast("int").cast("string"), F.sha1(F.coalesce(F.col("url"), F.lit(""))))
    return F.concat_ws("|", F.coalesce(F.concat(F.lit("A"), text), F.lit("Z")), F.col("digest"), url)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def uri(url: str) -> str:
    """The url as header text: what is not printable ASCII is percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(row_id, url: str | None, payload: bytes, refers: tuple | None, copy: int, date: str = DATE) -> bytes:
    """One WARC record; ``refers`` (id, url) makes it a revisit."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    name = lambda i, u, n: f"<{uuid.uuid5(SPACE, json.dumps([i, u, digest, n])).urn}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {name(row_id, url, copy)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Row-Id: {json.dumps(row_id)}",
    ]
    if refers:
        head += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {name(*refers, 0)}",
            *([f"WARC-Refers-To-Target-URI: {uri(refers[1])}"] if refers[1] is not None else []),
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Row-Id: {json.dumps(refers[0])}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(
    df: DataFrame,
    path: str,
    row_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write every row as a record below ``path``; returns the manifest.

    Shards are cut at running sizes of payloads and headers, so that a run of empty payloads is cut too.
    """
    spark = df.sparkSession
    path = common.qualified(spark, path)
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(row_id).alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("key", order_key(rows, "id"))

    heads = common.stored(rows.select("key", "digest", "id", "url", (F.octet_length("payload") + HEADER).cast("long").alias("size")))
    first = heads.groupBy("digest").agg(F.min(F.struct("key", "id", "url")).alias("first"), F.count("*").alias("n"))
    later = (
        heads.join(first.where("n > 1"), "digest")
        .where("key != first.key")
        .select("key", F.struct("first.id", "first.url").alias("refers"))
        .distinct()
    )
    later = common.stored(later)

    total = heads.agg(F.sum("size")).first()[0] or 0
    step = max(shard_bytes, -(-total // MAX_SHARDS))
    with common.tidy(spark):
        upto = spread.running_totals(heads.select("key", "size"), [], [F.col("key")], {"upto": F.col("size")}, limit=1)
        cut = upto.groupBy(F.floor((F.col("upto") - F.col("size")) / step).alias("shard")).agg(F.min("key").alias("key"))
        limits = np.array(sorted(r.key for r in cut.collect()), dtype=object)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(limits, keys.to_numpy(object), side="right") - 1, 0)).astype("int32")

    # Each record meets the note that makes it a revisit in its own shard.
    nothing = F.lit(None)
    notes = later.select(
        "key", nothing.cast(rows.schema["id"].dataType).alias("id"), nothing.cast("string").alias("url"),
        nothing.cast("binary").alias("payload"), "refers",
    )
    plain = rows.select("key", "id", "url", "payload", nothing.cast(later.schema["refers"].dataType).alias("refers"))
    dealt = plain.unionByName(notes).withColumn("shard", shard_of("key"))
    dealt = dealt.repartitionById(max(1, len(limits)), F.col("shard"))
    dealt = dealt.sortWithinPartitions("key", F.col("payload").isNotNull())

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = key = refers = None
        copy = 0
        for batch in batches:
            for row in (r for i in range(0, batch.num_rows, 64) for r in batch.slice(i, 64).to_pylist()):
                if writer is None:
                    writer = shards.Writer(path, row["shard"], ".warc.gz")
                if row["key"] != key:
                    key, refers, copy = row["key"], None, 0
                if row["payload"] is None:
                    refers = (row["refers"]["id"], row["refers"]["url"])
                    continue
                to = refers or ((row["id"], row["url"]) if copy else None)
                data = record(row["id"], row["url"], row["payload"], to, copy)
                copy += 1
                if not writer.size:
                    writer.write(gzip.compress(info(), 6, mtime=0), 0)
                writer.write(gzip.compress(data, 6, mtime=0))
                if writer.size >= file_bytes:
                    writer.close()
        if writer is not None:
            yield writer.batch()

    return shards.commit(dealt.mapInArrow(save, shards.ROWS), path)


def info(date: str = DATE) -> bytes:
    body = b"software: tidewatch\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid5(SPACE, 'warcinfo').urn}>\r\n"
    head += f"WARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    left = b""
    while left or (left := stream.read(chunk)):
        member, parts = zlib.decompressobj(31), []
        while True:
            parts.append(member.decompress(left))
            if member.eof:
                left = member.unused_data
                break
            if not (left := stream.read(chunk)):
                raise ValueError("a gzip member is cut off")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; raises if lengths or digests don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong length")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong block digest")
    return fields, block


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record below ``path``: row_id and refers_to (as JSON), url, record_type, digest, size."""
    path = common.qualified(spark, path)
    names = ["row_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    keep = len(names) - (not payloads)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = common.file_system(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{root}/{file}") as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (
                            len(body) != size or base32(hashlib.sha1(body).hexdigest()) != digest
                        ):
                            raise ValueError(f"{fields['WARC-Record-ID']}: wrong payload")
                        row = (fields["X-Row-Id"], fields.get("WARC-Target-URI"), fields["WARC-Type"], digest, size,
                               fields.get("X-Refers-To-Row-Id"), body)
                        rows.append(row[:keep])
                        held += len(body) * payloads + 200
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in range(keep)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[:keep]
        )

    files = shards.manifest(spark, path).select("file")
    schema = "row_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string"
    return files.repartition(max(1, min(files.count(), MAX_SHARDS)), "file").mapInArrow(
        scan, schema + ", payload binary" * payloads
    )


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = common.scratch(spark, "warc")
    write(common.table(spark, folder, "pages"), path)
    return read(spark, path).select(
        F.col("row_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

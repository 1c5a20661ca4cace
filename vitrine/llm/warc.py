"""WARC archives with an index first and coalesced range reads.

Write: one gzip member per record, files rolled at a size, in the shared
folder. A page whose payload (UTF-8 html, null: empty) equals that of another
page is stored once, as the response of the largest page_id; the others are
revisit records naming it. Every record gets an index row (file, offset,
length, url, digest). A task writes files under names of its own attempt and
the index lists only attempts that ended well, so a lost executor leaves at
most unlisted files.

Read: the selected index rows are dealt by (file, offset range), sorted, and
neighbours with small gaps are fetched in one range read, then each record is
unpacked, parsed and, for responses, its digest recomputed.

Files are opened with pyarrow.fs, so the folder may be any store it knows
(local or mounted paths, s3, gs, hdfs).

Defined cases: among rows of equal payload and the same largest page_id all
are responses; a null page_id is smaller than any number (alone it is a
response); payloads under ``min_bytes`` are all responses; a null url has no
target header; control characters in a url are percent-encoded; an empty
table gives no archive and an empty result. Only page_id, url and html are
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import materialise, shared_path, shuffle_width

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI (a bare path is local)."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri.split("/")[0] else f"file://{uri}")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    value = record_id[len("<urn:page:"):-1] if record_id else "null"
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: WARC headers, then the HTTP response (headers only for a revisit)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers, payload and full payload length of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
    return {"page_id": _page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "record_type": fields["WARC-Type"], "refers_to": _page_of(fields.get("WARC-Refers-To")),
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": size,
            "payload": payload if fields["WARC-Type"] == "response" else None}


def _write(batches, folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    fs, root = open_folder(folder)
    out, name, offset = None, "", 0
    try:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or offset >= roll:
                    if out is not None:
                        out.close()
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                kind = "response" if r["refers_to"] is None else "revisit"
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                plain = record(r["page_id"], r["url"], r["payload"], digest, kind, r["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(plain) + packer.flush()
                out.write(data)
                rows.append((r["page_id"], r["url"], name, offset, len(data), digest, kind))
                offset += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
                     (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                    ["page_id", "url", "file", "offset", "length", "digest", "record_type"])
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write every page as a WARC record under ``folder``; returns the index
    (written beside the archives)."""
    fs, root = open_folder(folder)
    fs.create_dir(root, recursive=True)
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("sha", F.sha1("payload"))
    long_enough = F.octet_length("payload") >= min_bytes
    first = materialise(page.filter(long_enough).groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("sha", "top"), "warc-first")
    roles = page.join(first, "sha", "left").withColumn(
        "refers_to", F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")))
    index = roles.select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(
        partial(_write, folder=folder, roll=roll_bytes), INDEX)
    return materialise(index, "warc-index")


def _read(batches, folder: str, gap: int, most: int) -> Iterator[pa.RecordBatch]:
    fs, root = open_folder(folder)
    run: list[tuple[str, int, int]] = []
    name, source = None, None

    def fetch():
        nonlocal name, source
        if run[0][0] != name:
            if source is not None:
                source.close()
            name = run[0][0]
            source = fs.open_input_file(f"{root}/{name}")
        start = run[0][1]
        data = source.read_at(run[-1][1] + run[-1][2] - start, start)
        rows = []
        for _, at, size in run:
            r = parse(zlib.decompress(data[at - start:at - start + size], 31))
            if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != r["digest"]:
                raise ValueError(f"digest mismatch in {name} at {at}")
            rows.append(r)
        return pa.RecordBatch.from_pylist(rows, pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]))

    for batch in batches:
        files = batch.column("file").to_pylist()
        for item in zip(files, batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if run and (item[0] != run[0][0] or item[1] - run[-1][1] - run[-1][2] > gap
                        or item[1] + item[2] - run[0][1] > most):
                yield fetch()
                run = []
            run.append(item)
    if run:
        yield fetch()
    if source is not None:
        source.close()


def read_records(index: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """Records of the given index rows, read back from the archives."""
    part = (F.col("offset") / read_bytes).cast("long")
    # a fixed width: index rows are small, the bytes they name are not
    dealt = index.select("file", "offset", "length", part.alias("part")) \
        .repartition(shuffle_width(index.sparkSession), "file", "part").sortWithinPartitions("file", "offset").drop("part")
    return dealt.mapInArrow(partial(_read, folder=folder, gap=gap_bytes, most=read_bytes), RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, min_bytes=0)
    return read_records(index, folder).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")

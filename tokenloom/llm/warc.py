"""Operator 5: WARC records in seekable Zstandard bundles.

A bundle is the exact content of one ``.warc.zst`` file: independent zstd
frames of about ``FRAME_BYTES`` of whole records, then a footer seek table in
a skippable frame (the public zstd seekable format), so any zstd tool reads it
front to back and a reader that knows a record's frame decompresses only that
frame.  The index maps each record to (bundle, frame, offset in the frame,
length).  Bundles are closed at ``BUNDLE_BYTES``, so a task holds one frame
and one bundle whatever the table's size.  They are stored through Spark's
writer (one row per bundle), which commits whole tasks and reaches any store
that Spark reaches; ``export_bundles`` writes them out as files.

Of records with equal payloads of at least ``revisit_from`` bytes, that with
the smallest page_id is the response and the others are revisits without
payload.  Only (digest, page_id) is aggregated, map-side combined, so a hot
payload costs one row per task.

Defined results: null html counts as the empty payload; a null page_id sorts
after all others; rows that repeat the smallest page_id of a payload are all
responses (a record never revisits its own id); a null URL leaves out
WARC-Target-URI; control characters in a URL are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise, text_slices

FRAME_BYTES = 256 << 10     # raw bytes after which a frame is closed
BUNDLE_BYTES = 8 << 20      # compressed bytes after which a bundle is closed
LEVEL = 3
# The seekable format's magic numbers, WARC's revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-31T00:00:00Z"

ENTRY = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
BUNDLE_SCHEMA = "bundle string, content binary, entries array<struct<page_id:long,frame:int,offset:long,length:long>>"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload); a revisit's payload is empty, its length is in ``payload-length``."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length does not match")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    fields["payload-length"] = http.rpartition(b"Content-Length: ")[2].decode()
    return fields, payload


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self) -> None:
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.reset()

    def reset(self) -> None:
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.entries: list[dict] = []
        self.open: list[bytes] = []
        self.raw = self.stored = 0

    def add(self, page_id, record: bytes) -> None:
        self.entries.append({"page_id": page_id, "frame": len(self.frames), "offset": self.raw, "length": len(record)})
        self.open.append(record)
        self.raw += len(record)
        if self.raw >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.codec.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.raw))
            self.stored += len(frame)
            self.open, self.raw = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        rows = b"".join(struct.pack("<II", *t) for t in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(rows) + len(footer)) + rows + footer


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, stored size, raw size) of each frame, read from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", content, len(content) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    base = len(content) - 9 - n * width
    for i in range(n):
        stored, raw = struct.unpack_from("<II", content, base + i * width)
        out.append((at, stored, raw))
        at += stored
    return out


def read_frame(content: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    start, stored, raw = table[frame]
    data = zstandard.ZstdDecompressor().decompress(content[start:start + stored], max_output_size=max(raw, 1))
    if len(data) != raw:
        raise ValueError("frame length does not match")
    return data


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    writer, number = BundleWriter(), 0

    def bundle():
        content = writer.finish()
        row = pa.RecordBatch.from_arrays(
            [pa.array([f"part-{part:06d}-{number:06d}"]), pa.array([content], pa.binary()),
             pa.array([writer.entries], pa.list_(ENTRY))], names=["bundle", "content", "entries"])
        writer.reset()
        return row

    for batch in batches:
        for piece in text_slices(batch, "html"):
            for page_id, url, page, digest, revisit, to in zip(*(c.to_pylist() for c in piece.columns)):
                payload = page.encode("utf-8", "surrogatepass")
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                writer.add(page_id, write_record(page_id, url, payload, b32, revisit, to))
                if writer.stored >= BUNDLE_BYTES:
                    yield bundle()
                    number += 1
    if writer.entries:
        yield bundle()


def write_bundles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages; returns the reread bundle table (bundle, content, entries)."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Payloads that occur more than once, with the id that answers for them.
    firsts = materialise(
        p.where(F.octet_length("html") >= revisit_from).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.col("digest").alias("d"), "first"), "warc-responses")
    big = F.octet_length("html") >= revisit_from
    revisit = F.coalesce(big & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    typed = p.join(firsts, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"),
        F.when(revisit, F.col("first")).alias("refers_to"))
    return materialise(typed.mapInArrow(_pack, BUNDLE_SCHEMA), "warc-bundles")


READ_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
               "bundle string, frame int, frame_offset long, url string, payload binary")


def _unpack(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(),
             pa.string(), pa.binary()]
    for batch in batches:
        for i in range(batch.num_rows):
            content = batch.column("content")[i].as_py()
            table, rows, current, data = seek_table(content), [], -1, b""
            for e in batch.column("entries")[i].as_py():
                if e["frame"] != current:
                    current, data = e["frame"], read_frame(content, table, e["frame"])
                head, payload = read_record(data[e["offset"]:e["offset"] + e["length"]])
                stated, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                        raise ValueError("payload digest does not match")
                    size = len(payload)
                else:
                    size = int(head["payload-length"])
                ids = [head[k].removeprefix("<urn:page:").removesuffix(">") if k in head else ""
                       for k in ("warc-record-id", "warc-refers-to")]
                rows.append((int(ids[0]) if ids[0] else None, size, stated, kind, int(ids[1]) if ids[1] else None,
                             batch.column("bundle")[i].as_py(), e["frame"], e["offset"],
                             head.get("warc-target-uri"), payload if with_payload and kind == "response" else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def read_bundles(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record, parsed from its frame; digests are checked."""
    return bundles.select("bundle", "content", "entries") \
        .mapInArrow(lambda it: _unpack(it, with_payload), READ_SCHEMA)


def lookup(bundles: DataFrame, page_ids: list[int]) -> DataFrame:
    """Records of a stated id list: only their frames are decompressed."""
    hits = F.filter("entries", lambda e: e["page_id"].isin(page_ids))
    return read_bundles(bundles.select("bundle", "content", hits.alias("entries")).where(F.size("entries") > 0))


def export_bundles(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as ``folder/<bundle>.warc.zst`` from the executors;
    ``folder`` must be a mount that all of them share.  Returns name and bytes."""
    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist()):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.tmp", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.tmp", path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64())],
                                                 names=["path", "bytes"])
    return bundles.select("bundle", "content").mapInArrow(run, "path string, bytes long")


def op5(pages: DataFrame) -> DataFrame:
    return read_bundles(write_bundles(pages), with_payload=False) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                "bundle", "frame", "frame_offset")


"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; frames are laid end to end and followed by a footer, the seek
table of the public seekable format: a skippable frame that lists the compressed and decompressed size of each frame.
An index maps record ids to (bundle, frame, offset within the decompressed frame, length), so that one record is read
by seeking to one frame. A bundle is a value of a binary column; a row per bundle holds its index beside it.

Payloads that occur more than once are written in full once; the others become revisit records.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import stage, tidy

#: Decompressed bytes after which a frame is closed, and compressed bytes after which a bundle is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 16 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

#: The date of records whose time of capture isn't known.
NO_DATE = "1970-01-01T00:00:00Z"

_RECORDS = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
BUNDLE_SCHEMA = "bundle binary, records array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The footer for frames of the given (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer; ValueError if there is none."""
    if len(bundle) < 17:
        raise ValueError("not a seekable bundle")
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * width, []
    start = 0
    for i in range(n):
        c, d = struct.unpack_from("<II", bundle, at + i * width)
        out.append((start, c, d))
        start += c
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record, by decompressing its frame alone."""
    start, c, d = read_seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + c], max_output_size=d)[offset : offset + length]


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def format_record(page_id: int | None, url: str, payload: bytes, sha1: str, refers_to: int | None, date: str = NO_DATE) -> bytes:
    """A response record with its payload, or a revisit record without it that names the record it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (with the version under '') and the body of one record; ValueError if it is malformed."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {"": lines[0]} | {k: v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


class BundleWriter:
    """Collects records into frames and frames into a bundle."""

    def __init__(self) -> None:
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.open_bytes, self.bytes, self.index = [], 0, 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append({"record_id": record_id(page_id), "page_id": page_id, "frame": len(self.frames), "offset": self.open_bytes, "length": len(record)})
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.sizes.append((len(frame), self.open_bytes))
            self.frames.append(frame)
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> tuple[bytes, list[dict]]:
        self.close_frame()
        out = b"".join(self.frames) + seek_table(self.sizes), self.index
        self.clear()
        return out


def _writer(date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(writer: BundleWriter) -> pa.RecordBatch:
            bundle, index = writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([bundle], pa.binary()), pa.array([index], _RECORDS)], ["bundle", "records"])

        writer = BundleWriter()
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                payload = (html.as_py() or "").encode()
                ident = page.as_py()
                writer.add(ident, format_record(ident, url.as_py(), payload, hashlib.sha1(payload).hexdigest(), refers.as_py(), date))
                if writer.bytes >= BUNDLE_BYTES:
                    yield out(writer)
        if writer.index:
            yield out(writer)

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_sha1"]
    for batch in batches:
        for bundle, records in zip(batch.column("bundle"), batch.column("records")):
            data, rows, frame, opened = bundle.as_py(), [], -1, b""
            table = read_seek_table(data)
            unpack = zstandard.ZstdDecompressor()
            for r in records.as_py():
                if r["frame"] != frame:
                    frame = r["frame"]
                    start, c, d = table[frame]
                    opened = unpack.decompress(data[start : start + c], max_output_size=d)
                fields, body = parse_record(opened[r["offset"] : r["offset"] + r["length"]])
                kind = fields["WARC-Type"]
                refers = fields.get("WARC-Refers-To", "<urn:page:>")[len("<urn:page:") : -1]
                rows.append((r["page_id"], int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(refers) if refers else None, hashlib.sha1(body).hexdigest() if kind == "response" else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def plan_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of equal payloads of least_bytes or more, else null.

    Digests are counted with partial aggregation and only those that occur twice are joined back, so a payload that a
    third of all rows share is reduced before the shuffle; its rows on the probing side may be split by the join. Pages with
    smaller payloads aren't shuffled.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.when(F.length(body) >= least_bytes, F.sha2(body, 256)).alias("_sha"))
    groups = rows.where("_sha is not null").groupBy("_sha").agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    refers = F.when(F.col("page_id") != F.col("_keeper"), F.col("_keeper"))
    large = rows.where("_sha is not null").join(groups, "_sha", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    return large.union(rows.where("_sha is null").select("page_id", "url", "html", F.lit(None).cast(large.schema["refers_to"].dataType)))


def write_bundles(pages: DataFrame, least_bytes: int = 1000, date: str = NO_DATE) -> DataFrame:
    """Bundles with their record index, one row per bundle. A task writes bundles of at most about BUNDLE_BYTES.

    A null html is an empty payload, a null url an empty one; rows with the same page_id become records of the same id;
    rows whose page_id is null are written, but never refer to another. Long payloads are stored whole; an empty table has no
    bundles. Other columns are ignored, whatever their names. date is the WARC-Date of all records.
    """
    return plan_revisits(pages, least_bytes).mapInArrow(tidy(_writer(date)), BUNDLE_SCHEMA)


def write_files(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as a file of its own, named by its digest, into a folder that driver and executors have mounted, and
    returns path, bytes and records. A file appears under its name when it is whole, so a task that runs again does no harm;
    an empty table writes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for i, bundle in enumerate(batch.column("bundle")):
                data = bundle.as_py()
                path = os.path.join(folder, f"{hashlib.sha256(data).hexdigest()}.warc.zst")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)], pa.int64()), batch.column("records").slice(i, 1)], ["path", "bytes", "records"])

    return bundles.mapInArrow(tidy(run), f"path string, bytes bigint, {BUNDLE_SCHEMA.partition(', ')[2]}")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The bundles of a folder, with an index made from their records; a file that isn't a bundle fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, index = content.as_py(), []
                unpack = zstandard.ZstdDecompressor()
                for frame, (start, c, d) in enumerate(read_seek_table(data)):
                    opened, at = unpack.decompress(data[start : start + c], max_output_size=d), 0
                    while at < d:
                        head = opened.index(b"\r\n\r\n", at) + 4
                        fields = dict(x.split(": ", 1) for x in opened[at : head - 4].decode().split("\r\n")[1:])
                        length = head - at + int(fields["Content-Length"]) + 4
                        page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                        index.append({"record_id": fields["WARC-Record-ID"], "page_id": int(page) if page else None, "frame": frame, "offset": at, "length": length})
                        at += length
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([index], _RECORDS)], ["bundle", "records"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return files.mapInArrow(tidy(run), BUNDLE_SCHEMA)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row per record, repeated ones each; an empty table gives none, a bundle that is cut off fails: page_id, payload_bytes, payload_digest, record_type, refers_to, and stored_sha1, the digest of
    the body as it was read (null for revisits)."""
    return bundles.mapInArrow(tidy(_read), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, stored_sha1 string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes all pages to bundles in the shared folder and reads them back. Nulls, empty and long payloads, ties, repeated rows,
    empty tables and other columns are as in write_bundles."""
    return read_bundles(stage(write_bundles(pages), "warc"))

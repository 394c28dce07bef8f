"""WARC archives as seekable Zstandard bundles.

Each task writes its records into bundles: independent Zstandard frames of some hundred kilobytes of whole records,
and a last, skippable frame with the seek table (the public seekable format). The index maps each record to its
bundle, frame, and offset inside the frame, so one record costs one frame to read. Records with equal payloads are
revisits of the one with the smallest id.

Bundle names are new in every task attempt and the index keeps those of successful attempts only, so a lost
executor leaves at most an unnamed file behind.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactframe.llm.store import shared_folder, small_batches, written

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 32 << 20
LEVEL = 3
_NAMES = uuid.UUID("5f8b3f0e-27c9-4d8c-9a56-0f7d1a1c2b3d")
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_bytes int, offset int, length int"


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page {page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    block = _HEAD if revisit else _HEAD + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:  # a URI holds no white space or control characters
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if page is not None:
        fields.append(("X-Page-ID", str(page)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and payload of the record at ``at``, and where the next one begins."""
    body = data.index(b"\r\n\r\n", at) + 4
    version, *lines = data[at:body - 4].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    end = body + int(fields["Content-Length"])
    block = data[body:end]
    return fields, block[block.index(b"\r\n\r\n") + 4:], end + 4


class BundleWriter:
    """Collects whole records into frames and frames into bundles; ``flush`` ends the open bundle."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._new()

    def _new(self) -> None:
        self.frames: list[tuple[int, int]] = []
        self.out, self.open, self.rows = bytearray(), bytearray(), []
        self.done: list[tuple] = []
        self.name = f"{uuid.uuid4().hex}.warc.zst"

    def add(self, page: int | None, data: bytes) -> list[tuple]:
        """Index rows of the bundle that this record ended, if it did."""
        self.rows.append((page, len(self.frames), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self._end_frame()
        return self.flush() if len(self.out) >= self.bundle_bytes else []

    def _end_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        for page, frame, offset, length in self.rows:
            self.done.append((page, record_id(page), f"{self.folder}/{self.name}", frame, len(self.out), len(packed), offset, length))
        self.frames.append((len(packed), len(self.open)))
        self.out += packed
        self.open, self.rows = bytearray(), []

    def flush(self) -> list[tuple]:
        if self.open:
            self._end_frame()
        if not self.frames:
            return []
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out += struct.pack("<II", SKIPPABLE, len(table)) + table
        with self.files.open_output_stream(f"{self.root}/{self.name}", compression=None) as f:
            f.write(bytes(self.out))
        done = self.done
        self._new()
        return done


def seek_table(f: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Start, packed and unpacked size of each frame, from the last bytes of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - entry * count)
    raw, out, start = f.read(entry * count), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, entry * i)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(f: pa.NativeFile, start: int, packed: int, plain: int = 0) -> bytes:
    f.seek(start)
    return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)


def read_record(bundle: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record through the seek table: header fields and payload."""
    files, path = fs.FileSystem.from_uri(bundle)
    with files.open_input_file(path) as f:
        return parse(read_frame(f, *seek_table(f)[frame]), offset)[:2]


def _rows_to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in INDEX.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 100, date: str = "1970-01-01T00:00:00Z",
                   frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the index, one row per record.

    A null html is an empty payload, a null url leaves its field out. Payloads of at least ``least_revisit`` bytes that
    are equal (by SHA-256) have one response: every row of the smallest id (nulls last); the others are revisits.
    Extra columns are ignored; an empty table writes no bundle. The index is itself a written table.
    """
    small_batches(pages.sparkSession)
    folder = folder or shared_folder(pages.sparkSession, "warc")
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col("page_id").cast("bigint"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= least_revisit)
    copies = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    known = rows.join(copies, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            done = []
            for page, url, html, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done += out.add(page, record(page, url, html, digest, first, revisit, date))
            yield _rows_to_batch(done)
        yield _rows_to_batch(out.flush())

    plain = known.select("page_id", "url", F.col("html").cast("binary"), "digest", "first", "revisit")
    return written(plain.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names: ``page_id``, ``record_type``, ``digest``, ``bytes``, ``refers_to``.

    Digest and size are those of the payload found in the bundle; for a revisit the digest is the one that its header
    names and the size is null. A payload that does not have its header's digest fails the job.
    """
    bundles = index.select("bundle").distinct()
    count = max(1, bundles.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(bundle)
                with files.open_input_file(path) as f:
                    for frame in seek_table(f):
                        data, at, rows = read_frame(f, *frame), 0, []
                        while at < len(data):
                            fields, payload, at = parse(data, at)
                            named, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                            if kind == "response" and hashlib.sha256(payload).hexdigest() != named:
                                raise ValueError(f"payload of {fields['WARC-Record-ID']} in {bundle} is damaged")
                            number = lambda k, fields=fields: int(fields[k]) if k in fields else None
                            rows.append((number("X-Page-ID"), kind, named, len(payload) if kind == "response" else None, number("X-Refers-To-Page-ID")))
                        page, kind, digest, size, refers = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(page, pa.int64()), pa.array(kind, pa.string()), pa.array(digest, pa.string()), pa.array(size, pa.int64()), pa.array(refers, pa.int64())],
                            names=["page_id", "record_type", "digest", "bytes", "refers_to"])

    return bundles.repartition(count).mapInArrow(run, "page_id bigint, record_type string, digest string, bytes bigint, refers_to bigint")


def resolve(records: DataFrame) -> DataFrame:
    """Gives each revisit the size of the payload that it refers to, taken from that response."""
    found = records.where("record_type = 'response'").groupBy("digest").agg(F.max("bytes").alias("full"))
    revisits = records.where("record_type = 'revisit'").join(found, "digest").withColumn("bytes", F.col("full")).drop("full")
    return records.where("record_type = 'response'").unionByName(revisits)

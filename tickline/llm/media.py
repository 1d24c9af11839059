"""Media columns: texts as images in zip archives, read by a Spark data source in byte ranges.

Storing: each payload (the text's bytes, filled with 255 up to a positive multiple of 576) becomes an 8-bit
grey PNG, 576 samples a row; each task appends the images to zip archives of a bounded size, uncompressed
members beside the central directory, in the shared folder. The manifest names the archives that count.

Reading: the data source ``archive_media`` plans byte ranges over each archive. A task reads the archive's
directory, takes the members whose local header starts in its range, and yields Arrow batches of payloads. A
member that fails is read again on its own, by its offset, a few times; what still fails is a row with the error.

Cases: null and empty texts are one row of 255s; null ids keep their place by the member's name; repeated rows
are members of their own; an empty table gives no archive and an empty result; no other column is read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickline.llm.common import shared_dir, stored

WIDTH = 576
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 128_000_000, 16_000_000, 8_000_000, 4
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, error string"


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % WIDTH or (0 if data else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit grey image; a text chunk carries the unpadded length."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 4)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Samples and unpadded length of such an image; ValueError where it is damaged."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, parts, shape, n_bytes = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"tEXt":
            n_bytes = int(body.split(b"\0")[1])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if not shape or shape[2:] != (8, 0, 0, 0, 0) or n_bytes is None:
        raise ValueError("an 8-bit grey image with its length is expected")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("row filters are not used here")
    return raw[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean and variance of the samples, the share of rising neighbours, and a 64-bit average hash of an 8 x 8 grid."""
    x = np.frombuffer(payload, np.uint8)
    n, s, q = len(x), int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    cells = np.add.reduceat(x, np.arange(64) * n // 64, dtype=np.int64)
    rising = int((x[1:] > x[:-1]).sum())
    bits = sum(1 << i for i, c in enumerate((cells * 64 > s).tolist()) if c)
    return f"{s / n:.6f}:{q / n - (s / n) ** 2:.6f}:{rising / n:.6f}:{bits:016x}"


def store(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the manifest has path, bytes and members of each that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, out = TaskContext.get().partitionId(), None

        def done() -> pa.RecordBatch:
            archive.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "members": count}])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                for doc, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if out is None:
                        path = f"{root}/{part:06d}-{uuid.uuid4().hex}.zip"
                        out, count = fs.open_output_stream(path), 0
                        archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
                    name = zipfile.ZipInfo(f"{count:08d}/{'null' if doc is None else doc}.png")
                    archive.writestr(name, encode_png(payload_of(text), n_bytes))
                    count += 1
                    if out.tell() >= archive_bytes:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return stored(docs.select("doc_id", "text").mapInArrow(run, "path string, bytes long, members long"), "media-manifest")


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.archives = options["folder"], json.loads(options["archives"])
        self.step = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """Byte ranges of every archive, planned from sizes alone."""
        return [Range(path, lo, min(lo + self.step, size)) for path, size in self.archives for lo in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.folder)
        names = ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "error"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            members = [m for m in archive.infolist() if partition.lo <= m.header_offset < partition.hi]
        rows, held = [], 0
        with fs.open_input_file(partition.path) as f:
            for m in members:
                rows.append(read_member(f, m, lambda: fs.open_input_file(partition.path)))
                held += len(rows[-1][2] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def member_bytes(f: io.RawIOBase, m: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, by its offset."""
    f.seek(m.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(m.header_offset + 30 + name + extra)
    data = f.read(m.file_size)
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError("member cut short or damaged")
    return data


def read_member(f: io.RawIOBase, m: zipfile.ZipInfo, again) -> tuple:
    """The row of one member; on failure it alone is read anew from a fresh handle."""
    stem = m.filename.rpartition("/")[2].removesuffix(".png")
    doc = None if stem == "null" else int(stem)
    for n in range(TRIES):
        try:
            if n == 0:
                data = member_bytes(f, m)
            else:
                time.sleep(0.05 * 2**n)
                with again() as g:
                    data = member_bytes(g, m)
            payload, n_bytes = decode_png(data)
            return doc, n_bytes, payload, len(data), hashlib.sha256(data).hexdigest(), None
        except (OSError, ValueError, struct.error, zlib.error) as e:
            error = f"{type(e).__name__}: {e}"
    return doc, None, None, m.file_size, None, error


class ArchiveMedia(DataSource):
    """Options: folder (URI), archives (JSON list of path and bytes), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def load(manifest: DataFrame, folder: str) -> DataFrame:
    """The members of the manifest's archives (one manifest row for about 128 MB of media)."""
    spark = manifest.sparkSession
    spark.dataSource.register(ArchiveMedia)
    archives = sorted((r.path, r.bytes) for r in manifest.select("path", "bytes").toLocalIterator())
    return spark.read.format("archive_media").option("folder", folder).option("archives", json.dumps(archives)).load()


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of payloads as read back; a damaged member stops the job with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["error"]:
                    raise OSError(f"document {r['doc_id']}: {r['error']}")
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([len(r["payload"]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r["payload"]).hexdigest() for r in rows], pa.string()), pa.array([zlib.crc32(r["payload"][-32:]) for r in rows], pa.int64()),
                b.column(3), b.column(4), pa.array([feature(r["payload"]) for r in rows], pa.string()),
            ], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "media")
    return describe(load(store(docs, folder), folder))

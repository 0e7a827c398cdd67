"""Media columns: a data source over archive directories, planned as byte ranges, streamed as Arrow batches.

Archives are ZIP files of stored members. ``media_archive`` lists a directory's files and cuts each into byte ranges; a
task reads the archive's directory of members and takes those whose header lies in its range, so members are neither
missed nor read twice. Each member is read at its own offset and checked; a failed read is tried again alone, with a new
file handle, without reading its neighbours again. What still fails becomes a row with null media and the error. An archive
whose directory of members can't be read is one such row, without offset and member.

``write_archives`` stores texts: UTF-8, padded with bytes 255 to a positive multiple of 576, as an 8-bit grey PNG of width
576. Every task writes archives of about ``ARCHIVE_BYTES`` to the shared folder, each under a name of its own and renamed at
its end, so attempts that are repeated replace the same file by the same bytes, and a directory of members stays short. ``decode_media`` decompresses and unpads.

Defined results: null text counts as empty, 576 bytes of padding; null doc_id stays null. Equal texts have equal media.
Repeated rows are members of their own. A directory without archives is an empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_dir

WIDTH, RANGE_BYTES, ARCHIVE_BYTES, BATCH_BYTES, TRIES = 576, 8 << 20, 64 << 20, 4 << 20, 3
SCHEMA = "path string, offset long, member string, media binary, error string"
#: zlib's fastest level: texts shrink to half, and the stored form is lossless at any level.
LEVEL = 1


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(text: str | None) -> bytes:
    """An 8-bit grey PNG of the padded text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey PNG whose lines are unfiltered; every chunk's checksum is verified."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Sixteen bins of the sample values, each in 0 to 255 of the largest, mean and mean step, in hex."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    scaled = (bins * 255 // max(int(bins.max()), 1)).astype(np.uint8)
    mean = int(x.sum(dtype=np.int64) * 16 // len(x))
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64) * 16 // max(len(x) - 1, 1))
    return f"{scaled.tobytes().hex()}-{mean:04x}-{step:04x}"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Stores all texts as members of archives under ``path``; the number of members."""
    _, folder = _filesystem(path)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = _filesystem(path)
        task = TaskContext.get()
        draft = f"{folder}/.draft-{task.taskAttemptId()}"
        count, part, out, archive = 0, 0, None, None

        def close() -> None:
            archive.close()
            out.close()
            where.move(draft, f"{folder}/part-{task.partitionId():06d}-{part:05d}.zip")

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    where.create_dir(folder, recursive=True)
                    out = where.open_output_stream(draft)
                    archive = zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{count}-{'null' if i is None else i}.png"), encode_png(text))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
                    archive, part = None, part + 1
        if archive is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Stream(io.RawIOBase):
    """What zipfile writes to without seeking."""

    def __init__(self, out):
        self._out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[Range]:
        where, folder = _filesystem(self.path)
        files = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        ranges = [Range(f.path, a, min(a + self.range_bytes, f.size)) for f in files if f.is_file and f.path.endswith(".zip") for a in range(0, f.size, self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        where, _ = _filesystem(self.path)
        members, error = self._members(where, part)
        if error:
            if part.start == 0:
                yield _batch([(part.path, None, None, None, error)])
            return
        source, rows, size = None, [], 0
        for offset, name, length, crc in sorted(members):
            media, error = None, None
            for _ in range(self.tries):
                try:
                    source = source or where.open_input_file(part.path)
                    media, error = read_member(source, offset, length, crc), None
                    break
                except (OSError, ValueError) as e:
                    error, source = f"{type(e).__name__}: {e}", None
            rows.append((part.path, offset, name, media, error))
            size += length
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


    def _members(self, where: fs.FileSystem, part: Range) -> tuple[list[tuple], str | None]:
        """(offset, name, stored bytes, CRC) of the members whose header lies in the range; or why the directory can't be read."""
        error = None
        for _ in range(self.tries):
            try:
                with where.open_input_file(part.path) as f:
                    return [(m.header_offset, m.filename, m.compress_size, m.CRC) for m in zipfile.ZipFile(f).infolist() if part.start <= m.header_offset < part.end], None
            except (OSError, ValueError, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"
        return [], error


def read_member(source, offset: int, length: int, crc: int) -> bytes:
    """The stored bytes of the member whose local header is at ``offset``."""
    source.seek(offset)
    head = source.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    source.seek(offset + 30 + name + extra)
    data = source.read(length)
    if len(data) != length or zlib.crc32(data) != crc:
        raise ValueError(f"the member at {offset} is damaged")
    return data


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "offset", "member", "media", "error"])


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decode_media(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads that the stored bytes decode to; a member that can't be read is an error."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            out = []
            for member, data, error in zip(batch["member"].to_pylist(), batch["media"], batch["error"].to_pylist(), strict=True):
                if error:
                    raise OSError(f"{member or 'directory'}: {error}")
                stored = data.as_py()
                payload = decode_png(stored)
                raw = payload.rstrip(b"\xff")
                doc = member.removesuffix(".png").split("-", 1)[1]
                out.append((None if doc == "null" else int(doc), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return media.select("member", "media", "error").mapInArrow(scan, FEATURES)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Stores every text, reads the archives back and describes what they hold; one row per row of ``docs``."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "media")
    write_archives(docs, path, id_col, text_col)
    return decode_media(read_archives(spark, path))

"""Media columns over archive directories.

Payloads are stored as grey PNG images (8-bit samples, 64 a line, zlib) in ZIP
archives, one archive for each writing task, in a folder that all machines
share.  A custom Spark data source reads them: it plans byte ranges over the
archives; the task of a range reads the archive's central directory, takes the
members whose local header starts in its range, and streams them as Arrow
batches.  A member that fails is read again by its offset, without the others
of its range, and ends as a row with ``error`` set and null content if it goes
on failing, also where its archive cannot be opened again; so does one whose
stored image cannot be decoded.

Folders are URIs of any file system that ``pyarrow.fs`` opens.  A writing task
gives its archive a name of its own, so a second attempt never touches the
first one's file, and only the archives that successful attempts report are
read.  The driver holds one path and size for each archive.

Defined results: a null or empty text is a payload of 64 zero bytes; equal
texts give equal media; repeated rows and null ids pass through.  Ids are longs
or, if their column is no integer, strings.  Only the text and id columns are
read, so other columns' names do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegralType, StructType

from ledgerlark.llm.batches import bounded
from ledgerlark.llm.shared import shared_folder

WIDTH = 64
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
# Signatures of the PNG and ZIP formats.
PNG = b"\x89PNG\r\n\x1a\n"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def payload(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(body: bytes) -> bytes:
    """A grey image, 64 samples wide; every line has filter type 0."""
    lines = np.frombuffer(body, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of :func:`encode_png`'s image; every checksum is checked."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, shape, data = 8, None, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[0] != WIDTH or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unexpected image form")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], WIDTH + 1)
    if raw[:, 0].any():
        raise ValueError("unexpected line filter")
    return raw[:, 1:].tobytes()


class ZipWriter:
    """Stored members, one after another; the central directory at the end (ZIP64 form of sizes and offsets)."""

    def __init__(self, stream):
        self.stream, self.at, self.entries = stream, 0, []

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        self.entries.append((name, crc, len(data), self.at))
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0) + name)
        self._put(data)

    def close(self) -> int:
        begin = self.at
        for name, crc, size, offset in self.entries:
            extra = struct.pack("<HHQ", 1, 8, offset)
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 33, crc, size, size, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        size, end = self.at - begin, self.at
        n = len(self.entries)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin) + LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, min(n, 65535), min(n, 65535), min(size, 0xFFFFFFFF), 0xFFFFFFFF, 0))
        self.stream.close()
        return self.at


def directory(stream, size: int) -> Iterator[tuple[str, int, int, int]]:
    """(name, crc, size, offset of the local header) of each member."""
    stream.seek(size - 22 - 20)
    tail = stream.read(42)
    if tail[:4] != LOCATOR64 or tail[20:24] != END:
        raise ValueError("not one of this module's archives")
    stream.seek(struct.unpack_from("<Q", tail, 8)[0])
    end = stream.read(56)
    length, begin = struct.unpack_from("<QQ", end, 40)
    stream.seek(begin)
    body, at = stream.read(length), 0
    while at < length:
        crc, stored, _, names, extra, comment = struct.unpack_from("<IIIHHH", body, at + 16)
        (offset,) = struct.unpack_from("<Q", body, at + 46 + names + 4)
        yield body[at + 46 : at + 46 + names].decode(), crc, stored, offset
        at += 46 + names + extra + comment


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str], sizes: list[int], step: int):
        self.archives, self.step = list(zip(paths, sizes, strict=True)), step

    def partitions(self) -> list[InputPartition]:
        return [Range(p, size, a, min(a + self.step, size)) for p, size in self.archives for a in range(0, size, self.step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(part.path)
        schema = pa.schema([("name", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        with fs.open_input_file(path) as stream:
            own = [m for m in directory(stream, part.size) if part.start <= m[3] < part.end]
        rows: list[tuple] = []
        held, stream = 0, None
        try:
            for name, crc, size, offset in own:
                content, error = None, None
                for attempt in range(RETRIES):
                    try:
                        stream = stream or fs.open_input_file(path)
                        content, error = member(stream, name, crc, size, offset), None
                        break
                    except (OSError, ValueError, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                        # A new stream for the next attempt, which may fail to open too.
                        stream = closed(stream)
                        time.sleep(0.05 * 2**attempt)
                rows.append((name, part.path, offset, content, error))
                held += len(content or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        finally:
            closed(stream)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def closed(stream) -> None:
    """Closes what may be closed; its own failure says nothing about what was read."""
    if stream is not None:
        with suppress(OSError, ValueError):
            stream.close()


def member(stream, name: str, crc: int, size: int, offset: int) -> bytes:
    """One member by its offset, checked against the directory."""
    stream.seek(offset)
    head = stream.read(30 + len(name.encode()))
    if head[:4] != LOCAL or head[30:].decode(errors="replace") != name:
        raise ValueError("no such member at this offset")
    (extra,) = struct.unpack_from("<H", head, 28)
    if extra:
        stream.seek(offset + len(head) + extra)
    data = stream.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged member")
    return data


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive")`` with options paths, sizes (newline-separated) and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, archive string, offset long, content binary, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        paths = [p for p in self.options.get("paths", "").split("\n") if p]
        sizes = [int(s) for s in self.options.get("sizes", "").split("\n") if s]
        return ArchiveReader(paths, sizes, int(self.options.get("range_bytes", RANGE_BYTES)))


def write_archives(docs: DataFrame, text: str, doc_id: str, folder: str) -> list[tuple[str, int]]:
    """Stores each row's payload; (path, bytes) of the archives. Member names: running number, id and length."""

    def run(batches):
        writer = path = None
        count = 0
        for batch in batches:
            for number, body in zip(batch.column("__id").to_pylist(), batch.column("__text"), strict=True):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.zip"
                    fs, local = filesystem(path)
                    writer = ZipWriter(fs.open_output_stream(local))
                data = (body.as_py() or "").encode()
                writer.add(f"{count}/{'' if number is None else number}/{len(data)}.png".encode(), encode_png(payload(data)))
                count += 1
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])

    fs, local = filesystem(folder)
    fs.create_dir(local, recursive=True)
    source = bounded(docs).select(docs[doc_id].cast("string").alias("__id"), docs[text].alias("__text"))
    return [(r.path, r.size) for r in source.mapInArrow(run, "path string, size long").collect()]


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    if not archives:
        return spark.createDataFrame([], "name string, archive string, offset long, content binary, error string")
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("media_archive").option("range_bytes", str(range_bytes))
    return reader.option("paths", "\n".join(p for p, _ in archives)).option("sizes", "\n".join(str(s) for _, s in archives)).load()


def features(samples: bytes) -> str:
    """Mean, deviation, entropy (bits) and mean step of the samples."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float(share @ level)
    seen = share[share > 0]
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.3f};dev={float(share @ (level - mean) ** 2) ** 0.5:.3f};entropy={float(-(seen * np.log2(seen)).sum()):.4f};step={step:.3f}"


MEASURED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def measure(media: DataFrame, id_type: str = "long") -> DataFrame:
    """Reads each stored image back and computes its digests and features; ids are of ``id_type`` (long or string)."""
    schema = f"doc_id {id_type}, {MEASURED}"
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for name, content, error in zip(batch.column("name").to_pylist(), batch.column("content"), batch.column("error").to_pylist(), strict=True):
                # A string id may itself hold slashes.
                ident, _, size = name.partition("/")[2].removesuffix(".png").rpartition("/")
                key = (None if ident == "" else int(ident) if id_type == "long" else ident, int(size))
                if error is None:
                    stored = content.as_py()
                    try:
                        body = decode_png(stored)
                    except (ValueError, struct.error, zlib.error) as e:
                        error = f"{type(e).__name__}: {e}"[:300]
                if error is not None:
                    rows.append((*key, None, None, None, None, None, None, error))
                    continue
                rows.append((*key, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), features(body), None))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return media.select("name", "content", "error").mapInArrow(run, schema)


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Stores the payloads of ``docs`` (a job of its own) and measures what is read back."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    id_type = "long" if isinstance(docs.schema[doc_id].dataType, IntegralType) else "string"
    return measure(read_archives(spark, write_archives(docs, text, doc_id, folder), range_bytes), id_type)

"""Media columns: payloads kept as media members of archives, read by a custom data source in byte ranges.

A payload is stored losslessly as an 8-bit greyscale PNG of width WIDTH, as a member of a zip archive. The data
source plans byte ranges over the archives; a range's task reads the archive's directory and takes the members
whose offsets fall in its range, so every member is read once wherever ranges are cut. Payloads stream on through
Arrow in batches of bounded bytes. A member that cannot be read is tried again on its own, by its offset, on a
newly opened file; after RETRIES the `errors` option decides: `fail` ends the query, `null` returns the member
with a null payload and the error's text. An archive whose directory cannot be read is opened again likewise, and
then is one row with null member, offset and payload.

Defined results: a null text is an empty one; an empty payload is padded to one row of samples; a null id is kept;
repeated rows are members of their own; equal texts have equal media; an empty table writes no archive and reads
as no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import listed, open_store, planned, write_archives
from .common import shared_dir, table

WIDTH = 576
PAD = 255
LEVEL = 4
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3
SCHEMA = "member string, archive string, offset long, payload binary, error string"

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded by bytes 255 to a positive multiple of WIDTH; 255 is in no UTF-8 text."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes([PAD]) * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows of WIDTH samples as a greyscale PNG."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG made by to_png; damaged chunks raise."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, parts, size = len(_SIGNATURE), [], None
    while at < len(data):
        length, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only plain 8-bit greyscale is read")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not read")
    return lines[:, 1:].tobytes()


class ZipWriter:
    """Members in a zip archive, stored as they are: PNG is compressed already."""

    def __init__(self, stream: BinaryIO):
        self.archive, self.n = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0

    def add(self, row: dict) -> None:
        name = "null" if row["doc_id"] is None else str(row["doc_id"])
        self.archive.writestr(zipfile.ZipInfo(f"{self.n:08d}/{name}.png"), to_png(padded(row["text"])))
        self.n += 1

    def close(self) -> None:
        self.archive.close()


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Store every row's text as a media member below folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    write_archives(rows, folder, ".zip", ZipWriter, ARCHIVE_BYTES)
    return folder


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


def retried(read: Callable[[int], Any], retries: int) -> tuple[Any, str | None]:
    """read(attempt) until it succeeds: (what it gives, None), or (None, error) after so many attempts."""
    error = None
    for attempt in range(retries):
        try:
            return read(attempt), None
        except (OSError, EOFError, ValueError, NotImplementedError, struct.error, zlib.error, zipfile.BadZipFile) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, errors: str):
        self.folder, self.range_bytes, self.errors = folder, range_bytes, errors

    def partitions(self) -> list[InputPartition]:
        return [Ranges(ranges) for ranges in planned(listed(self.folder, ".zip"), self.range_bytes, cut=True)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, top = open_store(self.folder)
        schema = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for archive, start, stop in partition.ranges:
            for row in self.members(store, f"{top}/{archive}", archive, start, stop):
                if row[3] is None and self.errors == "fail":
                    raise OSError(f"{archive}, member at {row[2]}: {row[4]}")
                rows.append(row)
                held += len(row[3] or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    def members(self, store: fs.FileSystem, path: str, archive: str, start: int, stop: int) -> Iterator[tuple]:
        """The members that begin in a range, as rows; an archive whose directory cannot be read is one row."""

        def directory(_: int) -> tuple[pa.NativeFile, zipfile.ZipFile]:
            file = store.open_input_file(path)
            try:
                return file, zipfile.ZipFile(file)
            except BaseException:
                file.close()
                raise

        opened, error = retried(directory, RETRIES)
        if opened is None:
            if start == 0 or self.errors == "fail":
                yield None, archive, None, None, error
            return
        file, whole = opened
        with file, whole:
            for info in whole.infolist():
                if not start <= info.header_offset < stop:
                    continue

                def attempt(number: int) -> bytes:
                    if not number:
                        return whole.read(info)
                    again, fresh = directory(number)
                    with again, fresh:
                        return fresh.read(next(i for i in fresh.infolist() if i.header_offset == info.header_offset))

                data, error = retried(attempt, RETRIES)
                yield info.filename, archive, info.header_offset, data, error


class MediaSource(DataSource):
    """spark.read.format("media_archive").option("path", folder): one row per member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        errors = self.options.get("errors", "fail")
        if errors not in ("fail", "null"):
            raise ValueError("errors must be fail or null")
        return MediaReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)), errors)


def read_media(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def feature_of(samples: np.ndarray) -> str:
    """Whole-number features of the samples: rows, mean and spread in thousandths, high and changing samples."""
    wide = samples.astype(np.int64)
    n, total = len(wide), int(wide.sum())
    spread = (int((wide * wide).sum()) * n - total * total) * 1000 // (n * n)
    return f"rows={n // WIDTH};mean={total * 1000 // n};variance={spread};high={int((samples >= 128).sum())};changes={int((samples[1:] != samples[:-1]).sum())}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measure(members: DataFrame) -> DataFrame:
    """Digests and features of members, from the stored bytes; a member that could not be read is a row of nulls."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                stored = media.as_py()
                if stored is None:
                    rows.append((None,) * len(kinds))
                    continue
                payload = from_png(stored)
                name = member.rpartition("/")[2].removesuffix(".png")
                rows.append((None if name == "null" else int(name), len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(np.frombuffer(payload, np.uint8))))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in RESULT.split(", ")])

    return members.select("member", "payload").mapInArrow(run, RESULT)


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    folder = write_media(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/media")
    return measure(read_media(spark, folder))

"""Dated feed files as a stream that resumes at the byte where it stopped.

Below a folder there is one folder a day, whose name holds the date, with text files in it. Offsets are (day, file,
byte) in that order. A batch is planned as byte ranges that end anywhere; a range's task reads the lines that start
in it, so no file and no line but the longest is held whole. The last file of the last day may still grow: its last
line counts once it is ended. Files before it are final, so feeds should add files in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
ROWS_OUT = 10_000
SCHEMA = "snapshot_date string, file string, byte long, line string"
_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of an absolute path."""
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def lines_between(file, start: int, stop: int, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines of an open file that start in a range."""
    begin = max(0, start - 1)
    file.seek(begin)
    held, skip = b"", start > 0
    while data := file.read(chunk):
        *whole, held = (held + data).split(b"\n")
        for line in whole:
            if not skip:
                if begin >= stop:
                    return
                yield begin, line
            skip = False  # what is left of the line of the range before
            begin += len(line) + 1
        if begin >= stop and not skip:
            return
    if held and not skip and begin < stop:
        yield begin, held


def last_line_end(file, size: int, chunk: int = CHUNK_BYTES) -> int:
    """Where the last ended line of an open file ends."""
    while size > 0:
        begin = max(0, size - chunk)
        file.seek(begin)
        found = file.read(size - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        size = begin
    return 0


@dataclass
class ByteRange(InputPartition):
    day: str
    path: str
    start: int
    stop: int

    def __init__(self, day: str, path: str, start: int, stop: int):
        super().__init__(path)
        self.day, self.path, self.start, self.stop = day, path, start, stop


class Folder:
    """The dated files below a folder."""

    def __init__(self, path: str):
        self.path = path

    def days(self, first: str = "") -> list[tuple[str, str]]:
        """(day, folder) from a day on, in order."""
        store, top = open_store(self.path)
        found = [(m.group(), i.path) for i in store.get_file_info(fs.FileSelector(top)) if i.type == fs.FileType.Directory and (m := _DAY.search(i.base_name))]
        return sorted(x for x in found if x[0] >= first)

    def files(self, folder: str) -> list[tuple[str, int]]:
        store, _ = open_store(self.path)
        infos = store.get_file_info(fs.FileSelector(folder))
        return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))

    def end(self) -> dict:
        """The offset after all that is there, less a last line that has no end yet."""
        store, _ = open_store(self.path)
        for day, folder in reversed(self.days()):
            files = self.files(folder)
            if files:
                path, size = files[-1]
                with store.open_input_file(path) as file:
                    return {"day": day, "file": path, "byte": last_line_end(file, size)}
        return dict(START)

    def ranges(self, start: dict, end: dict) -> list[ByteRange]:
        """Byte ranges from one offset to another."""
        out = []
        for day, folder in self.days(start["day"]):
            if day > end["day"]:
                break
            for path, size in self.files(folder):
                if (day, path) < (start["day"], start["file"]) or (day, path) > (end["day"], end["file"]):
                    continue
                a = start["byte"] if (day, path) == (start["day"], start["file"]) else 0
                b = end["byte"] if (day, path) == (end["day"], end["file"]) else size
                out += [ByteRange(day, path, k, min(k + RANGE_BYTES, b)) for k in range(a, b, RANGE_BYTES)]
        return out


START = {"day": "", "file": "", "byte": 0}
_ARROW = pa.schema([("snapshot_date", pa.string()), ("file", pa.string()), ("byte", pa.int64()), ("line", pa.string())])


def read_range(root: str, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
    if part is None:  # what Spark reads where there are no ranges
        return
    store, _ = open_store(root)

    def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        lines = [line.removesuffix(b"\r").decode("utf-8", "replace") for _, line in rows]
        columns = [pa.array([part.day] * n), pa.array([part.path] * n), pa.array([b for b, _ in rows], pa.int64()), pa.array(lines, pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    with store.open_input_file(part.path) as file:
        rows: list[tuple[int, bytes]] = []
        for row in lines_between(file, part.start, part.stop):
            rows.append(row)
            if len(rows) == ROWS_OUT:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


class DatedReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        folder = Folder(self.root)
        return folder.ranges(START, folder.end())

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition)


class DatedStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, finished: str | None):
        self.root, self.finished = root, finished

    def initialOffset(self) -> dict:  # noqa: N802
        return dict(START)

    def latestOffset(self) -> dict:  # noqa: N802
        return Folder(self.root).end()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return Folder(self.root).ranges(start, end)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition)

    def commit(self, end: dict) -> None:
        """Mark the days before the offset's as finished: an empty file each, where a folder is named for them."""
        if not self.finished:
            return
        store, top = open_store(self.finished)
        store.create_dir(top)
        known = {i.base_name for i in store.get_file_info(fs.FileSelector(top))}
        for day, _ in Folder(self.root).days():
            if day < end["day"] and day not in known:
                store.open_output_stream(f"{top}/{day}").close()


class DatedFeed(DataSource):
    """Format dated_feed: option path, and finished, a folder in which days that were read whole are marked."""

    @classmethod
    def name(cls) -> str:
        return "dated_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DatedReader:
        return DatedReader(self.options["path"])

    def streamReader(self, schema) -> DatedStreamReader:  # noqa: N802
        return DatedStreamReader(self.options["path"], self.options.get("finished"))


def read_dated(spark: SparkSession, path: str, finished: str | None = None, stream: bool = True) -> DataFrame:
    """The lines below path with their day, file and byte: as a stream, or all that is there now."""
    spark.dataSource.register(DatedFeed)
    reader = (spark.readStream if stream else spark.read).format("dated_feed").option("path", path)
    return (reader.option("finished", finished) if finished else reader).load()


def file_digests(files: DataFrame) -> DataFrame:
    """(path, sha256, records) of a column path: files are read in chunks, many side by side; records are lines that are neither blank nor comments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = open_store(path)
                h, records = hashlib.sha256(), 0
                with store.open_input_file(place) as file:
                    while data := file.read(CHUNK_BYTES):
                        h.update(data)
                    for _, line in lines_between(file, 0, 1 << 62):
                        records += bool(line.strip(b" ")) and not line.strip(b" ").startswith(b"#")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([h.hexdigest()]), pa.array([records], pa.int32())], ["path", "sha256", "records"])

    return files.select("path").mapInArrow(run, "path string, sha256 string, records int")

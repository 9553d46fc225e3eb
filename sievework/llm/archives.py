"""Archive files in shared storage: written by tasks, listed by a committed manifest, planned by readers."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

MANIFEST = "path string, bytes long, members long"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs) or an absolute path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_archives(rows: DataFrame, folder: str, suffix: str, writer: Callable[[BinaryIO], Any], limit: int) -> str:
    """Write every row to archives of about limit bytes under folder; returns the manifest's place.

    writer(stream) gives an object with add(row as dict) and close(). Each attempt of a task writes files of its
    own names; the manifest, itself a written table, names those of the attempts that were committed, so lost
    executors and repeated tasks neither lose nor double a member.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        store.create_dir(f"{top}/archives", recursive=True)
        found: list[tuple[str, int, int]] = []
        stream, archive, members = None, None, 0

        def flush() -> None:
            nonlocal stream, archive, members
            if archive is not None:
                archive.close()
                name = f"archives/{uuid.uuid4().hex}{suffix}"
                with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                    out.write(stream.getbuffer())
                found.append((name, stream.getbuffer().nbytes, members))
            stream, archive, members = None, None, 0

        for batch in batches:
            for k in range(batch.num_rows):
                if archive is None:
                    stream = io.BytesIO()
                    archive = writer(stream)
                archive.add({name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)})
                members += 1
                if stream.tell() >= limit:
                    flush()
        flush()
        names, sizes, counts = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "members"])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path below folder, bytes) of the archives: those of the manifest, or all files where there is none."""
    store, top = open_store(folder)
    if store.get_file_info(f"{top}/manifest").type == fs.FileType.Directory:
        found = pq.read_table(f"{top}/manifest", filesystem=store, columns=["path", "bytes"])
        return sorted(zip(found.column("path").to_pylist(), found.column("bytes").to_pylist()))
    infos = store.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((i.path.removeprefix(f"{top}/"), i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(suffix))


#: Readers plan at most about so many partitions, however large the archives are in all.
PARTITIONS = 20_000


def planned(found: list[tuple[str, int]], step: int, cut: bool) -> list[list[tuple[str, int, int]]]:
    """Partitions of (path, start, stop) that hold about step bytes, or more where there would be over PARTITIONS.

    With cut, files are cut into byte ranges; else a partition holds whole files.
    """
    step = max(step, sum(size for _, size in found) // PARTITIONS)
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, size in found:
        for start in range(0, size, step) if cut else [0]:
            stop = min(size, start + step) if cut else size
            if not out or stop - start > room:
                out.append([])
                room = step
            out[-1].append((path, start, stop))
            room -= stop - start
    return out

"""WARC archives: a writer with revisit records, and a Python data source that reads them with pushdown.

The writer stores a record per row, each in its own gzip member whose extra field holds the member's length, so a
reader can pass over it without inflating it. Of rows with equal payloads of MIN_REVISIT bytes or more, those with
the smallest id are responses; the others are revisits, which hold no payload but name the response and keep the
payload's digest and length in their headers.

The reader plans one partition for each run of files up to a size, takes equality and membership predicates on
record type, ids, digest and URL, inflates a record's headers first, and goes on to the payload only where
predicates hold and the payload is asked for (`payload` option: `false`, `verify` against the digest, or `true`).

Defined results: a null html is an empty payload; a null url writes no target; a null id writes no id and reads
back as null; it is never the response that others refer to while another row has an id; rows that repeat both
the smallest id and the payload are all responses; control characters in urls are percent-encoded; an empty table
writes no archive and reads as no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull

from .archives import listed, open_store, planned, write_archives
from .common import HOT_SHARE, shared_dir, table

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
PARTITION_BYTES = 16 << 20
LEVEL = 3
SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"

_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


class WarcWriter:
    """Appends records to a stream, each as a gzip member with its length in the extra field."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream

    def add(self, row: dict) -> None:
        html = (row["html"] or "").encode("utf-8", "replace")
        revisit = row["refers_to"] is not None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
        block = http if revisit else http + html
        head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z"]
        if row["page_id"] is not None:
            head.append(f"WARC-Record-ID: <urn:page:{row['page_id']}>")
        if row["url"] is not None:
            head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]))
        if revisit:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
        head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(html).hexdigest()}", f"WARC-Payload-Length: {len(html)}"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        record = "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
        body = packer.compress(record) + packer.flush()
        tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
        extra = b"sl" + struct.pack("<HII", 8, 10 + 14 + len(body) + 8 & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
        self.stream.write(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail)

    def close(self) -> None:
        pass


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to (null for responses) of every row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest_", F.unhex(F.sha2("html", 256)))
    big = F.octet_length("html") >= min_bytes
    counts = keyed.where(big).groupBy("digest_").agg(F.min("page_id").alias("first_"), F.count(F.lit(1)).alias("n_"))
    first = counts.where("n_ > 1 and first_ is not null")
    # Payloads that a large share of the pages repeats are few; their pages do not travel, but meet their first page
    # by a broadcast of at most HOT_SHARE rows.
    hot = F.col("n_") * HOT_SHARE > pages.count()
    few = F.broadcast(first.where(hot)).select("digest_", F.col("first_").alias("hot_"))
    dealt = keyed.join(few, "digest_", "left")
    rest = dealt.where("hot_ is null").drop("hot_").join(first.where(~hot).drop("n_"), "digest_", "left")
    joined = rest.unionByName(dealt.where("hot_ is not null").withColumnRenamed("hot_", "first_"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_")), F.col("first_"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> str:
    """Write a record per row below folder."""
    write_archives(revisits(pages, min_bytes), folder, ".warc.gz", WarcWriter, ARCHIVE_BYTES)
    return folder


class Records:
    """The records of one open archive, headers first."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.inflated = file, size, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], Record]]:
        at = 0
        while at < self.size:
            record = Record(self.file, at)
            headers = record.headers()
            yield headers, record
            self.inflated += record.inflated
            at = record.end()


class Record:
    """One gzip member: inflated as far as asked for."""

    STEP = 1 << 14

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.inflated = file, at, 0
        file.seek(at)
        self.raw = file.read(self.STEP)
        self.length = None
        if self.raw[3] & 4:
            size = struct.unpack("<H", self.raw[10:12])[0]
            if self.raw[12:14] == b"sl" and size >= 12:
                self.length = struct.unpack("<I", self.raw[16:20])[0]
        self.unpacker, self.text, self.pending = zlib.decompressobj(31), b"", self.raw

    def more(self, size: int = 0) -> bool:
        """Inflate about so much more; false at the member's end."""
        if self.unpacker.eof:
            return False
        data = self.unpacker.unconsumed_tail or self.pending
        self.pending = b""
        if not data:
            data = self.file.read(max(self.STEP, size // 4))
            if not data:
                raise EOFError(f"record at {self.at} ends early")
        got = self.unpacker.decompress(data, size or self.STEP)
        self.inflated += len(got)
        self.text += got
        return True

    def headers(self) -> dict[str, str]:
        while (cut := self.text.find(b"\r\n\r\n")) < 0:
            if not self.more(1024):
                raise ValueError(f"no headers in the record at {self.at}")
        self.start = cut + 4
        lines = self.text[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {self.at}")
        return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}

    def payload(self, headers: dict[str, str]) -> bytes:
        need = self.start + int(headers["content-length"])
        parts = [self.text]
        have = len(self.text)
        while have < need:
            self.text = b""
            if not self.more(1 << 20):
                raise EOFError(f"record at {self.at} ends early")
            parts.append(self.text)
            have += len(self.text)
        self.text = b"".join(parts)
        block = memoryview(self.text)[self.start : need]
        cut = self.text.find(b"\r\n\r\n", self.start)
        return bytes(block[cut + 4 - self.start :])

    def end(self) -> int:
        if self.length is not None:
            return self.at + self.length
        while self.more(1 << 20):
            self.text = self.text[-4:]
        return self.file.tell() - len(self.unpacker.unused_data)


def parsed(headers: dict[str, str]) -> dict:
    """The columns that headers alone give."""
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", headers.get(name, ""))) else None
    return {
        "record_type": headers.get("warc-type"),
        "page_id": number("warc-record-id"),
        "url": headers.get("warc-target-uri"),
        "refers_to": number("warc-refers-to"),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": int(headers["warc-payload-length"]) if "warc-payload-length" in headers else None,
    }


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: str):
        self.folder, self.payload, self.tests = folder, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Predicates on one header column are taken; the rest stays with Spark."""
        for f in filters:
            kind, name = type(f).__name__, f.attribute[0] if len(f.attribute) == 1 else None
            if name is None or name == "payload" or not isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)):
                yield f
            else:
                self.tests.append((kind, name, getattr(f, "value", None)))

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            mine = row[name]
            ok = {"EqualTo": mine is not None and mine == value, "EqualNullSafe": mine == value, "IsNull": mine is None, "IsNotNull": mine is not None}.get(kind)
            if not (mine is not None and mine in value if ok is None else ok):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return [Files(files) for files in planned(listed(self.folder, ".warc.gz"), PARTITION_BYTES, cut=False)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, top = open_store(self.folder)
        schema = pa.schema([("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows: list[dict] = []
        held = 0
        for path, _, size in partition.files:
            with store.open_input_file(f"{top}/{path}") as file:
                for headers, record in Records(file, size):
                    row = parsed(headers)
                    if not self.wanted(row):
                        continue
                    row["payload"] = None
                    if self.payload != "false" and row["record_type"] == "response":
                        payload = record.payload(headers)
                        if len(payload) != row["payload_bytes"] or hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                            raise ValueError(f"{path}: the payload of record {headers.get('warc-record-id')} does not match its digest")
                        if self.payload == "true":
                            row["payload"] = payload
                            held += len(payload)
                    rows.append(row)
                    if len(rows) >= 4096 or held >= 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """spark.read.format("warc_archive").option("path", folder): one row per record."""

    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        payload = self.options.get("payload", "true")
        if payload not in ("true", "false", "verify"):
            raise ValueError("payload must be true, false or verify")
        return WarcReader(self.options["path"], payload)


def read_warc(spark: SparkSession, folder: str, payload: str = "true") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc_archive").option("path", folder).option("payload", payload).load()


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc")
    # One pass: responses are read whole and verified, revisits by their headers alone.
    found = read_warc(spark, folder, "verify").where(F.col("record_type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

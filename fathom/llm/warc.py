"""WARC archives as a PySpark Python data source, and an archive round trip with revisit records.

Reading plans a partition per committed file range. Record-type and header
predicates are pushed down: each record's header is parsed first, and the block
of a record that a predicate rejects, or all blocks under ``payload=false``, is
skipped by seeking and never decoded. Writing goes to uniquely named files; each
commit adds a manifest that names the files that count, so a retried or lost task
leaves nothing behind that a reader would see, an append keeps what is there and
an overwrite replaces it. Reading needs Spark's Python filter pushdown, which
``read_warc`` turns on for the session. Foreign archives without a manifest are
read a file per partition, and compressed ones are inflated to skip.

Results for odd input: null html is an empty payload; a null url has no target
header; repeated rows of the smallest page_id of a payload are all responses; a
null page_id never becomes a target and its record is a response if no other
page has its payload, else a revisit; empty tables give an archive without
records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .scratch import scratch_dir

RANGE = 32 << 20
MIN_REVISIT = 100
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Columns that stand in a record's header, by header name. Fixed by the WARC format.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "payload_length": "x-payload-length"}
MANIFEST = "_manifest-"
#: Hadoop's names of object stores, and what pyarrow calls them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def store_uri(path: str) -> str:
    """path with the scheme that pyarrow knows its store by; a path without a scheme is left as it is."""
    scheme, cut, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if cut else path


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    path = store_uri(path)
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def _listed(fs: pafs.FileSystem, path: str) -> list:
    """(file, record-range borders) of each file that a manifest names."""
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, list[int]]]


def record_bytes(row: dict) -> bytes:
    """One WARC record; a revisit has headers only."""
    block = b""
    if row["payload"] is not None:
        body = zlib.compress(row["payload"], 1)
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: deflate\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=''':/?#[]@!$&'()*+,;=%-._~|^{}''')}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_header(source: io.BufferedIOBase) -> dict[str, str] | None:
    """The next record's header fields in lower case, or None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    fields = {}
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def decode_block(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, cut, body = block.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"HTTP/"):
        return block
    return zlib.decompress(body) if b"content-encoding: deflate" in head.lower() else body


def header_value(fields: dict[str, str], column: str) -> Any:
    value = fields.get(HEADERS[column])
    if value is None:
        return None
    if column == "payload_digest":
        return value.rpartition(":")[2]
    return int(value) if column == "payload_length" else value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decode = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take equality and membership tests on header columns; give back the rest."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[InputPartition]:
        fs, root = _place(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [_Range(self.path, 0, -1)]
        found = fs.get_file_info(pafs.FileSelector(root))
        names = sorted(x.base_name for x in found if x.base_name.startswith(MANIFEST))
        if names:
            return [_Range(f"{self.path}/{name}", a, b) for m in names for name, cuts in _listed(fs, f"{root}/{m}") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return [_Range(f"{self.path}/{x.base_name}", 0, -1) for x in sorted(found, key=lambda x: x.base_name) if x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # an archive without records has no partitions
            return
        fs, path = _place(partition.path)
        with fs.open_input_file(path) as raw:
            source = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
            source.seek(partition.start)
            while partition.end < 0 or source.tell() < partition.end:
                fields = read_header(source)
                if fields is None:
                    return
                length = int(fields.get("content-length", 0))
                row = {c: header_value(fields, c) for c in HEADERS}
                if any(row[c] not in values for c, values in self.wanted.items()):
                    source.seek(length, io.SEEK_CUR)
                    continue
                payload = None
                if self.decode and row["record_type"] != "revisit":
                    payload = decode_block(source.read(length))
                else:
                    source.seek(length, io.SEEK_CUR)
                yield (*row.values(), payload)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        name, cuts, at = f"part-{uuid.uuid4().hex}.warc", [0], 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for lo in range(0, batch.num_rows, 256):
                    for row in batch.slice(lo, 256).to_pylist():
                        record = record_bytes(row)
                        out.write(record)
                        at += len(record)
                        if at - cuts[-1] >= RANGE:
                            cuts.append(at)
        if at > cuts[-1]:
            cuts.append(at)
        return _Written([(name, cuts)] if at else [])

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        before = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m is not None for f in m.files]).encode())
        for manifest in before:
            files = [name for name, _ in _listed(fs, f"{root}/{manifest}")]
            for name in (manifest, *files):
                fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, root = _place(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``; option payload=false reads headers only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Write a record per page; payloads that an earlier page of this call already has become revisits."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    named = named.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.length("payload").cast("long"))
    firsts = named.where(F.col("payload_length") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    # short payloads have keys of their own, so that empty pages don't meet in one task
    key = F.when(F.col("payload_length") >= MIN_REVISIT, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "target_uri").cast("string")))
    joined = named.withColumn("key", key).join(firsts.withColumnRenamed("payload_digest", "key"), "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    records = joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), "target_uri", "payload_digest",
        F.when(again, urn("first")).alias("refers_to"), "payload_length", F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode(mode).save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, all read back from the archive."""
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)>", 1).try_cast("long")
    responses = read_warc(spark, path).where(F.col("record_type") == "response")
    responses = responses.select(number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit")
    revisits = revisits.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return responses.union(revisits)

"""An inbox of messages as a Python data source: a streaming sink that commits and a streaming source with offsets of its own.

Tasks of a sink write their messages into part files that nobody reads yet. A
micro-batch counts once its manifest, named by writer and batch, lists its parts:
a manifest is written beside its place and moved there, and one that is there
stays, so a batch that is written again after a crash adds nothing. An offset is
the number of manifests read of each writer. Messages are JSON lines; the folder
is any that pyarrow can name (a path, or a URI of a shared store).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _manifests(folder: str) -> dict[str, list[int]]:
    """The batches of each writer that count, in order."""
    store, base = _opened(folder)
    out: dict[str, list[int]] = {}
    for f in store.get_file_info(fs.FileSelector(f"{base}/manifests", allow_not_found=True)):
        if f.base_name.endswith(".json"):
            writer, _, batch = f.base_name.removesuffix(".json").rpartition("-")
            out.setdefault(writer, []).append(int(batch))
    return {w: sorted(b) for w, b in out.items()}


@dataclass
class Written(WriterCommitMessage):
    """The part that one task wrote, None if it had no rows."""

    part: str | None


@dataclass
class Part(InputPartition):
    path: str


class InboxWriter(DataSourceStreamWriter):
    def __init__(self, folder: str, writer: str):
        self.folder, self.writer = folder, writer

    def write(self, iterator: Iterator[Row]) -> Written:
        store, base = _opened(self.folder)
        name, out = f"{self.writer}-{uuid.uuid4().hex}.jsonl", None
        store.create_dir(f"{base}/parts", recursive=True)
        for row in iterator:
            out = out or store.open_output_stream(f"{base}/parts/{name}")
            out.write((json.dumps(row.asDict()) + "\n").encode())
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, base = _opened(self.folder)
        store.create_dir(f"{base}/manifests", recursive=True)
        place = f"{base}/manifests/{self.writer}-{batchId:012d}.json"
        if store.get_file_info(place).type != fs.FileType.NotFound:
            self.abort(messages, batchId)
            return
        beside = f"{base}/manifests/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(beside) as out:
            out.write(json.dumps([m.part for m in messages if m is not None and m.part]).encode())
        store.move(beside, place)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, base = _opened(self.folder)
        for m in messages:
            if m is not None and m.part and store.get_file_info(f"{base}/parts/{m.part}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/parts/{m.part}")


class InboxReader(DataSourceStreamReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, schema.fieldNames()

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {w: len(b) for w, b in sorted(_manifests(self.folder).items())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        store, base = _opened(self.folder)
        held, out = _manifests(self.folder), []
        for writer, upto in sorted(end.items()):
            for batch in held.get(writer, [])[start.get(writer, 0) : upto]:
                with store.open_input_stream(f"{base}/manifests/{writer}-{batch:012d}.json") as f:
                    out += [Part(f"{base}/parts/{part}") for part in json.loads(f.read())]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _opened(self.folder)
        with store.open_input_file(partition.path) as f:
            rest = b""
            while block := f.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    message = json.loads(line)
                    yield tuple(message.get(name) for name in self.names)


class Inbox(DataSource):
    """Options: path, and for a sink writer, a name that no other query of the inbox has."""

    @classmethod
    def name(cls) -> str:
        return "inbox"

    def streamReader(self, schema: StructType) -> InboxReader:
        return InboxReader(self.options["path"], schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> InboxWriter:
        return InboxWriter(self.options["path"], self.options["writer"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Inbox)

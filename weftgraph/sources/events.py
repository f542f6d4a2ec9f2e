"""A sink of conversation events: a Data Source whose stream writer frames rows as JSON lines or server-sent events, each batch once.

Each task writes a file of its own; the driver names a batch's files in a manifest, which is put in place whole. A batch
that was cut off has no manifest, and what its tasks left is never read; a batch that comes again after its manifest
is known changes nothing. The folder is any that pyarrow's file systems reach from the driver and all executors.
"""

from __future__ import annotations

import datetime
import decimal
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# fixed values: the types of events and the fields that each carries
EVENTS = {
    "started": ("resolvedProviderId", "resolvedModelId", "runId", "graphStatus", "graphWarning", "graphVersion", "turnId"),
    "activity": ("activity", "turnId"),
    "token": ("token", "turnId"),
    "usage": ("usage", "turnId"),
    "completed": ("done", "turnId"),
    "error": ("error", "code", "retryable", "stage", "turnId"),
}


def _plain(value: object) -> object:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    return str(value) if isinstance(value, decimal.Decimal) else value


def framed(row: dict, style: str = "lines") -> str:
    """An event as text: its type, then the fields that its type carries; a type that isn't known is an error."""
    kind = row.get("type")
    if kind not in EVENTS:
        raise ValueError(f"no such event: {kind}")
    payload = {"type": kind} | {name: True if name == "done" else _plain(row[name]) for name in EVENTS[kind] if name in row or name == "done"}
    text = json.dumps(payload, ensure_ascii=False, separators=(",", ":"))
    return f"data: {text}\n\n" if style == "sse" else text + "\n"


@dataclass
class _Wrote(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str, style: str):
        self.path, self.style = path, style

    def _at(self) -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = self._at()
        name, rows = f"part-{uuid.uuid4().hex}", 0
        files.create_dir(f"{root}/parts", recursive=True)
        with files.open_output_stream(f"{root}/parts/{name}") as out:
            for row in iterator:
                out.write(framed(row.asDict(), self.style).encode())
                rows += 1
        return _Wrote(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = self._at()
        manifest = f"{root}/batches/{batchId:012d}.json"
        files.create_dir(f"{root}/batches", recursive=True)
        wrote = [m for m in messages if m is not None]
        if files.get_file_info(manifest).type != fs.FileType.NotFound:
            self._drop(wrote)  # the batch has come again
            return
        spare = f"{root}/batches/.{batchId}-{uuid.uuid4().hex}"
        with files.open_output_stream(spare) as out:
            out.write(json.dumps({"batch": batchId, "parts": [m.name for m in wrote if m.rows], "rows": sum(m.rows for m in wrote)}).encode())
        files.move(spare, manifest)
        self._drop([m for m in wrote if not m.rows])

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._drop([m for m in messages if m is not None])

    def _drop(self, wrote: list[_Wrote]) -> None:
        files, root = self._at()
        for m in wrote:
            files.delete_file(f"{root}/parts/{m.name}")


class EventSink(DataSource):
    """df.writeStream.format("weft_events").option("path", uri).option("style", "lines" or "sse")."""

    @classmethod
    def name(cls) -> str:
        return "weft_events"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        if "path" not in self.options:
            raise ValueError("the sink needs a path")
        return _Writer(self.options["path"], self.options.get("style", "lines"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSink)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(batch, line) of the committed batches' events, written as lines."""
    batches = spark.read.schema("batch long, parts array<string>, rows long").json(f"{path}/batches")
    names = batches.selectExpr("batch", "explode(parts) AS part")
    try:
        lines = spark.read.text(f"{path}/parts").selectExpr("value AS line", "element_at(split(input_file_name(), '/'), -1) AS part")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "line string, part string")
    return lines.join(names, "part").select("batch", "line")

"""Traces as files of JSON lines, each row once, from a batch or a stream.

    trace_json(...).write.format("trace_files").mode("append").save(folder)
    stream.writeStream.format("trace_files").option("checkpointLocation", ...).start(folder)

Rows have a string column ``json``; others are left out. A task writes a file of its own below ``data``; what counts are the files that a manifest names, and a
manifest appears at once, by renaming, when the job commits. So a task that runs twice, or a job that fails half-way, adds nothing: its other files are named by none, and
are removed where that is still possible. The manifest of a stream's batch bears the batch's number, so a batch that runs again after it was committed adds nothing
either. Overwriting is a manifest that lists the manifests it replaces.

The folder is on a file system that the driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

DATA, MANIFESTS = "data", "manifests"


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Files:
    """What a batch and a stream writer share."""

    def __init__(self, schema: T.StructType, folder: str):
        if "json" not in schema.fieldNames():
            raise ValueError("there has to be a column named json")
        self.at, self.folder = schema.fieldNames().index("json"), folder
        for name in (DATA, MANIFESTS):
            os.makedirs(os.path.join(folder, name), exist_ok=True)

    def write_file(self, rows: Iterator[Row]) -> Written:
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with open(os.path.join(self.folder, DATA, name), "w", encoding="utf-8") as f:
            for row in rows:
                if row[self.at] is not None:
                    f.write(row[self.at] + "\n")
                    n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(name, n)

    def remove(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(path := os.path.join(self.folder, DATA, m.name)):
                os.remove(path)

    def publish(self, name: str, messages: list[Written | None], replaces: list[str]) -> bool:
        """Whether a manifest of this name is new; if not, what was written now is dropped."""
        target = os.path.join(self.folder, MANIFESTS, name)
        if os.path.exists(target):
            self.remove(messages)
            return False
        kept = [m for m in messages if m is not None and m.rows]
        self.remove([m for m in messages if m is not None and not m.rows])
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        with open(draft, "w", encoding="utf-8") as f:
            json.dump({"files": [m.name for m in kept], "rows": sum(m.rows for m in kept), "replaces": replaces}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(draft, target)
        return True


class BatchWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, folder: str, overwrite: bool):
        self.files, self.overwrite = Files(schema, folder), overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.write_file(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.files.publish(f"job-{uuid.uuid4().hex}.json", messages, list(manifests(self.files.folder)) if self.overwrite else [])

    def abort(self, messages: list[Written | None]) -> None:
        self.files.remove(messages)


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, schema: T.StructType, folder: str, query: str):
        self.files, self.query = Files(schema, folder), query

    def write(self, iterator: Iterator[Row]) -> Written:
        return self.files.write_file(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.files.publish(f"{self.query}-batch-{batchId}.json", messages, [])

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.files.remove(messages)


class TraceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_files"

    def schema(self) -> str:
        return "json string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(schema, self.options["path"], overwrite)

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        # Several queries may write to one folder, each under a name of its own.
        return StreamWriter(schema, self.options["path"], self.options.get("query", "stream"))


def manifests(folder: str) -> dict[str, dict]:
    """The manifests that count, by name."""
    at = os.path.join(folder, MANIFESTS)
    found = {}
    for name in sorted(os.listdir(at)) if os.path.isdir(at) else []:
        if name.endswith(".json"):
            with open(os.path.join(at, name), encoding="utf-8") as f:
                found[name] = json.load(f)
    gone = {r for m in found.values() for r in m["replaces"]}
    return {n: m for n, m in found.items() if n not in gone}


def write_traces(traces: DataFrame, folder: str, overwrite: bool = False) -> None:
    traces.sparkSession.dataSource.register(TraceFiles)
    traces.write.format("trace_files").mode("overwrite" if overwrite else "append").save(folder)


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """json: the rows of all files that manifests name."""
    files = [os.path.join(folder, DATA, f) for m in manifests(folder).values() for f in m["files"]]
    if not files:
        return spark.createDataFrame([], "json string")
    return spark.read.option("lineSep", "\n").text(files).withColumnRenamed("value", "json")

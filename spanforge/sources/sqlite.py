"""A batch data source over embedded SQLite files, opened read-only; lower bounds on one column are pushed into the query.

    spark.read.format("sqlite_ro").schema(...).option("paths", json list).option("table", name).option("bound", column).load()

One partition for each file, up to ``TASKS`` files; of more, each holds several, ``FILES`` at most. A file that is missing, or no database, has no rows; an error in the middle of a table fails
the task, so no prefix passes for the whole. Rows come with db_path, the file they are from. Bounds are only ever a
superset: Spark filters again.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

BUSY_SECONDS = 5
#: Files up to which each has a partition of its own, and the most that one partition holds.
TASKS, FILES = 64, 512


class SomeFiles(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(tuple(paths))
        self.paths = paths


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.kinds = [f.dataType for f in schema.fields]
        self.paths = json.loads(options["paths"])
        self.table, self.bound = options["table"], options.get("bound")
        self.least: int | None = None

    def partitions(self) -> list[InputPartition]:
        size = min(FILES, -(-len(self.paths) // TASKS)) or 1
        return [SomeFiles(self.paths[k : k + size]) for k in range(0, len(self.paths), size)] or [SomeFiles([])]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"paths": []}  # a task has those of its partition

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._rows(path)

    def _rows(self, path: str) -> Iterator[tuple]:
        if not path or not os.path.isfile(path):
            return
        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns if c not in ("db_path", "row_no"))
        query = f'SELECT rowid, {names} FROM "{self.table}"'
        if self.least is not None:
            query += f' WHERE "{self.bound}" >= {self.least}'
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=BUSY_SECONDS)
        try:
            try:
                rows = db.execute(query)
            except sqlite3.DatabaseError:
                return  # no database, or no such table
            for row in rows:
                own = {"row_no": row[0], "db_path": path}
                got = iter(row[1:])
                out = tuple(own[c] if c in own else next(got) for c in self.columns)
                yield tuple(v if not isinstance(v, bytes) else v.decode("utf-8", "replace") for v in out)
        finally:
            db.close()


class BoundedReader(SqliteReader):
    """Takes lower bounds; only used where the session allows pushdown into Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.bound and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo) and f.attribute == (self.bound,) and isinstance(f.value, int):
                self.least = f.value if self.least is None else max(self.least, f.value)
            yield f  # Spark checks every row again


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = dict(self.options)
        return (BoundedReader if options.get("push") == "true" else SqliteReader)(schema, options)


def read_table(spark: SparkSession, paths: list[str], table: str, schema: str, bound: str | None = None) -> DataFrame:
    """A table of several SQLite files, with db_path and row_no."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite_ro").schema(f"{schema}, db_path string, row_no long").option("paths", json.dumps(paths)).option("table", table)
    reader = reader.option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("bound", bound) if bound else reader).load()


def split_path(path: str) -> tuple[str, str]:
    """Database and session of a composite path, cut at its last slash; both empty without one."""
    head, slash, tail = path.rpartition("/")
    return (head, tail) if slash else ("", "")

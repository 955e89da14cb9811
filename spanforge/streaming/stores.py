"""SQLite stores that grow, as a stream of their new rows, each once.

An offset holds, for each file, the time and the row number of the last row given out. A batch takes the rows beyond it up to a bound that is fixed when
the batch is planned: (time, row) > start and (time, row) <= end. So rows that share a second with the last one are told apart by their
number, none is lost or given twice, and a batch that runs again reads the same rows, whatever was written since. Writers append: a row that is dated
before the last one given out is not seen.

With max_rows a batch takes so many rows, dealt fairly over the files with a backlog. A file that is missing, or no database, or has no such table yet, has no rows
for now. Databases in WAL mode are read like others, as what counts are their rows and not the size of a file.
"""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spanforge.sources.sqlite import BUSY_SECONDS
from spanforge.sources.stores import MESSAGE, crush_items, placed_messages
from spanforge.streaming.tail import shares

FIRST = [-(1 << 62), -1]


class RowsBetween(InputPartition):
    def __init__(self, path: str, start: list[int], end: list[int]):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=BUSY_SECONDS)


class StoreReader(DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields]
        self.paths, self.table = json.loads(options["paths"]), quoted(options["table"])
        self.most = int(options["max_rows"]) if options.get("max_rows") else None
        self.order = f"coalesce({quoted(options['order'])}, 0), rowid"
        self.position: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"stores": "{}"}

    def _ask(self, path: str, query: str, values: list[int]) -> tuple | None:
        """One row of a store; None where the store has no such table, or isn't there."""
        if not os.path.isfile(path):
            return None
        with closing(opened(path)) as db:
            try:
                return db.execute(query, values).fetchone()
            except sqlite3.DatabaseError as error:
                if isinstance(error, sqlite3.OperationalError) and "no such" not in str(error):
                    raise  # locked, or unreadable for now: the batch is tried again
                return None

    def latestOffset(self) -> dict:
        after = dict(self.position)
        start = {p: after.get(p, FIRST) for p in self.paths}
        if self.most is None:
            last = {p: self._ask(p, f"SELECT {self.order} FROM {self.table} WHERE ({self.order}) > (?, ?) ORDER BY 1 DESC, 2 DESC LIMIT 1", start[p]) for p in self.paths}
        else:
            counted = {p: self._ask(p, f"SELECT count(*) FROM {self.table} WHERE ({self.order}) > (?, ?)", start[p]) for p in self.paths}
            given = shares({p: n[0] for p, n in counted.items() if n and n[0]}, self.most)
            if counted and not any(given.values()):  # fewer rows than files: one of them at a time
                given = {p: 1 for p, n in sorted(counted.items()) if n and n[0]}
                given = dict(list(given.items())[:1])
            last = {p: self._ask(p, f"SELECT {self.order} FROM {self.table} WHERE ({self.order}) > (?, ?) ORDER BY 1, 2 LIMIT 1 OFFSET {n - 1}", start[p]) for p, n in given.items() if n}
        after.update({p: list(row) for p, row in last.items() if row})
        return {"stores": json.dumps(after, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["stores"]), json.loads(end["stores"])
        self.position = after
        return [RowsBetween(p, before.get(p, FIRST), stop) for p, stop in sorted(after.items()) if before.get(p) != stop]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own = {"row_no": "rowid", "db_path": "?"}
        names = ", ".join(own.get(c, quoted(c)) for c in self.columns)
        query = f"SELECT {names} FROM {self.table} WHERE ({self.order}) > (?, ?) AND ({self.order}) <= (?, ?) ORDER BY {self.order}"
        paths = [partition.path] * self.columns.count("db_path")
        with closing(opened(partition.path)) as db:
            for row in db.execute(query, [*paths, *partition.start, *partition.end]):
                yield tuple(v if not isinstance(v, bytes) else v.decode("utf-8", "replace") for v in row)


class StoreTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_tail"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return StoreReader(schema, dict(self.options))


def tail_table(spark: SparkSession, paths: list[str], table: str, schema: str, order: str, max_rows: int | None = None) -> DataFrame:
    """A stream of the rows of a table of several SQLite files, with db_path and row_no, in the order of a whole-number column."""
    spark.dataSource.register(StoreTail)
    reader = spark.readStream.format("sqlite_tail").schema(f"{schema}, db_path string, row_no long").option("paths", json.dumps(paths)).option("table", table).option("order", order)
    return (reader.option("max_rows", str(max_rows)) if max_rows else reader).load()


def crush_stream(spark: SparkSession, projects: list[tuple[str, str]], max_rows: int | None = None) -> DataFrame:
    """The items of the growing databases of projects, for ``live.live_sessions`` (whose marks have times here)."""
    messages = tail_table(spark, [d for d, _ in projects], "messages", MESSAGE, "created_at", max_rows)
    return crush_items(placed_messages(spark, messages, projects))

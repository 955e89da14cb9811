"""Stores that grow: rows tied at the last time, batches that run again, and the same sessions as a whole read gives."""

import json
import os
import sqlite3

from spanforge.sources import stores
from spanforge.streaming import live
from spanforge.streaming.stores import StoreReader, crush_stream, tail_table
from tests.test_streaming import calls_of, run


def call(i, name="view"):
    return {"type": "tool_call", "data": {"id": i, "name": name, "input": '{"path":"/proj/x.go"}'}}


def answer(i, content):
    return {"type": "tool_result", "data": {"tool_call_id": i, "content": content}}


def said(text):
    return {"type": "text", "data": {"text": text}}


class Store:
    def __init__(self, path):
        self.path = str(path)
        self.db = sqlite3.connect(path)
        self.db.execute("PRAGMA journal_mode=WAL")
        self.db.execute("CREATE TABLE sessions (id TEXT PRIMARY KEY, parent_session_id TEXT, title TEXT, created_at INTEGER, updated_at INTEGER)")
        self.db.execute("CREATE TABLE messages (id TEXT PRIMARY KEY, session_id TEXT, role TEXT, parts TEXT, model TEXT, created_at INTEGER)")
        self.db.execute("INSERT INTO sessions VALUES ('s', NULL, 'T', 100, 900)")
        self.db.commit()
        self.n = 0

    def add(self, at, role, *parts):
        self.n += 1
        self.db.execute("INSERT INTO messages VALUES (?,?,?,?,?,?)", (f"m{self.n}", "s", role, json.dumps(parts), None, at))
        self.db.commit()


def test_sessions_in_steps_equal_a_whole_read(spark, tmp_path):
    store, out = Store(tmp_path / "crush.db"), str(tmp_path / "out")
    projects = [(store.path, "/proj"), (str(tmp_path / "missing.db"), "/none")]
    steps = [
        [(101, "user", said("hello")), (102, "assistant", call("a"))],
        [(102, "assistant", call("b", "bash"))],  # tied with the last row given out
        [(102, "tool", answer("a", "A")), (103, "tool", answer("b", "B")), (103, "user", said("more"))],
        [(103, "assistant", call("a")), (104, "tool", answer("a", "again")), (104, "assistant", call("open"))],
    ]
    seen = []
    for step in steps:
        for row in step:
            store.add(*row)
        run(live.live_sessions(crush_stream(spark, projects), idle_after=1e9, marks_have_times=True), str(tmp_path / "state"), out)
        seen.append(spark.read.parquet(out).count() if os.listdir(out) else 0)
    run(live.live_sessions(crush_stream(spark, projects), idle_after=1e9, marks_have_times=True), str(tmp_path / "state"), out)
    got = spark.read.parquet(out).collect()
    batch = stores.crush(spark, projects[:1])
    assert seen == [0, 0, 2, 3] and calls_of(got) == calls_of(batch.calls.where("open = 0").collect())
    assert sorted((m["seq"], m["type"], m["note"], m["ts"]) for r in got for m in r["marks"]) == sorted((m["seq"], m["type"], m["note"], m["ts"]) for m in batch.marks.collect())


def test_ties_budgets_and_replays(tmp_path):
    one, two = Store(tmp_path / "1.db"), Store(tmp_path / "2.db")
    for k in range(20):
        one.add(100 + k // 7, "user", said(str(k)))
    two.add(None, "user", said("no time"))
    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType().add("id", StringType()).add("db_path", StringType()).add("row_no", LongType())
    options = {"paths": json.dumps([one.path, two.path, str(tmp_path / "none.db")]), "table": "messages", "order": "created_at", "max_rows": "6"}
    reader = StoreReader(schema, options)
    at, rows, batches = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != at:
        parts = reader.partitions(at, end)
        got = [r for p in parts for r in reader.read(p)]
        one.add(105, "user", said("meanwhile")) if len(batches) == 1 else None
        assert got == [r for p in parts for r in reader.read(p)]  # a batch that runs again
        rows += got
        batches.append(len(got))
        reader = StoreReader(schema, options)  # a restart tells the new reader where the query is
        reader.partitions(end, end)
        at = end
    assert [r[0] for r in rows if r[1] == one.path] == [f"m{k}" for k in range(1, 22)] and [r[0] for r in rows if r[1] == two.path] == ["m1"]
    assert max(batches) <= 6 and len(batches) == 4


def test_table_stream(spark, tmp_path):
    store, out = Store(tmp_path / "1.db"), str(tmp_path / "out")
    for k in range(5):
        store.add(100, "user", said(str(k)))
        run(tail_table(spark, [store.path], "messages", "id string", "created_at"), str(tmp_path / "state"), out)
    assert sorted(r["row_no"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]

"""The live tail: what arrives in pieces is what a whole read gives, each row once."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from spanforge.sources import claude
from spanforge.streaming import live
from spanforge.streaming.tail import TailReader, shares, tail_lines


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content, **more}


def line(role, items, second, **more):
    return json.dumps({"type": role, "timestamp": f"2024-01-01T00:00:{second:02d}Z", "sessionId": "s1", "message": {"role": role, "content": items}} | more) + "\n"


def run(stream, state, out, **trigger):
    """Whatever there is now, in a query of its own that goes on from the last one's checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    assert query.awaitTermination(240) and query.exception() is None
    return query


def session(spark, folder, idle_after=1e9, **more):
    return live.live_sessions(live.claude_items(spark, str(folder), **more), idle_after=idle_after)


def calls_of(rows):
    return sorted((r["seq"], r["call_id"], r["tool"], r["input"], r["ts"], r["cwd"], r["content"], r["is_error"]) for r in rows)


def test_log_in_five_steps_equals_a_whole_read(spark, tmp_path):
    folder, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    steps = [
        line("user", "fix it", 1, cwd="/w/app") + line("assistant", [use("a", "Read", file_path="/w/app/a.go")], 2),
        line("assistant", [use("b", "Bash", command="go test ./..."), use("t", "Task", prompt="x")], 3)[:50],
        line("assistant", [use("b", "Bash", command="go test ./..."), use("t", "Task", prompt="x")], 3)[50:] + line("user", [result("b", "FAIL", is_error=True), result("a", "text")], 4) + "{broken\n" + line("user", "and now é", 5),
        line("system", [], 6, subtype="compact_boundary") + line("assistant", [use("a", "Edit", file_path="/w/app/src/b.go")], 7, cwd="/elsewhere") + line("user", [result("zz", "no call")], 7),
        line("user", [result("a", "ok"), result("t", "done")], 8) + line("assistant", [use("open", "Read", file_path="c.go")], 9) + line("user", "last words", 9),
    ]
    (folder / "agent-x.jsonl").write_text(line("user", "left out", 1))
    seen = []
    for step in steps:
        with (folder / "s.jsonl").open("a") as f:
            f.write(step)
        run(session(spark, folder), state, out)
        seen.append(spark.read.parquet(out).count() if os.listdir(out) else 0)
    run(session(spark, folder), state, out)
    got = spark.read.parquet(out).collect()
    batch = claude.read(spark, str(folder))
    want = batch.calls.where("open = 0").collect()
    assert seen == [0, 0, 2, 2, 4] and calls_of(got) == calls_of(want) and {r["session_key"] for r in got} == {want[0]["session_key"]}
    assert {r["cwd"] for r in got} == {"/w/app"}  # of the head, batches ago
    marks = sorted((r["seq"], r["type"], r["note"]) for r in batch.marks.collect())
    ridden = sorted((m["seq"], m["type"], m["note"]) for r in got for m in r["marks"])
    assert ridden == [m for m in marks if m[0] < 4] and marks[-1] == (4, "user-message", "last words")


def test_rewritten_log(spark, tmp_path):
    folder, state, out = tmp_path / "logs", str(tmp_path / "state"), str(tmp_path / "out")
    folder.mkdir()
    log = folder / "s.jsonl"
    log.write_text(line("user", "hello " * 50, 1, cwd="/w") + line("assistant", [use("a", "Read")], 2) + line("user", [result("a", "A")], 3))
    run(session(spark, folder), state, out)
    log.write_text(line("assistant", [use("b", "Grep")], 4) + line("user", [result("b", "B")], 5))  # shorter
    run(session(spark, folder), state, out)
    log.write_text(line("assistant", [use("c", "LS")], 6) + line("user", [result("c", "C" * 900)], 7))  # longer, but other bytes
    run(session(spark, folder), state, out)
    with log.open("a") as f:
        f.write(line("assistant", [use("d", "Edit")], 8) + line("user", [result("d", "D")], 9))
    run(session(spark, folder), state, out)
    got = spark.read.parquet(out).orderBy("seq").collect()
    assert [(r["seq"], r["call_id"], r["content"][:1], r["cwd"]) for r in got] == [(0, "a", "A", "/w"), (1, "b", "B", "/w"), (2, "c", "C", "/w"), (3, "d", "D", "/w")]


def test_idle_and_forgotten(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    (folder / "s.jsonl").write_text(line("assistant", [use("a", "Read"), use("b", "Bash")], 1) + line("user", [result("a", "A")], 2) + line("user", "still there?", 3))
    stream = live.live_sessions(live.claude_items(spark, str(folder)), idle_after=1, forget_after=1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 120
        got = []
        while time.time() < until and not any(r["state"] == "gone" for r in got):
            time.sleep(1)
            got = spark.read.parquet(out).collect() if os.path.isdir(f"{out}/_spark_metadata") and os.listdir(f"{out}/_spark_metadata") else []
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    order = {"event": 0, "idle": 1, "open": 2, "gone": 3}
    got = sorted(got, key=lambda r: order[r["state"]])
    assert [(r["state"], r["seq"], r["call_id"]) for r in got] == [("event", 0, "a"), ("idle", None, None), ("open", 1, "b"), ("gone", None, None)]
    assert all(str(r["last_activity"]) == "2024-01-01 00:00:03" for r in got) and [m["note"] for m in got[3]["marks"]] == ["still there?"]
    assert state <= 3  # what goes on, and no open call, mark or timer
    assert [r["state"] for r in live.activity(spark.createDataFrame(got, live.LIVE)).collect()] == ["active", "idle", "active", "gone"]


def test_backlog_of_ten_budgets(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.jsonl").write_text("".join(f'{{"n": "{k * 1000 + i:06d}"}}\n' for i in range(250)))  # 16 bytes a line, 16,000 in all
    stream = tail_lines(spark, str(folder), max_bytes=1600)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        batches = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    finally:
        query.stop()
    got = spark.read.parquet(out)
    assert sum(batches) == 1000 and 10 <= len(batches) <= 11 and max(batches) <= 100
    assert sorted(int(json.loads(r["line"])["n"]) for r in got.collect()) == [k * 1000 + i for k in range(4) for i in range(250)]
    # A restart goes on from where the query was, still by budgets.
    with (folder / "0.jsonl").open("a") as f:
        f.write('{"n": 9}\n' * 300)
    query = tail_lines(spark, str(folder), max_bytes=1600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", out).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        assert max(p["numInputRows"] for p in query.recentProgress) <= 178
    finally:
        query.stop()
    assert spark.read.parquet(out).count() == 1300


def test_shares():
    assert shares({"a": 10, "b": 1000, "c": 1000}, 210) == {"a": 10, "b": 100, "c": 100} and shares({"a": 5}, 100) == {"a": 5} and shares({}, 9) == {}


@pytest.mark.parametrize("most", [None, 10])
def test_reader_takes_complete_lines(tmp_path, most):
    log = tmp_path / "a.jsonl"
    log.write_bytes(b"x" * 100_000 + b"\n" + b"half")
    reader = TailReader(str(tmp_path), ".jsonl", most)
    end = reader.latestOffset()
    parts = reader.partitions(reader.initialOffset(), end)
    assert [r[2:4] for p in parts for r in reader.read(p)] == [(0, 100_001)]
    assert reader.latestOffset() == end  # the half line waits
    with log.open("ab") as f:
        f.write(b" done\r\nnext\n")
    after = reader.latestOffset()
    rows = [r for p in reader.partitions(end, after) for r in reader.read(p)]
    while (later := reader.latestOffset()) != after:
        rows += [r for p in reader.partitions(after, later) for r in reader.read(p)]
        after = later
    assert [r[4] for r in rows] == ["half done", "next"]


def test_classified_in_the_stream_as_in_a_batch(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    script = 'const r = await tools.exec_command({"cmd": "go test ./...", "workdir": "/w/app"});'
    (folder / "s.jsonl").write_text(
        line("user", "go", 1, cwd="/w/app") + line("assistant", [use("a", "Read", file_path="/w/app/src/a.go", offset=3, limit=2), use("b", "Bash", command="rg -n foo src"), use("c", "exec", code=script)], 2)
        + line("user", [result("a", "x"), result("b", "src/a.go:3:foo"), result("c", "PASS", is_error=False)], 3))
    run(live.live_events(session(spark, folder)), str(tmp_path / "state"), out)
    columns = ["seq", "tool", "action", "targets", "outside", "result_bytes", "summary", "is_error", "ts"]
    got = spark.read.parquet(out).select(*columns).orderBy("seq").collect()
    want = claude.read(spark, str(folder)).events().select(*columns).orderBy("seq").collect()
    assert got == want and [r["action"] for r in got] == ["read", "search", "verify"]

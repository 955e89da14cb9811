import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from spanforge.operators.classify import ClassifyOptions
from spanforge.operators.sessions import by_recency, children, depths, idle, last_activity, list_filtered, roots
from spanforge.operators.trace import trace_json
from spanforge.sources import claude, codex, pi, registry, stores
from spanforge.sources.lines import json_lines
from spanforge.sources.sqlite import read_table, split_path


def write(path, *rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + end)


def use(i, name, **given):
    return {"type": "tool_use", "id": i, "name": name, "input": given}


def result(i, content, **more):
    return {"type": "tool_result", "tool_use_id": i, "content": content, **more}


def line(role, items, ts, **more):
    return {"type": role, "timestamp": ts, "sessionId": "s1", "cwd": "/w/app", "message": {"role": role, "model": "m1" if role == "assistant" else "", "content": items}, **more}


@pytest.fixture()
def claude_root(tmp_path):
    write(
        tmp_path / "p" / "one.jsonl",
        line("user", "fix the login", "2024-01-01T00:00:00Z", gitBranch="main"),
        line("assistant", [use("a", "Read", file_path="/w/app/src/login.go", offset=3, limit=2)], "2024-01-01T00:00:01Z"),
        line("user", [result("a", "text")], "2024-01-01T00:00:02Z"),
        "{broken",
        {"type": "system", "subtype": "Compact_boundary", "timestamp": "2024-01-01T00:00:03Z"},
        line("assistant", [use("b", "Edit", file_path="/w/app/src/login.go"), use("c", "Bash", command="go test ./..."), use("t", "Task", prompt="x")], "2024-01-01T00:00:04Z"),
        line("user", [result("c", [{"type": "text", "text": "FAIL é"}], is_error=True), result("b", "ok"), result("zz", "no call")], "2024-01-01T00:00:05Z"),
        {"type": "ai-title", "aiTitle": "Login fix", "timestamp": "2024-01-01T00:00:06Z"},
        line("assistant", [use("b", "Grep", path="src")], "2024-01-01T00:00:07Z"),
        line("user", "<system>injected</system>", "2024-01-01T00:00:08Z"), end="")
    write(tmp_path / "p" / "agent-x.jsonl", line("user", "sub", "2024-01-01T00:00:00Z"))
    write(tmp_path / "p" / "side.jsonl", line("user", "side", "2024-01-02T00:00:00Z", isSidechain=True, agentId="A1"))
    write(tmp_path / "p" / "other.jsonl", {"hello": 1})
    write(tmp_path / "p" / "note.txt", "x")
    return str(tmp_path)


def test_claude_session(spark, claude_root):
    got = claude.read(spark, claude_root)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in got.sessions.collect()}
    assert set(rows) == {"one.jsonl", "side.jsonl"} and [r["session_id"] for r in got.listed().collect()] == ["s1"]
    one = rows["one.jsonl"]
    assert (one["title"], one["model"], one["git_branch"], one["cwd"]) == ("Login fix", "m1", "main", "/w/app")
    assert (one["started_at"], one["ended_at"]) == ("2024-01-01T00:00:00Z", "2024-01-01T00:00:08Z") and rows["side.jsonl"]["is_sidechain"] and rows["side.jsonl"]["agent_id"] == "A1"


def test_claude_events_marks_and_trace(spark, claude_root):
    got = claude.read(spark, claude_root)
    key = got.listed().first()["session_key"]
    events = [r for r in got.events().orderBy("seq").collect() if r["session_key"] == key]
    assert [(e["seq"], e["tool"], e["action"], e["is_error"]) for e in events] == [(0, "Read", "read", False), (1, "Bash", "verify", True), (2, "Edit", "edit", False), (3, "Task", "other", False), (4, "Grep", "search", False)] or \
        [(e["tool"]) for e in events] == ["Read", "Bash", "Edit", "Grep", "Task"]
    read = events[0]
    assert [(t["path"], t["touch"], t["lines"]) for t in read["targets"]] == [("src/login.go", "read", [[3, 4]])] and read["ts"] == "2024-01-01T00:00:01Z"
    assert events[1]["result_bytes"] == len("FAIL é".encode()) and events[1]["summary"] == "go test ./... -> 0 targets, 0 outside error"
    marks = [(m["type"], m["seq"], m["note"], m["ts"]) for m in got.marks.orderBy("pos").collect() if m["session_key"] == key]
    assert marks == [("user-message", 0, "fix the login", ""), ("compaction", 1, "", ""), ("subagent", 1, "Task", "")]
    spans = [s for s in got.spans().orderBy("place").collect() if s["session_key"] == key]
    assert [s["name"] for s in spans][:2] == ["fix the login", "/w/app/src/login.go -> 1 targets, 0 outside"] or spans[1]["name"] == "Read -> 1 targets, 0 outside"
    assert all(s["parent_span_id"] == spans[0]["span_id"] for s in spans[1:]) and all(s["end_time"] >= s["start_time"] for s in spans)
    out = json.loads(trace_json(got.sessions, got.spans()).where(F.col("session_key") == key).first()["json"])
    assert out["spans"][1]["attributes"]["agent.result.bytes"] == 4 and "parentSpanId" not in out["spans"][0] and out["session"]["id"] == "s1"
    assert got.spans().exceptAll(got.spans()).isEmpty()


def test_complete_lines_only(spark, tmp_path):
    write(tmp_path / "x.jsonl", '{"a":1}', '{"b"', end="")
    assert [(r["line"], r["end_offset"]) for r in json_lines(spark, str(tmp_path), complete=True).collect()] == [('{"a":1}', 8)]
    assert json_lines(spark, str(tmp_path)).count() == 2


def test_repo_files_drop_weak_targets(spark, claude_root):
    calls = spark.createDataFrame([("s", 0, "Bash", '{"command":"cat a.go b.go"}', "", False, "/w")], "session_key string, seq long, tool string, input string, content string, is_error boolean, cwd string")
    files = spark.createDataFrame([("/w", "a.go")], "cwd string, path string")
    from spanforge.operators.classify import build_events

    assert [t["path"] for t in build_events(calls, repo_files=files).first()["targets"]] == ["a.go"]
    assert [t["path"] for t in build_events(calls).first()["targets"]] == ["a.go", "b.go"]
    home = build_events(calls.withColumn("tool", F.lit("Read")).withColumn("input", F.lit('{"file_path":"/h/x"}')), ClassifyOptions(home="/h")).first()
    assert [(o["scope"], o["path"]) for o in home["outside"]] == [("home", "/h/x")] and home["targets"] == []


def test_codex(spark, tmp_path):
    item = lambda ts, **p: {"type": "response_item", "timestamp": ts, "payload": p}
    write(
        tmp_path / "sessions" / "r.jsonl",
        {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"id": "x1", "cwd": "/w/app", "git": {"branch": "b1"}, "source": {"cli": 1}}},
        {"type": "turn_context", "payload": {"model": "g", "cwd": "/other"}},
        item("2024-01-01T00:00:01Z", type="message", role="user", content=[{"type": "input_text", "text": " do it "}]),
        item("2024-01-01T00:00:02Z", type="function_call", call_id="c1", name="exec_command", arguments='{"cmd":"cat src/a.go","workdir":"/w/app"}'),
        item("2024-01-01T00:00:03Z", type="function_call", call_id="c1", name="exec_command", arguments='{"cmd":"second"}'),
        item("2024-01-01T00:00:04Z", type="function_call_output", call_id="c1", output="Exit code: 1\nOutput:\nx"),
        item("2024-01-01T00:00:05Z", type="function_call_output", call_id="c1", output="later"),
        item("2024-01-01T00:00:06Z", type="custom_tool_call", call_id="c2", name="apply_patch", input="*** Begin Patch\n*** Update File: old.go"),
        {"type": "event_msg", "payload": {"type": "patch_apply_end", "call_id": "c2", "success": False, "changes": {"src/z.go": {"type": "add"}, "src/b.go": {"type": "update"}}}},
        {"type": "event_msg", "timestamp": "2024-01-01T00:00:07Z", "payload": {"type": "context_compacted"}},
        item("2024-01-01T00:00:08Z", type="function_call", call_id="c3", name="spawn_agent", arguments="not json"))
    write(tmp_path / "sessions" / "sub.jsonl", {"type": "session_meta", "payload": {"id": "x2", "source": {"subagent": "review"}}})
    write(tmp_path / "session_index.jsonl", {"id": "x1", "thread_name": "Old"}, {"id": "x1", "thread_name": "Named"})
    got = codex.read(spark, str(tmp_path / "sessions"), str(tmp_path / "session_index.jsonl"))
    meta = got.listed().collect()
    assert [(m["session_id"], m["title"], m["cwd"], m["model"], m["git_branch"]) for m in meta] == [("x1", "Named", "/w/app", "g", "b1")]
    events = got.events().orderBy("seq").collect()
    assert [(e["tool"], e["action"], e["is_error"], [t["path"] for t in e["targets"]]) for e in events] == [
        ("exec_command", "read", True, ["src/a.go"]), ("apply_patch", "edit", True, ["old.go", "src/b.go", "src/z.go"]), ("spawn_agent", "other", False, [])]
    marks = [(m["type"], m["seq"], m["note"]) for m in got.marks.orderBy("seq", "pos").collect()]
    assert marks == [("user-message", 0, "do it"), ("compaction", 2, ""), ("subagent", 2, "spawn_agent")] or marks == [("user-message", 0, "do it"), ("compaction", 2, ""), ("subagent", 3, "spawn_agent")]


def test_pi_takes_the_way_to_the_leaf(spark, tmp_path):
    e = lambda i, p, kind, **k: {"type": kind, "id": i, "parentId": p, "timestamp": f"2024-01-01T00:00:{int(i[1:]):02d}Z", **k}
    msg = lambda role, **k: {"message": {"role": role, **k}}
    write(
        tmp_path / "s.jsonl", {"type": "session", "id": "p1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w"},
        e("e1", None, "message", **msg("user", content="first   words")), e("e2", "e1", "message", **msg("assistant", model="m", content=[{"type": "toolCall", "id": "k", "name": "read", "arguments": {"path": "dropped.go"}}])),
        e("e3", "e1", "message", **msg("assistant", model="m2", content=[{"type": "toolCall", "id": "k", "name": "read", "arguments": {"path": "a.go"}}])), e("e4", "e3", "message", **msg("toolResult", toolCallId="k", content="ok", isError=True)),
        e("e5", "e4", "message", **msg("bashExecution", command="ls", output="x", exitCode=2)), e("e6", "e5", "branch_summary", summary="went left"))
    write(tmp_path / "bad.jsonl", {"type": "message"})
    got = pi.read(spark, str(tmp_path))
    meta = got.sessions.collect()
    assert [(m["session_id"], m["title"], m["model"], m["ended_at"]) for m in meta] == [("p1", "first words", "m2", "2024-01-01T00:00:06Z")]
    assert [(c["tool"], c["is_error"], [t["path"] for t in c["targets"]]) for c in got.events().orderBy("seq").collect()] == [("read", True, ["a.go"]), ("bash", True, [])]
    assert [(m["type"], m["seq"], m["note"]) for m in got.marks.orderBy("pos").collect()] == [("user-message", 0, "first words"), ("compaction", 2, "branch: went left")] or got.marks.count() == 2


def test_linearize_cycles_and_missing_parents(spark):
    rows = [("c", 0, "a", "b"), ("c", 1, "b", "a"), ("m", 0, "x", "gone"), ("m", 1, "y", "x"), ("n", 0, "", ""), ("n", 1, "", "")]
    got = pi.linearize(spark.createDataFrame(rows, "session_key string, line_no long, id string, parent_id string"))
    ways = {}
    for r in got.orderBy("session_key", "pos").collect():
        ways.setdefault(r["session_key"], []).append(r["line_no"])
    assert ways == {"c": [0, 1], "m": [0, 1], "n": [0, 1]}


@pytest.fixture()
def crush_db(tmp_path):
    path = tmp_path / "data" / "crush.db"
    path.parent.mkdir()
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE sessions (id TEXT PRIMARY KEY, parent_session_id TEXT, title TEXT, created_at INTEGER, updated_at INTEGER)")
    db.execute("CREATE TABLE messages (id TEXT PRIMARY KEY, session_id TEXT, role TEXT, parts TEXT, model TEXT, created_at INTEGER)")
    db.executemany("INSERT INTO sessions VALUES (?,?,?,?,?)", [("aaaabbbbcccc", None, "Untitled Session", 100, 200), ("kid", "aaaabbbbcccc", "Kid", 150, 160), ("late", "", "Late", 900, 950)])
    parts = json.dumps([{"type": "tool_call", "data": {"id": "1", "name": "view", "input": '{"path":"/proj/x.go"}'}}, {"type": "tool_call", "data": {"id": "2", "name": "bash", "input": "raw text"}}])
    db.executemany("INSERT INTO messages VALUES (?,?,?,?,?,?)", [
        ("m1", "aaaabbbbcccc", "user", json.dumps([{"type": "text", "data": {"text": "hello"}}]), None, 100), ("m2", "aaaabbbbcccc", "assistant", parts, "mod", 101),
        ("m3", "aaaabbbbcccc", "tool", json.dumps([{"type": "tool_result", "data": {"tool_call_id": "1", "content": "ok"}}]), None, 102), ("m4", "aaaabbbbcccc", "tool", "broken", None, 103)])
    db.commit()
    db.close()
    (tmp_path / "projects.json").write_text(json.dumps({"projects": [{"path": "/proj", "data_dir": str(path.parent)}, {"path": "/gone", "data_dir": str(tmp_path / "none")}]}))
    return str(tmp_path / "projects.json")


def test_crush(spark, crush_db):
    got = stores.crush(spark, stores.crush_projects(crush_db))
    meta = {m["session_id"]: m for m in got.sessions.collect()}
    assert meta["aaaabbbbcccc"]["title"] == "proj — aaaabbbb" and meta["aaaabbbbcccc"]["model"] == "mod" and meta["kid"]["auxiliary"] and meta["late"]["started_at"] == "1970-01-01T00:15:00Z"
    events = got.events().orderBy("seq").collect()
    assert [(e["tool"], [t["path"] for t in e["targets"]], e["result_bytes"]) for e in events] == [("view", ["x.go"], 2), ("bash", [], 0)]
    assert [(m["note"], m["seq"]) for m in got.marks.collect()] == [("hello", 0)]
    assert stores.crush_projects(crush_db, "/elsewhere") == []


def test_pushdown_gives_the_same_rows(spark, crush_db):
    from datetime import UTC, datetime

    projects = stores.crush_projects(crush_db)
    since = datetime.fromtimestamp(150, UTC)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = stores.crush_sessions(spark, projects, since).select("session_id").orderBy("session_id").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    plain = stores.crush_sessions(spark, projects, since).select("session_id").orderBy("session_id").collect()
    assert pushed == plain and [r[0] for r in plain] == ["kid", "late"]


def test_missing_database_has_no_rows_and_is_not_made(spark, tmp_path):
    path = str(tmp_path / "none.db")
    assert read_table(spark, [path], "session", "id string").count() == 0 and not os.path.exists(path)


def test_failure_in_the_middle_is_no_short_table(spark, tmp_path):
    path = str(tmp_path / "v.db")
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE t (id TEXT); INSERT INTO t VALUES ('a'), ('b'); CREATE TABLE s (rowid INTEGER PRIMARY KEY, id TEXT); DROP TABLE s; CREATE VIEW s AS SELECT rowid AS rowid, CASE WHEN id = 'b' THEN json_extract('{', '$.x') ELSE id END AS id FROM t;")
    db.commit()
    db.close()
    with pytest.raises(Exception, match="malformed JSON"):
        read_table(spark, [path], "s", "id string").collect()


def test_opencode(spark, tmp_path):
    path = str(tmp_path / "opencode.db")
    db = sqlite3.connect(path)
    db.executescript("""
        CREATE TABLE session (id TEXT, parent_id TEXT, directory TEXT, title TEXT, model TEXT, time_created INTEGER, time_updated INTEGER);
        CREATE TABLE message (id TEXT, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT);
        CREATE TABLE part (id TEXT, message_id TEXT, session_id TEXT, time_created INTEGER, time_updated INTEGER, data TEXT);""")
    db.execute("INSERT INTO session VALUES ('s', NULL, '/proj', '', '{\"id\":\"mm\"}', 1000, 9500)")
    tool = lambda call, status, **s: json.dumps({"type": "tool", "tool": "read", "callID": call, "state": {"status": status, "input": {"file_path": "/proj/a.go"}, **s}})
    db.executemany("INSERT INTO message VALUES (?,?,?,?,?)", [(i, "s", t, t, json.dumps({"role": r, "content": c})) for i, t, r, c in [("m0", 1000, "user", "before"), ("m1", 2000, "assistant", ""), ("m2", 3500, "user", [{"type": "text", "text": "between"}]), ("m3", 4000, "assistant", ""), ("m4", 9000, "user", "after")]])
    db.executemany("INSERT INTO part VALUES (?,?,?,?,?,?)", [
        ("p1", "m1", "s", 2001, 0, tool("c1", "completed", output="four")), ("p2", "m3", "s", 4001, 0, tool("c2", "error", error="bad")), ("p3", "m3", "s", 4002, 0, '{"type":"subtask","agent":"helper"}'), ("p4", "m3", "s", 4003, 0, '{"type":"tool","tool":"","callID":"x"}')])
    db.commit()
    db.close()
    got = stores.opencode(spark, path)
    assert [(m["title"], m["model"], m["ended_at"]) for m in got.sessions.collect()] == [("proj — s", "mm", "1970-01-01T00:00:09.5Z")]
    assert [(e["seq"], e["result_bytes"], e["is_error"], e["targets"][0]["path"]) for e in got.events().orderBy("seq").collect()] == [(0, 4, False, "a.go"), (1, 3, True, "a.go")]
    assert sorted((m["note"], m["seq"]) for m in got.marks.collect()) == [("after", 2), ("before", 0), ("between", 1), ("helper", 2)]
    assert split_path("/a/b.db/s") == ("/a/b.db", "s") and split_path("s") == ("", "")


def test_listing_idle_and_graph(spark):
    rows = [("k1", "s1", "", "/home/joe/p", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), ("k2", "s2", "s1", "/home/joey", "garbage", ""), ("k3", "s3", "gone", "/home/joe", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z")]
    from datetime import datetime

    from spanforge.operators.sessions import agent_nodes, with_times

    s = with_times(spark.createDataFrame(rows, "session_key string, session_id string, parent_id string, cwd string, started_at string, ended_at string"))
    assert {r["session_key"] for r in list_filtered(s, "/home/joe/").collect()} == {"k1", "k3"} and list_filtered(s).count() == 3
    assert [r["session_key"] for r in list_filtered(s, since=datetime(2024, 1, 2)).collect()] == ["k3"] and list_filtered(s, "/").count() == 0
    assert [r["session_key"] for r in by_recency(s).collect()] == ["k3", "k1", "k2"]
    nodes = agent_nodes(s.withColumn("harness", F.lit("h")).withColumn("title", F.lit("t")))
    assert [r["session_id"] for r in roots(nodes).collect()] == ["s1"] and {r["parent_id"]: r["children"] for r in children(nodes).collect()} == {"s1": ["s2"], "gone": ["s3"]}
    assert {(r["session_id"], r["depth"]) for r in depths(nodes).collect()} == {("s1", 0), ("s2", 1)}
    events = spark.createDataFrame([("k1", 0, "2024-01-01T00:10:00Z")], "session_key string, seq long, ts string")
    marks = spark.createDataFrame([("k1", "2024-01-01T00:20:00Z")], "session_key string, ts string")
    got = {r["session_key"]: r["idle"] for r in idle(last_activity(events, marks, s), F.lit("2024-01-01 00:20:30"), 30).collect()}
    assert got == {"k1": False, "k2": True, "k3": False}


def test_registry(spark, tmp_path):
    write(tmp_path / ".pi/agent/sessions/s.jsonl", {"type": "session", "id": "p1", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w"})
    (tmp_path / ".codex").mkdir()
    (tmp_path / ".codex" / "sessions").write_text("x")
    got = registry.read_all(spark, str(tmp_path))
    assert "pi" in got and got["pi"].sessions.count() == 1
    status = {r["harness"]: r["status"] for r in registry.diagnostics(spark, str(tmp_path)).collect()}
    assert status == {"claude-code": "warn", "codex": "error", "crush": "warn", "opencode": "warn", "pi": "ok"}
    assert registry.check(registry.SOURCES["pi"], " ")[2] == "error"

"""Listings that leave files unread, and probes that tell what can't be read."""

import json
import sqlite3
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from spanforge.operators.sessions import list_filtered
from spanforge.sources import claude, codex, pi, registry


def line(kind, stamp, cwd="", **more):
    return json.dumps({"type": kind, "timestamp": stamp, "sessionId": "s", "cwd": cwd, "message": {"role": kind, "content": "hi"}} | more) + "\n"


@pytest.fixture()
def logs(tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    for k, (stamp, cwd) in enumerate([("2024-01-01T00:00:00Z", "/a"), ("2024-03-01T00:00:00Z", "/a/b"), ("2024-03-02T00:00:00Z", "/ab"), ("garbage", "/a"), ("", "/a")]):
        (folder / f"{k}.jsonl").write_text(line("user", stamp, cwd) + line("assistant", "2024-04-01T00:00:00Z", "/late"))
    # The head doesn't tell: the file has to be read.
    (folder / "5.jsonl").write_text(json.dumps({"type": "x"}) + "\n" + ("{}\n" * 200) + line("user", "2024-05-01T00:00:00Z", "/a"))
    (folder / "6.jsonl").write_text(line("user", "2024-01-01T00:00:00Z", "/elsewhere")[:-1])  # never ended
    return str(folder)


def opened(df):
    return sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())


def test_filters_leave_files_unread(spark, logs):
    whole = claude.read(spark, logs)
    assert len(opened(whole.sessions)) == 7
    since = datetime(2024, 2, 1, tzinfo=UTC)
    for given, files in (({"since": since}, 5), ({"cwd": "/a", "since": since}, 4), ({"cwd": "/none"}, 2)):
        got = claude.read(spark, logs, **given)
        want = sorted(r["path"] for r in list_filtered(whole.sessions, **given).collect())
        assert sorted(r["path"] for r in got.sessions.collect()) == want and len(opened(got.sessions)) == files, given
    got = claude.read(spark, logs, cwd="/a")
    keys = sorted(r["session_key"] for r in got.sessions.collect())
    assert len(opened(got.sessions)) == 6 and sorted(r["session_key"] for r in got.marks.select("session_key").distinct().collect()) == keys and len(keys) == 5


def test_other_logs(spark, tmp_path):
    for name, day, cwd in (("a", "01", "/x"), ("b", "20", "/x/y"), ("c", "25", "/z")):
        (tmp_path / f"c-{name}.jsonl").write_text(json.dumps({"type": "session_meta", "timestamp": f"2024-01-{day}T00:00:00Z", "payload": {"id": name, "cwd": cwd}}) + "\n")
        (tmp_path / f"p-{name}.jsonl").write_text(json.dumps({"type": "session", "id": name, "timestamp": f"2024-01-{day}T00:00:00Z", "cwd": cwd}) + "\n")
    since = datetime(2024, 1, 10, tzinfo=UTC)
    for read, prefix in ((codex.read, "c-"), (pi.read, "p-")):
        got = read(spark, str(tmp_path), pattern=f"{prefix}*.jsonl", cwd="/x", since=since)
        assert [r["session_id"] for r in got.sessions.collect()] == ["b"] and opened(got.sessions) == [f"{prefix}b.jsonl"]
        assert read(spark, str(tmp_path), pattern=f"{prefix}*.jsonl", cwd="/nowhere").sessions.count() == 0


def test_read_all_and_other_sources(spark, tmp_path, logs):
    base = tmp_path / ".claude" / "projects"
    base.mkdir(parents=True)
    (base / "s.jsonl").write_text(line("user", "2024-01-01T00:00:00Z", "/a"))
    got = registry.read_all(spark, str(tmp_path), cwd="/b")
    assert got["claude-code"].sessions.count() == 0 and registry.read_all(spark, str(tmp_path), cwd="/a")["claude-code"].sessions.count() == 1
    own = registry.Source("own", "p", True, lambda spark, folder: claude.read(spark, folder))  # takes no filters
    assert own.sessions_of(spark, str(tmp_path), cwd="/ab").sessions.count() == 1


def test_diagnostics(spark, tmp_path):
    good, bad, short = tmp_path / "good", tmp_path / "bad", tmp_path / "short"
    for folder in (good, bad, short):
        folder.mkdir()
    with sqlite3.connect(good / "crush.db") as db:
        db.executescript("CREATE TABLE sessions (id TEXT); CREATE TABLE messages (id TEXT); INSERT INTO sessions VALUES ('a');")
    (bad / "crush.db").write_bytes(b"not a database at all" * 100)
    with sqlite3.connect(short / "crush.db") as db:
        db.execute("CREATE TABLE sessions (id TEXT)")
    at = tmp_path / ".local/share/crush"
    at.mkdir(parents=True)
    (at / "projects.json").write_text(json.dumps({"projects": [{"path": "/p", "data_dir": str(d)} for d in (good, bad, short, tmp_path / "none")]}))
    (tmp_path / ".opencode").mkdir()
    (tmp_path / ".opencode" / "opencode.db").write_bytes(b"\x00" * 5000)
    got = registry.diagnostics(spark, str(tmp_path)).collect()
    stores = {r["detail"]: r["status"] for r in got if r["harness"] == "crush" and r["name"] == "store"}
    assert sorted(stores.values()) == ["error", "error", "ok", "warn"] and stores["1 sessions, 0 messages"] == "ok" and stores["no table messages"] == "error"
    by = {r["harness"]: r["status"] for r in got if r["harness"] != "crush"}
    assert by == {"claude-code": "warn", "codex": "warn", "opencode": "error", "pi": "warn"}
    (at / "projects.json").write_text("{broken")
    assert {r["status"] for r in registry.diagnostics(spark, str(tmp_path)).where(F.col("harness") == "crush").collect()} == {"error"}

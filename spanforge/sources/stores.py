"""Sessions, calls and marks of SQLite stores (harnesses crush and opencode)."""

from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import base_name
from spanforge.functions.text import content_text, injected, is_kind, millis_text, seconds_text, string_at, trim_space, truncate_runes, value_at, variant
from spanforge.operators.pairing import pair_latest
from spanforge.operators.sessions import STORE, session_key
from spanforge.session import checkpointed
from spanforge.sources.lines import text_field
from spanforge.sources.parsed import Parsed
from spanforge.sources.sqlite import read_table

CRUSH, OPENCODE = "crush", "opencode"
MESSAGE = "id string, session_id string, role string, parts string, model string, created_at long"
COLUMNS = ("session_key", "session_id", "harness", "path", "cwd", "model", "title", "git_branch", "started_at", "ended_at", "agent_id", "is_sidechain", "auxiliary", "parent_id")


def lower_bound(since: datetime, unit: int) -> int:
    """An instant in seconds (1) or milliseconds (1000) since 1970, rounded down: never excludes what the exact test keeps."""
    return int((since.timestamp() * unit) // 1)


def _fallback_title(title: Column, cwd: Column, ident: Column, untitled: str = "") -> Column:
    short = F.concat(base_name(cwd), F.lit(" — "), F.left(ident, F.lit(8)))
    return F.when((title == "") | (title == untitled), short).otherwise(title)


def _projects(path: str) -> list[tuple[str, str]]:
    try:
        with open(path, encoding="utf-8") as f:
            rows = json.load(f).get("projects") or []
    except (OSError, ValueError, AttributeError):
        return []
    return [(os.path.abspath(os.path.join(r["data_dir"], "crush.db")), r.get("path") or "") for r in rows if r.get("data_dir")]


def crush_databases(path: str) -> list[str]:
    """The databases that a projects file names, whether they are there or not."""
    return sorted({d for d, _ in _projects(path)})


def crush_projects(path: str, cwd: str | None = None) -> list[tuple[str, str]]:
    """(database, project) pairs of a projects file; with cwd, only projects that can hold sessions of it."""
    found = _projects(path)
    if cwd:
        root = os.path.normpath(cwd)
        found = [(d, p) for d, p in found if p and (os.path.normpath(p) == root or os.path.normpath(p).startswith(root + "/"))]
    return [(d, p) for d, p in found if os.path.isfile(d)]


def crush_sessions(spark: SparkSession, projects: list[tuple[str, str]], since: datetime | None = None) -> DataFrame:
    rows = read_table(spark, [d for d, _ in projects], "sessions", "id string, title string, parent_session_id string, created_at long, updated_at long", "created_at")
    if since is not None:
        rows = rows.where(F.col("created_at") >= lower_bound(since, 1))
    where = spark.createDataFrame(projects or [("", "")], "db_path string, cwd string").dropDuplicates(["db_path"])
    rows = rows.join(where, "db_path")
    path = F.concat("db_path", F.lit("/"), "id")
    parent = F.coalesce("parent_session_id", F.lit(""))
    blank = F.lit("")
    return rows.select(
        session_key(F.lit(CRUSH), path).alias("session_key"), F.col("id").alias("session_id"), F.lit(CRUSH).alias("harness"), path.alias("path"), "cwd", blank.alias("model"),
        _fallback_title(F.coalesce("title", blank), F.col("cwd"), F.col("id"), "Untitled Session").alias("title"), blank.alias("git_branch"), seconds_text(F.col("created_at")).alias("started_at"), seconds_text(F.col("updated_at")).alias("ended_at"),
        blank.alias("agent_id"), F.lit(False).alias("is_sidechain"), (parent != "").alias("auxiliary"), parent.alias("parent_id"))


def _object_or_raw(text: Column) -> Column:
    """The text of an object, or an object with the text under _raw; an empty text as an empty object."""
    return F.when(text == "", "{}").when(is_kind(variant(text), "OBJECT"), text).otherwise(F.to_json(F.struct(text.alias("_raw"))))


def crush_items(messages: DataFrame) -> DataFrame:
    """What happens in messages, row by row, for a batch and for a stream alike; the columns are those of ``claude.items``.

    messages: session_key, role, parts, created_at, row_no, cwd. Messages follow each other by time, those of one second by row."""
    x = F.col("x")
    rows = messages.withColumn("ts", seconds_text(F.col("created_at")))
    rows = rows.select("session_key", F.coalesce("created_at", F.lit(0)).alias("a"), F.col("row_no").alias("b"), "role", "ts", "cwd", F.posexplode(F.try_variant_get(variant(F.col("parts")), "$", "array<variant>")).alias("part_no", "x"))
    kind, data = string_at(x, "$.type"), value_at(x, "$.data")
    said = text_field(data, "text")
    is_mark = F.coalesce((kind == "text") & (F.col("role") == "user") & (trim_space(said) != "") & ~injected(said), F.lit(False))
    called = kind == "tool_call"
    return rows.where(kind.isin("tool_call", "tool_result") | is_mark).select(
        "session_key", F.struct(F.lit(0).cast("long").alias("g"), "a", "b", F.col("part_no").cast("long").alias("c")).alias("pos"), F.when(called, "call").when(kind == "tool_result", "result").otherwise("user-message").alias("kind"),
        F.when(called, text_field(data, "id")).otherwise(text_field(data, "tool_call_id")).alias("call_id"), text_field(data, "name").alias("tool"), _object_or_raw(text_field(data, "input")).alias("input"), "ts", "cwd", text_field(data, "content").alias("content"),
        F.lit(False).alias("is_error"), F.when(is_mark, truncate_runes(said, 2000, "…")).otherwise("").alias("note"))


def placed_messages(spark: SparkSession, messages: DataFrame, projects: list[tuple[str, str]]) -> DataFrame:
    """messages with session_key and the working directory of their database."""
    where = spark.createDataFrame(projects or [("", "")], "db_path string, cwd string").dropDuplicates(["db_path"])
    return messages.join(where, "db_path").withColumn("session_key", session_key(F.lit(CRUSH), F.concat("db_path", F.lit("/"), "session_id")))


def crush(spark: SparkSession, projects: list[tuple[str, str]], since: datetime | None = None, once: bool = False) -> Parsed:
    """All sessions of the databases of projects, as (database, working directory); with since, those created then or later. once: tables are written to the checkpoint folder first, so stores are opened once for each."""
    kept = checkpointed if once else lambda df: df
    sessions = kept(crush_sessions(spark, projects, since))
    messages = kept(placed_messages(spark, read_table(spark, [d for d, _ in projects], "messages", MESSAGE), projects))
    items = crush_items(messages)
    marks = items.where(F.col("kind") == "user-message").select("session_key", "pos", "ts", F.col("kind").alias("type"), "note")
    models = messages.where(F.col("model") != "").groupBy("session_key").agg(F.min_by("model", F.struct("created_at", "row_no")).alias("first_model"))
    named = sessions.join(models, "session_key", "left").withColumn("model", F.coalesce("first_model", "model")).select(*COLUMNS)
    return Parsed.of(named, pair_latest(items.where(F.col("kind").isin("call", "result")).drop("note")), marks)


def _paths(database: str | list[str]) -> list[str]:
    """Absolute and clean, as keys of sessions are made of them."""
    return [os.path.abspath(d) for d in ([database] if isinstance(database, str) else database)]


def opencode_sessions(spark: SparkSession, database: str | list[str], since: datetime | None = None) -> DataFrame:
    rows = read_table(spark, _paths(database), "session", "id string, parent_id string, directory string, title string, model string, time_created long, time_updated long", "time_created")
    if since is not None:
        rows = rows.where(F.col("time_created") >= lower_bound(since, 1000))
    path = F.concat("db_path", F.lit("/"), "id")
    blank, parent, cwd = F.lit(""), F.coalesce("parent_id", F.lit("")), F.coalesce("directory", F.lit(""))
    title = F.coalesce("title", blank)
    return rows.select(
        session_key(F.lit(OPENCODE), path).alias("session_key"), F.col("id").alias("session_id"), F.lit(OPENCODE).alias("harness"), path.alias("path"), cwd.alias("cwd"), F.coalesce(string_at(variant(F.col("model")), "$.id"), blank).alias("model"),
        F.when((title == "") & (cwd == ""), F.col("id")).otherwise(_fallback_title(title, cwd, F.col("id"))).alias("title"), blank.alias("git_branch"), millis_text(F.col("time_created")).alias("started_at"), millis_text(F.col("time_updated")).alias("ended_at"),
        blank.alias("agent_id"), F.lit(False).alias("is_sidechain"), (parent != "").alias("auxiliary"), parent.alias("parent_id"))


def opencode(spark: SparkSession, database: str | list[str], since: datetime | None = None, once: bool = False) -> Parsed:
    """All sessions of one database or several; with since, those created then or later. Calls and results share a part; users' messages are placed among events by time. once: as for crush."""
    kept = checkpointed if once else lambda df: df
    databases = _paths(database)
    sessions = kept(opencode_sessions(spark, databases, since))
    messages = kept(read_table(spark, databases, "message", "id string, session_id string, time_created long, data string"))
    parts = kept(read_table(spark, databases, "part", "id string, message_id string, session_id string, time_created long, data string"))
    key = session_key(F.lit(OPENCODE), F.concat("db_path", F.lit("/"), "session_id"))
    joined = parts.join(messages.select("db_path", F.col("id").alias("message_id"), F.col("time_created").alias("message_time")), ["db_path", "message_id"]).withColumn("session_key", key)
    order = Window.partitionBy("session_key").orderBy("message_time", "time_created", "row_no")
    joined = joined.withColumn("no", F.row_number().over(order).cast("long")).withColumn("v", variant(F.col("data"))).withColumn("ts", millis_text(F.col("time_created"))).join(sessions.select("session_key", "cwd"), "session_key")
    v, kind = F.col("v"), string_at(F.col("v"), "$.type")
    status = string_at(v, "$.state.status")
    raw, given = string_at(v, "$.state.raw"), F.to_json(value_at(v, "$.state.input"))
    tools = joined.where((kind == "tool") & (string_at(v, "$.tool") != "") & (string_at(v, "$.callID") != "")).select(
        "session_key", F.col("no").alias("pos"), string_at(v, "$.callID").alias("call_id"), string_at(v, "$.tool").alias("tool"), F.when(is_kind(variant(raw), "OBJECT"), raw).otherwise(F.coalesce(given, F.lit("{}"))).alias("input"), "ts", "cwd",
        F.coalesce(F.when(status == "completed", string_at(v, "$.state.output")).when(status == "error", string_at(v, "$.state.error")), F.lit("")).alias("content"), status.eqNullSafe("error").alias("is_error"), F.col("time_created").alias("at"))
    tools = tools.withColumn("seq", (F.row_number().over(Window.partitionBy("session_key").orderBy("pos")) - 1).cast("long"))
    so_far = Window.partitionBy("session_key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    is_tool = (kind == "tool") & (string_at(v, "$.tool") != "") & (string_at(v, "$.callID") != "")
    counted = joined.withColumn("seq", F.coalesce(F.sum(F.when(is_tool, 1).otherwise(0)).over(so_far), F.lit(0)).cast("long"))
    inline = counted.where(kind.isin("compaction", "subtask")).select(
        "session_key", "seq", "ts", F.when(kind == "compaction", "compaction").otherwise("subagent").alias("type"), F.when(kind == "subtask", F.coalesce(string_at(v, "$.agent"), F.lit(""))).otherwise("").alias("note"), F.lit(0).alias("second"), F.col("no"))
    m = variant(F.col("data"))
    said = messages.where(string_at(m, "$.role") == "user").select(key.alias("session_key"), F.col("time_created").alias("at"), "row_no", content_text(value_at(m, "$.content")).alias("text")).where((F.col("text") != "") & ~injected(F.col("text")))
    # The number of events strictly before: a running count over both, messages first among equals.
    both = said.withColumn("is_event", F.lit(0)).unionByName(tools.select("session_key", "at", F.lit(1).alias("is_event")), allowMissingColumns=True)
    w = Window.partitionBy("session_key").orderBy("at", "is_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    users = both.withColumn("seq", F.sum("is_event").over(w).cast("long")).where(F.col("is_event") == 0).select(
        "session_key", "seq", millis_text(F.col("at")).alias("ts"), F.lit("user-message").alias("type"), truncate_runes(F.col("text"), 2000, "…").alias("note"), F.lit(1).alias("second"), F.col("row_no").alias("no"))
    marks = inline.unionByName(users)
    marks = marks.withColumn("pos", F.row_number().over(Window.partitionBy("session_key").orderBy("ts", "second", "no")).cast("long")).drop("second", "no")
    return Parsed.of(sessions, tools.drop("at"), marks, numbered=True, order=STORE)

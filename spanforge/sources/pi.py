"""Sessions, calls and marks of line logs whose entries form a tree (harness pi). The path to the last entry counts."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import base_name
from spanforge.functions.text import WS, injected, string_at, trim_space, truncate_runes, value_at
from spanforge.operators.pairing import pair_latest
from spanforge.operators.sessions import TEXT, first_value, last_value, session_key
from spanforge.session import checkpointed
from spanforge.sources.lines import content_items, decoded, files_of, joined_texts, json_lines, numbered_lines, text_field, well_typed
from spanforge.sources.parsed import Parsed

HARNESS = "pi"


def linearize(entries: DataFrame, session: str = "session_key") -> DataFrame:
    """entries (session, line_no, id, parent_id) with pos: those on the way from the root to the last entry that has an id.

    A walk along parents, one session at a time: what is walked is a session's ids, never its texts. Cycles end the walk, as
    do missing parents; of repeated ids the last counts. Sessions without ids keep all entries.
    """

    def walk(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("line_no").to_pylist(), table.column("id").to_pylist(), table.column("parent_id").to_pylist(), strict=True))
        by_id = {i: (n, p) for n, i, p in rows if i}
        if not by_id:
            way = [n for n, _, _ in rows]
        else:
            at, seen, way = next(i for _, i, _ in reversed(rows) if i), set(), []
            while at and at in by_id and at not in seen:
                seen.add(at)
                n, parent = by_id[at]
                way.append(n)
                at = parent
            way.reverse()
        key = table.column(session)[0].as_py()
        return pa.table({session: pa.array([key] * len(way), pa.string()), "line_no": pa.array(way, pa.int64()), "pos": pa.array(range(len(way)), pa.int64())})

    way = entries.select(session, "line_no", "id", "parent_id").groupBy(session).applyInArrow(walk, f"{session} string, line_no long, pos long")
    return entries.join(way, [session, "line_no"])


def records(lines: DataFrame) -> DataFrame:
    """Decoded entries; the first that is valid JSON must be the header of a session."""
    v = F.col("v")
    rows = decoded(lines).where(v.isNotNull()).withColumn("session_key", session_key(F.lit(HARNESS), F.col("path")))
    w = Window.partitionBy("session_key").orderBy("line_no")
    head = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("header_ok", F.first((string_at(v, "$.type") == "session") & string_at(v, "$.id").isNotNull()).over(head))
    rows = rows.where(F.coalesce("header_ok", F.lit(False)) & F.coalesce(well_typed(v, ("type", "id", "timestamp", "cwd", "modelId", "summary", "name")), F.lit(False)))
    return rows.select("session_key", "path", "line_no", *(c for c in ("end_offset",) if c in rows.columns), (F.col("n") == 1).alias("is_header"), *(text_field(v, n).alias(n) for n in ("type", "id", "timestamp", "cwd", "modelId", "summary", "name")),
                       F.coalesce(string_at(v, "$.parentId"), F.lit("")).alias("parent_id"), value_at(v, "$.message").alias("m"))


def _way(rows: DataFrame) -> DataFrame:
    m = F.col("m")
    way = linearize(rows.where(~F.col("is_header")))
    items = content_items(value_at(m, "$.content"))
    return way.withColumn("role", F.when((F.col("type") == "message") & well_typed(m, ("role", "model", "toolCallId", "command", "output"), ("isError",)), text_field(m, "role")).otherwise("")).withColumn("items", items).withColumn("said", joined_texts(F.col("items")))


def sessions(rows: DataFrame, way: DataFrame) -> DataFrame:
    """One row per session: header, then what the way to the last entry says."""
    head = rows.where("is_header").groupBy("session_key").agg(F.first("path").alias("path"), F.first("id").alias("session_id"), F.first("cwd").alias("cwd"), F.first("timestamp").alias("head_ts"))
    names = rows.where((F.col("type") == "session_info") & ~F.col("is_header")).groupBy("session_key").agg(F.max_by("name", "line_no").alias("name"))
    pos, kind = F.col("pos"), F.col("type")
    changed = last_value(F.when(kind == "model_change", F.col("modelId")).otherwise(""), pos)
    spoken = first_value(F.when((kind == "message") & (F.col("role") == "assistant"), text_field(F.col("m"), "model")).otherwise(""), pos)
    first_text = first_value(F.when((F.col("role") == "user") & ~injected(F.col("said")), F.col("said")).otherwise(""), pos)
    walked = way.groupBy("session_key").agg(changed.alias("changed"), spoken.alias("spoken"), first_value(F.col("timestamp"), pos).alias("first_ts"), last_value(F.col("timestamp"), pos).alias("last_ts"), first_text.alias("first_text"))
    blank = lambda *c: F.coalesce(*c, F.lit(""))
    short = truncate_runes(trim_space(F.regexp_replace("first_text", f"[{WS}]+", " ")), 240, "…")
    filled = lambda c: F.when(c != "", c)
    joined = head.join(walked, "session_key", "left").join(names, "session_key", "left")
    return joined.select(
        "session_key", "session_id", F.lit(HARNESS).alias("harness"), "path", "cwd", blank("changed", "spoken").alias("model"), F.coalesce(filled(F.col("name")), filled(short), base_name(F.col("path"))).alias("title"), F.lit("").alias("git_branch"),
        blank(filled(F.col("head_ts")), "first_ts").alias("started_at"), blank("last_ts", "head_ts").alias("ended_at"), F.lit("").alias("agent_id"), F.lit(False).alias("is_sidechain"), F.lit(False).alias("auxiliary"), F.lit("").alias("parent_id"))


def parse(rows: DataFrame, way: DataFrame) -> tuple[DataFrame, DataFrame]:
    m, kind, role = F.col("m"), F.col("type"), F.col("role")
    cwd = rows.where("is_header").select("session_key", F.col("cwd").alias("head_cwd"))
    own = way.join(cwd, "session_key", "left")
    exploded = own.where(role == "assistant").select("session_key", "pos", "timestamp", "head_cwd", F.posexplode("items").alias("no", "x"))
    x = F.col("x")
    calls = exploded.where((string_at(x, "$.type") == "toolCall") & (string_at(x, "$.id") != "")).select(
        "session_key", (F.col("pos") * 1_000_000 + F.col("no")).alias("pos"), F.lit("call").alias("kind"), string_at(x, "$.id").alias("call_id"), F.coalesce(string_at(x, "$.name"), F.lit("")).alias("tool"),
        F.coalesce(F.to_json(value_at(x, "$.arguments")), F.lit("{}")).alias("input"), F.col("timestamp").alias("ts"), F.col("head_cwd").alias("cwd"), F.lit("").alias("content"), F.lit(False).alias("is_error"))
    pos = (F.col("pos") * 1_000_000).alias("pos")
    results = own.where(role == "toolResult").select(
        "session_key", pos, F.lit("result").alias("kind"), text_field(m, "toolCallId").alias("call_id"), F.lit("").alias("tool"), F.lit("{}").alias("input"), F.col("timestamp").alias("ts"), F.col("head_cwd").alias("cwd"),
        F.col("said").alias("content"), F.coalesce(F.try_variant_get(m, "$.isError", "boolean"), F.lit(False)).alias("is_error"))
    shells = own.where(role == "bashExecution").select(
        "session_key", pos, F.lit("event").alias("kind"), F.lit("").alias("call_id"), F.lit("bash").alias("tool"), F.to_json(F.struct(text_field(m, "command").alias("command"))).alias("input"), F.col("timestamp").alias("ts"), F.col("head_cwd").alias("cwd"),
        text_field(m, "output").alias("content"), F.coalesce(F.try_variant_get(m, "$.exitCode", "long") != 0, F.lit(False)).alias("is_error"))
    paired = pair_latest(calls.unionByName(results).unionByName(shells))
    mark = lambda rows, kind, note: rows.select("session_key", pos, F.col("timestamp").alias("ts"), F.lit(kind).alias("type"), note.alias("note"))
    marks = mark(own.where(kind == "compaction"), "compaction", F.lit("")).unionByName(mark(own.where(kind == "branch_summary"), "compaction", truncate_runes(F.concat(F.lit("branch: "), F.col("summary")), 2000, "…"))).unionByName(
        mark(own.where((role == "user") & ~injected(F.col("said"))), "user-message", truncate_runes(F.col("said"), 2000, "…")))
    return paired, marks


def starts(lines: DataFrame) -> DataFrame:
    """path, cwd, started_at, as far as these lines tell: what the header says."""
    return records(lines).where("is_header").select("path", "cwd", F.col("timestamp").alias("started_at"))


def read(spark: SparkSession, folder: str, pattern: str = "*.jsonl", cwd: str | None = None, since: datetime | None = None, once: bool = False) -> Parsed:
    """All sessions below a folder, or those that pass. once: decoded records are written to the checkpoint folder first, so files are opened once, however often sessions, calls and marks read them."""
    rows = records((numbered_lines if once else json_lines)(spark, files_of(spark, folder, pattern, starts, cwd, since), pattern))
    rows = checkpointed(rows) if once else rows
    way = checkpointed(_way(rows)) if once else _way(rows)
    return Parsed.of(sessions(rows, way), *parse(rows, way), order=TEXT).filtered(cwd, since)

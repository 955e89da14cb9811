"""Sessions, calls and marks of line logs of typed payloads (harness codex), with titles from an index file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import base_name
from spanforge.functions.text import content_text, injected, is_kind, let, string_at, trim_space, truncate_runes, value_at, variant
from spanforge.operators.failures import command_output_failed
from spanforge.operators.pairing import pair_first
from spanforge.operators.sessions import TEXT, first_value, last_value, session_key
from spanforge.session import checkpointed
from spanforge.sources.lines import content_items, decoded, files_of, joined_texts, json_lines, numbered_lines, text_field, well_typed
from spanforge.sources.parsed import Parsed

HARNESS = "codex"


def records(lines: DataFrame) -> DataFrame:
    v, p = F.col("v"), F.col("p")
    rows = decoded(lines).where(F.coalesce(well_typed(v, ("type", "timestamp", "id", "role")), F.lit(False)))
    rows = rows.withColumn("p", value_at(v, "$.payload"))
    fields = {n: text_field(v, n) for n in ("type", "timestamp", "id", "role")} | {f"p_{n}": text_field(p, n) for n in ("type", "id", "name", "call_id", "role", "cwd", "model", "thread_source")}
    rows = rows.select("path", "line_no", *(c for c in ("end_offset",) if c in rows.columns), "v", "p", *(c.alias(n) for n, c in fields.items()))
    strings = {"session_meta": ("id", "cwd", "thread_source"), "turn_context": ("cwd", "model"), "response_item": ("type", "id", "name", "call_id", "role"), "event_msg": ("type", "call_id")}
    readable = F.lit(False)
    for kind, names in strings.items():
        readable = F.when(F.col("type") == kind, well_typed(p, names)).otherwise(readable)
    return rows.withColumn("readable", F.coalesce(readable, F.lit(False))).withColumn("session_key", session_key(F.lit(HARNESS), F.col("path")))


def titles(spark: SparkSession, path: str) -> DataFrame:
    """id, title: the last entry of each id in an index file."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("no", "line")).withColumn("v", variant(F.col("line")))
    named = rows.select("no", text_field(F.col("v"), "id").alias("id"), text_field(F.col("v"), "thread_name").alias("title")).where((F.col("id") != "") & (F.col("title") != ""))
    return named.groupBy("id").agg(F.max_by("title", "no").alias("title"))


def sessions(rows: DataFrame, index: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """One row per recognized file. whole: as a full parse has it (a bare header names the session, the first branch counts) rather than a listing (the last does)."""
    no, kind = F.col("line_no"), F.col("type")
    at = lambda k, c: F.when((kind == k) & F.col("readable"), c).otherwise("")
    branch = at("session_meta", F.coalesce(string_at(F.col("p"), "$.git.branch"), F.lit("")))
    cwd = F.when(F.col("readable") & kind.isin("session_meta", "turn_context"), F.col("p_cwd")).otherwise("")
    sub = value_at(F.col("p"), "$.source.subagent")
    agent = (kind == "session_meta") & F.col("readable") & ((F.col("p_thread_source") == "subagent") | (sub.isNotNull() & ~F.is_variant_null(sub)))
    ident = F.when((kind == "") & F.lit(whole), F.col("id")).otherwise(at("session_meta", F.col("p_id")))
    seen = kind.isin("session_meta", "turn_context", "response_item", "event_msg") | ((kind == "message") & (F.col("role") != "")) | ((kind == "") & (F.col("id") != ""))
    blank = lambda c: F.coalesce(c, F.lit(""))
    name = base_name(F.first("path"))
    out = rows.groupBy("session_key").agg(
        F.coalesce(last_value(ident, no), F.regexp_replace(name, r"\.[^.]*\z", "")).alias("session_id"), F.lit(HARNESS).alias("harness"), F.first("path").alias("path"), blank(first_value(cwd, no)).alias("cwd"),
        blank(first_value(at("turn_context", F.col("p_model")), no)).alias("model"), name.alias("title"), blank(first_value(branch, no) if whole else last_value(branch, no)).alias("git_branch"),
        blank(first_value(F.col("timestamp"), no)).alias("started_at"), blank(last_value(F.col("timestamp"), no)).alias("ended_at"), F.lit("").alias("agent_id"), F.lit(False).alias("is_sidechain"), F.bool_or(agent).alias("auxiliary"),
        F.lit("").alias("parent_id"), F.bool_or(seen).alias("ok")).where("ok").drop("ok")
    if index is None:
        return out
    named = index.select(F.col("id").alias("session_id"), F.col("title").alias("index_title"))
    return out.join(named, "session_id", "left").withColumn("title", F.coalesce("index_title", "title")).drop("index_title").select(*out.columns)


def call_input(v: Column) -> Column:
    """A call's input as the text of an object: an object itself, the object that a string holds (two strings deep), anything else under _raw."""
    raw = lambda t: F.to_json(F.struct(t.alias("_raw")))

    def text(t: Column, deeper: bool) -> Column:
        def parsed(x: Column) -> Column:
            inner = F.try_variant_get(x, "$", "string")
            nested = F.when(is_kind(x, "STRING") & (inner != t), text(inner, False)).otherwise(raw(t)) if deeper else raw(t)
            return F.when(is_kind(x, "OBJECT"), F.to_json(x)).otherwise(nested)

        return F.when(trim_space(t) == "", "{}").otherwise(let(variant(trim_space(t)), parsed))

    return (
        F.when(v.isNull() | F.is_variant_null(v), "{}").when(is_kind(v, "OBJECT"), F.to_json(v))
        .when(is_kind(v, "STRING"), text(F.try_variant_get(v, "$", "string"), True)).otherwise(raw(F.to_json(v)))
    )


def patched_input(given: Column, changes: Column) -> Column:
    """An input whose patch also names the files of a change list, in order of their paths."""
    v = variant(given)
    patch = F.coalesce(*(string_at(v, f"$.{k}") for k in ("patch", "input", "_raw")), F.lit(""))
    kinds = F.try_variant_get(changes, "$", "map<string,variant>")
    lines = F.transform(F.array_sort(F.map_keys(kinds)), lambda k: F.concat(
        F.lit("*** "), let(F.lower(F.coalesce(string_at(F.try_element_at(kinds, k), "$.type"), F.lit(""))), lambda t: F.when(t == "add", "Add").when(t == "delete", "Delete").otherwise("Update")), F.lit(" File: "), k, F.lit("\n")))
    ended = F.when((patch != "") & ~F.endswith(patch, F.lit("\n")), F.concat(patch, F.lit("\n"))).otherwise(patch)
    fields = F.from_json(given, "map<string,string>")
    merged = F.to_json(F.map_concat(F.map_filter(F.coalesce(fields, F.create_map().cast("map<string,string>")), lambda k, _: k != "patch"), F.create_map(F.lit("patch"), F.concat(ended, F.array_join(lines, "")))))
    return F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, merged).otherwise(given)


def parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls in their order with first results, and marks by the number of calls before them."""
    p, kind = F.col("p"), F.col("p_type")
    pos = F.col("line_no").alias("pos")
    whole = Window.partitionBy("session_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cwd = F.when(F.col("readable") & F.col("type").isin("session_meta", "turn_context") & (F.col("p_cwd") != ""), F.col("p_cwd"))
    rows = rows.withColumn("cwd", F.coalesce(F.first(cwd, True).over(whole), F.lit("")))
    items = rows.where((F.col("type") == "response_item") & F.col("readable"))
    call_id = F.when(F.col("p_call_id") != "", F.col("p_call_id")).otherwise(F.col("p_id"))
    given = call_input(F.when(kind == "function_call", value_at(p, "$.arguments")).otherwise(value_at(p, "$.input")))
    calls = items.where(kind.isin("function_call", "custom_tool_call") & (call_id != "") & (F.col("p_name") != "")).select(
        "session_key", pos, F.lit("call").alias("kind"), call_id.alias("call_id"), F.col("p_name").alias("tool"), given.alias("input"), F.col("timestamp").alias("ts"), "cwd", F.lit("").alias("content"), F.lit(False).alias("is_error"),
        ((kind == "custom_tool_call") & (F.col("p_name") == "apply_patch")).alias("direct"))
    output = content_text(value_at(p, "$.output"))
    results = items.where(kind.isin("function_call_output", "custom_tool_call_output") & (F.col("p_call_id") != "")).select("session_key", pos, F.lit("result").alias("kind"), F.col("p_call_id").alias("call_id"), output.alias("content")).withColumn(
        "is_error", F.coalesce(command_output_failed(F.col("content")), F.lit(False)))
    paired = pair_first(calls.drop("direct").unionByName(results, allowMissingColumns=True))
    # A patch's change list, the first after its call.
    ends = rows.where((F.col("type") == "event_msg") & F.col("readable") & (kind == "patch_apply_end") & (F.col("p_call_id") != "")).select(
        "session_key", F.col("line_no").alias("end_no"), F.col("p_call_id").alias("call_id"), F.to_json(value_at(p, "$.changes")).alias("changes"), F.try_variant_get(p, "$.success", "boolean").alias("success"))
    direct = calls.groupBy("session_key", "call_id").agg(F.min_by("direct", "pos").alias("direct"), F.min("pos").alias("call_no")).where("direct")
    first_end = direct.join(ends, ["session_key", "call_id"]).where(F.col("end_no") > F.col("call_no")).groupBy("session_key", "call_id").agg(F.min(F.struct("end_no", "changes", "success")).alias("e"))
    joined = paired.join(first_end, ["session_key", "call_id"], "left")
    calls_out = joined.withColumn("input", F.when(F.col("e").isNotNull(), patched_input(F.col("input"), variant(F.col("e.changes")))).otherwise(F.col("input"))).withColumn("is_error", F.coalesce(~F.col("e.success"), F.col("is_error"))).drop("e")
    # Marks.
    content = F.when(F.col("type") == "message", value_at(F.col("v"), "$.content")).otherwise(value_at(p, "$.content"))
    said = joined_texts(content_items(content), any_type=True)
    user = rows.where(((F.col("type") == "message") & (F.col("role") == "user")) | ((F.col("type") == "response_item") & F.col("readable") & (kind == "message") & (F.col("p_role") == "user"))).select("session_key", pos, "timestamp", said.alias("note")).where((F.col("note") != "") & ~injected(F.col("note")))
    marks = user.select("session_key", "pos", F.col("timestamp").alias("ts"), F.lit("user-message").alias("type"), truncate_runes(F.col("note"), 2000, "…").alias("note"))
    compacted = rows.where((F.col("type") == "event_msg") & F.col("readable") & (kind == "context_compacted")).select("session_key", pos, F.col("timestamp").alias("ts"), F.lit("compaction").alias("type"), F.lit("").alias("note"))
    spawned = paired.where(F.col("tool") == "spawn_agent").select("session_key", "pos", "ts", F.lit("subagent").alias("type"), F.col("tool").alias("note"))
    return calls_out, marks.unionByName(compacted).unionByName(spawned)


def starts(lines: DataFrame) -> DataFrame:
    """path, cwd, started_at, as far as these lines tell."""
    no = F.col("line_no")
    cwd = F.when(F.col("readable") & F.col("type").isin("session_meta", "turn_context"), F.col("p_cwd")).otherwise("")
    return records(lines).groupBy("path").agg(first_value(cwd, no).alias("cwd"), first_value(F.col("timestamp"), no).alias("started_at"))


def read(spark: SparkSession, folder: str, index: str | None = None, whole: bool = True, pattern: str = "*.jsonl", cwd: str | None = None, since: datetime | None = None, once: bool = False) -> Parsed:
    """All sessions below a folder, or those that pass; index: a file of titles. once: decoded records are written to the checkpoint folder first, so files are opened once, however often sessions, calls and marks read them."""
    rows = records((numbered_lines if once else json_lines)(spark, files_of(spark, folder, pattern, starts, cwd, since), pattern))
    rows = checkpointed(rows) if once else rows
    return Parsed.of(sessions(rows, titles(spark, index) if index else None, whole), *parse(rows), order=TEXT).filtered(cwd, since)

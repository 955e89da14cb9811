"""All registered queries of the session-log engine, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.paths import command_paths, extract_paths, normalize_path, patch_paths, path_hits
from spanforge.functions.shell import read_paths, reads, searches, verifies
from spanforge.functions.text import content_text, injected, parse_time, truncate_runes, variant
from spanforge.operators.classify import ClassifyOptions, build_events, merge_targets
from spanforge.operators.failures import command_output_failed
from spanforge.operators.pairing import mark_positions, pair_first, pair_latest, ride, safe_watermark
from spanforge.operators.sessions import agent_nodes, children, depths, first_value, idle, last_value, list_filtered, listing, session_key, with_times
from spanforge.operators.trace import build_spans, end_times, trace_json
from spanforge.plans import logs, oracles
from spanforge.plans.inputs import COMMANDS, OUTPUTS, PATHS, conversation_sessions, event_items, instant, picked
from spanforge.session import shared_folder, table
from spanforge.sinks.traces import read_traces, write_traces

Query = Callable[[SparkSession, str], DataFrame]


def trace_spans(spark: SparkSession, folder: str) -> DataFrame:
    spans = build_spans(*conversation_sessions(spark, folder))
    return spans.select(
        "session_key", "place", "trace_id", "span_id", F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"), "name", "kind",
        F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "status", F.coalesce("status_msg", F.lit("")).alias("status_msg"))


def trace_turns(spark: SparkSession, folder: str) -> DataFrame:
    spans = build_spans(*conversation_sessions(spark, folder))
    return spans.groupBy("session_key").agg(
        F.count(F.col("attributes")["agent.turn.type"]).alias("n_turns"), F.count("*").alias("n_spans"), F.count("parent_span_id").alias("n_children"), F.sum(F.when(F.col("status") == 2, 1).otherwise(0)).alias("n_errors"))


def trace_export(spark: SparkSession, folder: str) -> DataFrame:
    sessions, events, marks = conversation_sessions(spark, folder)
    out = trace_json(sessions, build_spans(sessions, events, marks))
    return out.select("session_key", F.get_json_object("json", "$.traceId").alias("trace_id"), F.json_array_length(F.get_json_object("json", "$.spans")).cast("long").alias("n_spans"))


def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """The whole JSON of all traces, written to files by the sink and read back."""
    sessions, events, marks = conversation_sessions(spark, folder)
    out = shared_folder(spark, "traces")
    write_traces(trace_json(sessions, build_spans(sessions, events, marks)), out)
    return read_traces(spark, out).select(F.get_json_object("json", "$.session.key").alias("session_key"), "json")


def span_end_times(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of a timeline whose starts are out of order (by event id), and the first that begins later."""
    rows = table(spark, folder, "events").select(F.col("user_id").alias("session_key"), "event_id", (F.timestamp_micros(instant(F.col("ts")) - (F.col("event_id") % 7) * 3_600_000_000)).alias("start_time"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("session_key").orderBy("event_id")))
    return end_times(rows).select("event_id", F.unix_micros("start_time").alias("start_us"), F.coalesce(F.unix_micros("next_later"), F.lit(-1)).alias("next_us"))


def _commands(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", picked([c for c, _, _ in COMMANDS], F.col("event_id")).alias("command"))


def command_kinds(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("command")
    return _commands(spark, folder).select("event_id", "command", verifies(c).alias("verifies"), searches(c).alias("searches"), reads(c).alias("reads"))


def command_read_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _commands(spark, folder).select("event_id", F.array_join(read_paths(F.col("command")), ",").alias("paths"))


def action_for(spark: SparkSession, folder: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Grep").when(F.col("event_type") == "purchase", "Edit").when(F.col("event_type") == "signup", "Mystery").otherwise("Bash")
    rows = table(spark, folder, "events").select("event_id", tool.alias("tool"), picked([c for c, _, _ in COMMANDS], F.col("event_id")).alias("command"))
    calls = rows.select("event_id", "tool", F.to_json(F.struct("command")).alias("input"), F.lit("").alias("content"), F.lit(False).alias("is_error"), F.lit("/work/app").alias("cwd"))
    return build_events(calls, key=("event_id",), scripts=False, recurring=True).select("event_id", "tool", "action", "summary")


def extract_paths_query(spark: SparkSession, folder: str) -> DataFrame:
    """The paths in whole pages."""
    pages = table(spark, folder, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" src/main.go:12 and lib/a.py lib/b.py: "), F.col("html"))
    join = lambda c: F.array_join(c, "\n")
    return pages.select("page_id", join(extract_paths(text)).alias("paths"), join(command_paths(text)).alias("command_paths"))


def path_line_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    n = F.col("event_id").cast("string")
    text = F.concat(F.lit("src/a.go:"), n, F.lit(":x\n(pkg/b.py:0) 'c.txt:12' src/a.go:7 lib/d.rs"))
    return rows.select("event_id", F.array_join(F.transform(path_hits(text), lambda h: F.concat_ws(":", h["path"], F.array_join(F.transform(h["lines"], lambda x: F.concat_ws("-", x[0].cast("string"), x[1].cast("string"))), "+"))), ",").alias("hits"))


def patch_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    key = F.col("o_orderkey").cast("string")
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: src/"), key, F.lit(".go\n@@\n*** Move to: lib/"), F.col("o_orderstatus"), F.lit(".go\n*** Add File: b/new.txt\n *** Delete File: no.txt\n*** Delete File: src/"), key, F.lit(".go\n"))
    return rows.select("o_orderkey", F.array_join(patch_paths(patch), ",").alias("paths"))


def normalize_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", picked([p for p, _ in PATHS], F.col("event_id")).alias("path"))
    at = normalize_path(F.col("path"), F.lit("/work/app"), F.lit(""), home="/home/joe")
    return rows.select("event_id", "path", F.coalesce(at["rel"], F.concat(at["scope"], F.lit(":"), at["outside"]), F.lit("")).alias("placed"))


def target_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The touches of each order's lines, merged by part."""
    lines = table(spark, folder, "lineitem")
    touch = F.when(F.col("l_returnflag") == "R", "edit").when(F.col("l_returnflag") == "A", "read").otherwise("hit")
    one = F.struct(
        F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("rel"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("outside"), touch.alias("touch"),
        F.lit(False).alias("weak"), F.array(F.array(F.col("l_partkey"), F.col("l_partkey"))).alias("lines"))
    grouped = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", one.alias("one")))).alias("x"))
    merged = merge_targets(F.transform("x", lambda x: x["one"]))
    return grouped.select("l_orderkey", F.array_join(F.transform(merged, lambda t: F.concat_ws(":", t["path"], t["touch"], F.array_join(F.transform(t["lines"], lambda n: n[0].cast("string")), "+"))), ",").alias("targets"))


def truncated_notes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    t = F.col("text")
    return docs.select("doc_id", truncate_runes(t, 2000, "…").alias("note"), truncate_runes(t, 96, "...").alias("verb"))


def content_to_string(spark: SparkSession, folder: str) -> DataFrame:
    """Contents as a string, as an array of text blocks, and as null, in turn."""
    rows = table(spark, folder, "conversations")
    blocks = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    raw = F.when(F.col("turn") % 3 == 0, F.get_json_object(F.to_json(F.struct("text")), "$")).otherwise(blocks)
    raw = F.when(F.col("turn") % 3 == 0, F.regexp_replace(raw, r'^\{"text":|\}\z', "")).when(F.col("turn") % 3 == 1, raw).otherwise("null")
    return rows.select("conv_id", "turn", content_text(variant(raw)).alias("content"))


def injected_messages(spark: SparkSession, folder: str) -> DataFrame:
    pages, turns = table(spark, folder, "pages"), table(spark, folder, "conversations")
    both = pages.select(F.col("page_id").alias("id"), F.lit("page").alias("source"), F.col("html").alias("text")).unionByName(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("turn").alias("source"), "text"))
    return both.select("id", "source", injected(F.col("text")).alias("injected"))


def pair_latest_query(spark: SparkSession, folder: str) -> DataFrame:
    got = pair_latest(event_items(spark, folder))
    return got.select("session_key", "seq", F.col("open").cast("long").alias("unanswered"), "call_id", F.col("input").alias("call_event"), F.col("content").alias("result_event"), "is_error")


def pair_first_query(spark: SparkSession, folder: str) -> DataFrame:
    got = pair_first(event_items(spark, folder))
    return got.select("session_key", "seq", "answered", "call_id", F.col("input").alias("call_event"), F.col("content").alias("result_event"), "is_error")


def _marks_and_events(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("session_key"), "event_id", instant(F.col("ts")).alias("pos"), "event_type")
    marks = rows.where(F.col("event_type") == "error").select("session_key", "event_id", "pos")
    events = rows.where(F.col("event_type") != "error").select("session_key", "pos", F.col("event_id").alias("e"))
    events = events.withColumn("seq", (F.row_number().over(Window.partitionBy("session_key").orderBy("pos", "e")) - 1).cast("long"))
    return marks, events


def mark_seq(spark: SparkSession, folder: str) -> DataFrame:
    marks, events = _marks_and_events(spark, folder)
    return mark_positions(marks, events).select("session_key", "event_id", "seq")


def mark_ride(spark: SparkSession, folder: str) -> DataFrame:
    """Marks that ride on the next of all events, and, for gaps, on the next of one type."""
    marks, events = _marks_and_events(spark, folder)
    views = events.join(table(spark, folder, "events").where(F.col("event_type") == "view").select(F.col("event_id").alias("e")), "e", "left_semi")
    placed = mark_positions(marks, events)
    both = ride(ride(placed, events).withColumnRenamed("event_seq", "any_seq"), views)
    return both.select("session_key", "event_id", "seq", F.coalesce("any_seq", F.lit(-1)).alias("event_seq"), F.coalesce("event_seq", F.lit(-1)).alias("view_seq"))


def session_meta(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    order = F.struct(instant(F.col("ts")), "event_id")
    cwd = F.when(F.col("event_type") == "view", F.concat(F.lit("/w/"), F.col("event_id").cast("string"))).otherwise("")
    title = F.when(F.col("event_type") == "signup", F.concat(F.lit("t"), F.col("event_id").cast("string"))).otherwise("")
    return rows.groupBy("user_id").agg(
        first_value(cwd, order).alias("cwd"), F.coalesce(last_value(title, order), F.lit("untitled")).alias("title"),
        F.bool_or(F.col("event_type") == "error").alias("is_sidechain"), F.count("*").alias("n_lines"))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders")
    ts = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.col("o_orderkey")
    return with_times(rows.select(
        session_key(F.lit("codex"), F.concat(F.lit("/s/"), key.cast("string"))).alias("session_key"), F.concat(F.lit("/home/joe"), F.when(key % 3 == 0, "y").otherwise(""), F.lit("/p"), (key % 5).cast("string")).alias("cwd"),
        F.when(key % 11 == 0, "garbage").otherwise(ts).alias("started_at"), F.when(key % 13 == 0, "").otherwise(ts).alias("ended_at")))


def session_filter(spark: SparkSession, folder: str) -> DataFrame:
    return list_filtered(_sessions(spark, folder), "/home/joe", datetime(1995, 1, 1)).select("session_key", "cwd", "started_at")


def session_order(spark: SparkSession, folder: str) -> DataFrame:
    """The position of every session, from 1, latest end first."""
    sessions = _sessions(spark, folder).withColumn("session_id", F.col("session_key"))
    return listing(sessions).select("session_key", "ended_at", (F.col("position") + 1).alias("position"))


def session_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", session_key(F.concat(F.lit("h-"), F.col("lang")), F.concat(F.lit("/x/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))).alias("session_key"))


def user_messages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("data"))
    return rows.where(F.get_json_object("data", "$.role") == "user").select("conv_id", "turn", F.length(F.get_json_object("data", "$.text")).cast("long").alias("n_chars"))


def strict_times(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    good = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:00'")
    text = F.when(F.col("event_id") % 4 == 0, "2026").when(F.col("event_id") % 4 == 1, F.concat(good, F.lit("x"))).otherwise(good)
    return rows.select("event_id", F.coalesce(F.unix_micros(parse_time(text)), F.lit(-1)).alias("us"))


def idle_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    activity = rows.groupBy(F.col("user_id").alias("session_key")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_activity"))
    now = activity.agg(F.max("last_activity").alias("now"))
    return idle(activity.crossJoin(F.broadcast(now)), F.col("now"), 3600.0).select("session_key", F.unix_micros("last_activity").alias("last_us"), "idle")  # one row


def session_gaps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = rows.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    return got.select("user_id", F.unix_micros("low").alias("from_us"), F.unix_micros("high").alias("to_us"), "n")


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    key = F.col("c_custkey")
    return agent_nodes(rows.select(key.cast("string").alias("session_id"), F.when(key % 10 == 0, "").otherwise(F.floor(key / 10).cast("string")).alias("parent_id"), F.lit("crush").alias("harness"), F.lpad((key % 97).cast("string"), 3, "0").alias("started_at"), F.col("c_name").alias("title")))


def agent_children(spark: SparkSession, folder: str) -> DataFrame:
    return children(_nodes(spark, folder)).select("parent_id", F.array_join("children", ",").alias("children"))


def agent_depths(spark: SparkSession, folder: str) -> DataFrame:
    return depths(_nodes(spark, folder))


def watermarks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    opens = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    items = rows.select(F.col("user_id").alias("session_key"), F.col("event_id").alias("pos"), opens.alias("opens"), (F.col("event_id") * 100).alias("end_offset"))
    return safe_watermark(items).select("session_key", F.coalesce("watermark", F.lit(-1)).alias("watermark"))


def output_failed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", picked([o for o, _ in OUTPUTS], F.col("event_id")).alias("output"))
    return rows.select("event_id", command_output_failed(F.col("output")).alias("failed"))


def classified_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Shell calls with output, wrapper scripts and patches, classified whole."""
    k = (F.col("event_id") % 3).cast("int")
    script = F.lit('const r = await tools.exec_command({cmd: "cat src/login.go", workdir: "/work/app/sub"}); // tools.exec_command("no")')
    patch = F.lit("*** Begin Patch\n*** Update File: src/a.go\n*** Add File: /tmp/x.txt\n")
    rows = table(spark, folder, "events").select(
        "event_id", F.when(k == 0, "exec").when(k == 1, "apply_patch").otherwise("Bash").alias("tool"),
        F.when(k == 0, F.to_json(F.struct(script.alias("code")))).when(k == 1, F.to_json(F.struct(patch.alias("patch")))).otherwise('{"command": "grep -n x src/b.go", "description": "Look"}').alias("input"),
        F.when(k == 2, "src/b.go:3: x\n").otherwise("").alias("content"), F.lit(False).alias("is_error"), F.lit("/work/app").alias("cwd"))
    got = build_events(rows, ClassifyOptions(), key=("event_id",), recurring=True)
    targets = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["path"], t["touch"])), ",")
    outside = F.array_join(F.transform("outside", lambda t: F.concat_ws(":", t["scope"], t["path"])), ",")
    return got.select("event_id", "action", targets.alias("targets"), outside.alias("outside"), "summary")


def _calls_of(number: Column) -> list[Column]:
    """The places in COMMANDS of up to four commands that a number stands for; -1 for none."""
    n = len(COMMANDS)
    many = number % 4 + 1
    return [F.when(many > k, F.floor(number / (4 * 7**k)).cast("long") % n).otherwise(-1) for k in range(4)]


def script_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapper scripts of one to four commands, thousands of combinations, with calls in strings and comments that don't count, and calls of other tools."""
    events = table(spark, folder, "events")
    number = F.col("event_id")
    tick = F.when(number % 5 == 0, F.lit("// tools.exec_command({\"cmd\": \"rm -rf x\"})\n")).when(number % 5 == 1, F.lit("const s = 'tools.read_file(1)';\n")).otherwise("")
    calls = [F.when(place >= 0, F.concat(F.lit("await tools.exec_command({cmd: "), F.to_json(F.struct(picked([c for c, _, _ in COMMANDS], place).alias("c"))).substr(F.lit(6), F.length(F.to_json(F.struct(picked([c for c, _, _ in COMMANDS], place).alias("c")))) - 6), F.when(number % 3 == 0, F.lit(', "workdir": "/work/app/sub"')).otherwise(""), F.lit("});\n"))).otherwise("") for place in _calls_of(number)]
    other = F.when(number % 11 == 0, F.lit("await tools.web_search(\"x\");\n")).otherwise("")
    rows = events.select("event_id", F.lit("exec").alias("tool"), F.to_json(F.struct(F.concat(tick, *calls, other).alias("code"))).alias("input"), F.lit("").alias("content"), F.lit(False).alias("is_error"), F.lit("/work/app").alias("cwd"))
    got = build_events(rows, key=("event_id",), recurring=True)
    reads = F.transform(F.filter("targets", lambda t: t["touch"] == "read"), lambda t: t["path"])
    return got.select("event_id", "action", F.array_join(F.array_sort(reads), ",").alias("reads"))


QUERIES: dict[str, Query] = {
    "trace_spans": trace_spans, "trace_turns": trace_turns, "trace_export": trace_export, "trace_files": trace_files, "span_end_times": span_end_times, "command_kinds": command_kinds, "command_read_paths": command_read_paths, "action_for": action_for,
    "extract_paths": extract_paths_query, "path_line_hits": path_line_hits, "patch_files": patch_files, "normalize_paths": normalize_paths, "target_merge": target_merge, "truncated_notes": truncated_notes,
    "content_to_string": content_to_string, "injected_messages": injected_messages, "pair_latest": pair_latest_query, "pair_first": pair_first_query, "mark_seq": mark_seq, "mark_ride": mark_ride,
    "session_meta": session_meta, "session_filter": session_filter, "session_order": session_order, "session_keys": session_keys, "user_messages": user_messages, "strict_times": strict_times,
    "idle_sessions": idle_sessions, "session_gaps": session_gaps, "agent_children": agent_children, "agent_depths": agent_depths, "watermarks": watermarks, "output_failed": output_failed, "classified_targets": classified_targets, "script_actions": script_actions,
}


def queries() -> dict[str, Query]:
    return QUERIES | logs.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | logs.SQL

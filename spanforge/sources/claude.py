"""Sessions, calls and marks of line logs whose messages carry tool_use and tool_result items (harness claude-code)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.paths import base_name
from spanforge.functions.text import content_text, injected, string_at, trim_space, truncate_runes, value_at
from spanforge.operators.pairing import pair_latest, running_first
from spanforge.operators.sessions import TEXT, first_value, last_value, session_key
from spanforge.session import checkpointed
from spanforge.sources.lines import content_items, decoded, files_of, joined_texts, json_lines, numbered_lines, text_field, well_typed
from spanforge.sources.parsed import Parsed

HARNESS = "claude-code"
STRINGS = ("type", "timestamp", "sessionId", "agentId", "cwd", "gitBranch", "aiTitle", "subtype")


def records(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Decoded lines; those that are no records of this log are dropped one by one. keep: further columns of lines to keep."""
    v = F.col("v")
    rows = decoded(lines).where(F.coalesce(well_typed(v, STRINGS, ("isSidechain",)), F.lit(False)))
    rows = rows.select("path", "line_no", *(c for c in ("end_offset",) if c in rows.columns), *keep, *(text_field(v, n).alias(n) for n in STRINGS), F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False)).alias("isSidechain"), value_at(v, "$.message").alias("m"), value_at(v, "$.message").isNotNull().alias("has_message"))
    rows = rows.withColumn("session_key", session_key(F.lit(HARNESS), F.col("path")))
    content = value_at(F.col("m"), "$.content")
    items = content_items(content)
    # An input that is no object makes the whole message unreadable.
    bad = F.exists(items, lambda x: F.coalesce(~F.schema_of_variant(value_at(x, "$.input")).startswith("OBJECT") & ~F.is_variant_null(value_at(x, "$.input")), F.lit(False)))
    readable = F.coalesce(well_typed(F.col("m"), ("role", "model")), F.lit(False)) & ~bad
    return rows.withColumn("readable", readable).withColumn("items", F.when(F.col("readable"), items).otherwise(F.array().cast("array<variant>"))).withColumn("model", F.when(F.col("readable"), text_field(F.col("m"), "model")).otherwise("")).drop("m")


def recognized():
    """Whether a record shows that its file is a session of this harness."""
    return (F.col("sessionId") != "") | (F.col("type").isin("user", "assistant", "system", "ai-title") & ((F.col("timestamp") != "") | F.col("has_message")))


def sessions(rows: DataFrame) -> DataFrame:
    """One row per recognized file; first and last values in line order."""
    no = F.col("line_no")
    first, last = lambda c: F.coalesce(first_value(F.col(c), no), F.lit("")), lambda c: F.coalesce(last_value(F.col(c), no), F.lit(""))
    name = base_name(F.first("path"))
    title = last_value(F.when(F.col("type") == "ai-title", F.col("aiTitle")).otherwise(""), no)
    return rows.groupBy("session_key").agg(
        F.coalesce(last_value(F.col("sessionId"), no), F.regexp_replace(name, r"\.[^.]*\z", "")).alias("session_id"), F.lit(HARNESS).alias("harness"), F.first("path").alias("path"), first("cwd").alias("cwd"),
        first("model").alias("model"), F.coalesce(title, name).alias("title"), first("gitBranch").alias("git_branch"), first("timestamp").alias("started_at"), last("timestamp").alias("ended_at"), first("agentId").alias("agent_id"),
        F.bool_or("isSidechain").alias("is_sidechain"), F.bool_or("isSidechain").alias("auxiliary"), F.lit("").alias("parent_id"), F.bool_or(recognized()).alias("ok")).where("ok").drop("ok")


def items(rows: DataFrame, *order: Column) -> DataFrame:
    """What happens in records, row by row, for a batch and for a stream alike: calls, results, and marks.

    rows: decoded records. order: long columns that give a record's place in its session; with the item's place in the record
    they make pos. kind is 'call', 'result', a mark's type, or 'cwd' for a record of nothing but a working directory. cwd is
    that of the record alone.
    """
    rows = rows.where(~((F.col("type") == "ai-title") & (F.col("aiTitle") != "")))
    blank, none = F.lit(""), F.lit(False)

    def rows_of(kind: Column, sub: Column, note: Column = blank, x: Column | None = None) -> Column:
        called = F.lit(False) if x is None else kind == "call"
        text = lambda name: blank if x is None else F.coalesce(string_at(x, f"$.{name}"), blank)
        return F.struct(
            sub.cast("long").alias("sub"), kind.alias("kind"), F.when(called, text("id")).otherwise(text("tool_use_id")).alias("call_id"), text("name").alias("tool"),
            (F.lit("{}") if x is None else F.coalesce(F.to_json(value_at(x, "$.input")), F.lit("{}"))).alias("input"), (blank if x is None else content_text(value_at(x, "$.content"))).alias("content"),
            (none if x is None else F.coalesce(F.try_variant_get(x, "$.is_error", "boolean"), none)).alias("is_error"), note.alias("note"))

    kinds = F.transform("items", lambda x: F.when(string_at(x, "$.type").eqNullSafe("tool_result"), "result").when(trim_space(F.coalesce(string_at(x, "$.text"), blank)) != "", "text"))
    deciding = F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))
    text = joined_texts(F.col("items"))
    said = (F.col("type") == "user") & F.col("readable") & (F.size("items") > 0) & ~deciding.eqNullSafe("result") & ~injected(text)
    compacted = (F.col("type") == "system") & F.contains(F.lower("subtype"), F.lit("compact"))
    of_record = F.array(
        F.when(compacted, rows_of(F.lit("compaction"), F.lit(0))), F.when(said, rows_of(F.lit("user-message"), F.lit(1), truncate_runes(text, 2000, "…"))), F.when((F.col("cwd") != "") & (F.size("items") == 0), rows_of(F.lit("cwd"), F.lit(2))))
    kind = lambda x: string_at(x, "$.type")
    used = F.filter(F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: kind(y["x"]).isin("tool_use", "tool_result"))
    called = F.transform(used, lambda y: rows_of(F.when(kind(y["x"]) == "tool_use", "call").otherwise("result"), 2 * y["i"] + 3, x=y["x"]))
    agents = F.transform(F.filter(used, lambda y: (kind(y["x"]) == "tool_use") & string_at(y["x"], "$.name").isin("Task", "Agent")), lambda y: rows_of(F.lit("subagent"), 2 * y["i"] + 2, string_at(y["x"], "$.name")))
    found = F.filter(F.concat(of_record, called, agents), lambda r: r.isNotNull())
    places = [c.cast("long").alias(n) for n, c in zip("gab", [*[F.lit(0)] * (3 - len(order)), *order], strict=True)]
    out = rows.select("session_key", F.col("timestamp").alias("ts"), "cwd", *places, F.explode(found).alias("r"))
    return out.select("session_key", F.struct("g", "a", "b", F.col("r.sub").alias("c")).alias("pos"), "r.kind", "r.call_id", "r.tool", "r.input", "ts", "cwd", "r.content", "r.is_error", "r.note")


def parse(rows: DataFrame, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """Paired calls (see pair_latest) and marks. once: items are written to the checkpoint folder, so calls, marks and their places don't take them from records again."""
    found = items(rows, F.col("line_no")).withColumn("cwd", F.coalesce(running_first(F.col("cwd")), F.lit("")))
    found = checkpointed(found) if once else found
    calls = pair_latest(found.where(F.col("kind").isin("call", "result")).drop("note"))
    marks = found.where(~F.col("kind").isin("call", "result", "cwd")).select("session_key", "pos", F.col("kind").alias("type"), "note", F.lit("").alias("ts"))
    return calls, marks


def starts(lines: DataFrame) -> DataFrame:
    """path, cwd, started_at, as far as these lines tell."""
    no = F.col("line_no")
    return records(lines).groupBy("path").agg(first_value(F.col("cwd"), no).alias("cwd"), first_value(F.col("timestamp"), no).alias("started_at"))


def read(spark: SparkSession, folder: str, pattern: str = "*.jsonl", cwd: str | None = None, since: datetime | None = None, once: bool = False) -> Parsed:
    """All sessions below a folder, or those that pass; files named agent-* are parts of others and left out. once: decoded records are written to the checkpoint folder first, so files are opened once, however often sessions, calls and marks read them."""
    files = files_of(spark, folder, pattern, starts, cwd, since)
    lines = (numbered_lines if once else json_lines)(spark, files, pattern).where(~F.startswith(base_name(F.col("path")), F.lit("agent-")))
    rows = records(lines)
    rows = checkpointed(rows) if once else rows
    return Parsed.of(sessions(rows), *parse(rows, once), order=TEXT).filtered(cwd, since)

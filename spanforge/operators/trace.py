"""Span trees from events and marks: one window pipeline partitioned by session, and its JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import ZERO_MICROS, parse_time, rfc3339, truncate_runes

NAME_LIMIT = 128
ZERO_TIME = "0001-01-01T00:00:00Z"


def trace_id(session_key: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit("trace:"), session_key).cast("binary"), 256), F.lit(32))


def span_id(trace: Column, number: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit("span:"), trace, F.lit(":"), number.cast("string")).cast("binary"), 256), F.lit(16))


def end_times(timeline: DataFrame, session: str = "session_key", start: str = "start_time", place: str = "place") -> DataFrame:
    """timeline with next_later: the start of the first entry, in timeline order, that begins after an entry does.

    The first entry to exceed a value is always a record (greater than all before it), so it is the least record above
    the value: a range window over records replaces the search through the timeline. Null starts count as before all.
    """
    before = Window.partitionBy(session).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.coalesce(F.unix_micros(start), F.lit(ZERO_MICROS))
    record = F.when(F.col(start).isNotNull() & (F.col("k") > F.coalesce("seen", F.lit(ZERO_MICROS))), F.col(start))
    later = Window.partitionBy(session).orderBy("k").rangeBetween(1, Window.unboundedFollowing)
    return timeline.withColumn("k", micros).withColumn("seen", F.max("k").over(before)).withColumn("record", record).withColumn("next_later", F.min("record").over(later)).drop("k", "seen", "record")


def build_spans(sessions: DataFrame, events: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per span.

    sessions: session_key, session_id, harness, started_at; events: session_key, seq, ts, tool, action, targets, outside,
    result_bytes, is_error, summary; marks: session_key, seq, ts, type, note and, for ties, mark_pos. A user message begins a turn;
    later spans are its children until the next. Events or marks of unknown sessions are kept out.
    """
    paths = F.array_join(F.transform("targets", lambda t: t["path"]), ",")
    mark_pos = F.col("mark_pos") if "mark_pos" in marks.columns else F.lit(0).cast("long")
    pos_type = marks.select(mark_pos.alias("p")).schema["p"].dataType
    m = marks.select("session_key", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("is_event"), mark_pos.alias("input_pos"), "ts", F.col("type"), F.coalesce("note", F.lit("")).alias("note"))
    e = events.select(
        "session_key", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("is_event"), F.lit(None).cast(pos_type).alias("input_pos"), "ts", "tool", "action", F.col("result_bytes").cast("long").alias("result_bytes"),
        F.when(F.size("targets") > 0, paths).alias("targets"), F.when(F.size("outside") > 0, F.size("outside").cast("long")).alias("outside_count"), F.coalesce("is_error", F.lit(False)).alias("is_error"), "summary")
    head = sessions.select("session_key", "session_id", "harness", F.coalesce(parse_time(F.col("started_at")), F.lit(None)).alias("session_start"))
    line = m.unionByName(e, allowMissingColumns=True).join(head, "session_key")
    order = [F.col("seq"), F.col("is_event"), F.col("input_pos")]
    w = Window.partitionBy("session_key").orderBy(*order)
    same_seq = Window.partitionBy("session_key", "seq").orderBy("is_event", "input_pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    given = F.when(F.coalesce(F.col("ts"), F.lit("")) != "", F.col("ts"))
    near = F.first(F.when(F.col("is_event") == 1, given), True).over(same_seq)
    text = F.coalesce(given, F.when(F.col("is_event") == 0, near))
    line = line.withColumn("place", F.row_number().over(w)).withColumn("start_time", F.when(text.isNotNull(), parse_time(text)).otherwise(F.col("session_start")))
    line = end_times(line)
    known = (F.col("is_event") == 1) | F.col("type").isin("user-message", "compaction", "subagent")
    turn = F.col("type").eqNullSafe("user-message")
    placed = Window.partitionBy("session_key").orderBy("place")
    so_far = placed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = line.where(known).withColumn("trace_id", trace_id(F.col("session_key"))).withColumn("span_id", span_id(F.col("trace_id"), F.row_number().over(placed) - 1))
    spans = spans.withColumn("turn", F.last(F.when(turn, F.col("span_id")), True).over(so_far))
    children = Window.partitionBy("session_key", "turn").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last_child = F.last("start_time").over(children)
    n_children = F.count("*").over(children) - 1
    plain_end = F.coalesce("next_later", F.when(F.coalesce(F.col("session_start") > F.col("start_time"), F.col("start_time").isNull()), F.col("session_start")), "start_time")
    end = F.when(turn & (n_children > 0), F.coalesce(last_child, plain_end)).otherwise(plain_end)
    is_error = F.coalesce("is_error", F.lit(False))
    name = F.when(turn, truncate_runes(F.col("note"), NAME_LIMIT, "…")).when(F.col("type") == "compaction", "context-compaction").when(F.col("type") == "subagent", F.concat(F.lit("subagent:"), F.col("note"))).otherwise(F.col("summary"))
    attributes = F.struct(
        F.col("session_id").alias("agent.session.id"), F.when(turn, F.col("harness")).alias("agent.session.harness"), F.when(turn, "user-message").alias("agent.turn.type"),
        F.when(F.col("type").isin("compaction", "subagent"), F.col("type")).alias("agent.event.type"), F.when(F.col("type") == "subagent", F.col("note")).alias("agent.subagent.name"),
        F.col("tool").alias("agent.tool.name"), F.col("action").alias("agent.tool.action"), F.col("result_bytes").alias("agent.result.bytes"), F.col("targets").alias("agent.targets"), F.col("outside_count").alias("agent.outside_count"))
    return spans.select(
        "session_key", F.col("place").cast("long").alias("place"), "trace_id", "span_id", F.when(~turn, F.col("turn")).alias("parent_span_id"), name.alias("name"),
        F.when(F.col("type") == "subagent", 2).otherwise(0).alias("kind"), "start_time", end.alias("end_time"), attributes.alias("attributes"),
        F.when(is_error, 2).otherwise(1).alias("status"), F.when(is_error, F.col("summary")).alias("status_msg"))


def _json_text(c: Column) -> Column:
    """JSON with the three characters of markup as escapes."""
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        c = F.replace(c, F.lit(char), F.lit("\\u" + code))
    return c


def _time_text(c: Column) -> Column:
    return F.coalesce(rfc3339(c), F.lit(ZERO_TIME))


def trace_json(sessions: DataFrame, spans: DataFrame) -> DataFrame:
    """session_key, json: one object per trace: traceId, session and spans in order; empty fields are left out, attributes sorted by name."""
    names = ("agent.event.type", "agent.outside_count", "agent.result.bytes", "agent.session.harness", "agent.session.id", "agent.subagent.name", "agent.targets", "agent.tool.action", "agent.tool.name", "agent.turn.type")
    attributes = F.struct(*(F.col("attributes").getField(n).alias(n) for n in names))
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), blank("parent_span_id")("parentSpanId"), F.col("name"), "kind",
        _time_text(F.col("start_time")).alias("startTime"), _time_text(F.col("end_time")).alias("endTime"), attributes.alias("attributes"), "status", blank("status_msg")("statusMsg"))
    grouped = spans.groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("place", span.alias("span")))).alias("s")).select("session_key", F.transform("s", lambda x: x["span"]).alias("spans"))
    have = set(sessions.columns)
    fields = [("key", "session_key"), ("id", "session_id"), ("harness", "harness"), ("path", "path"), ("cwd", "cwd"), ("model", "model"), ("title", "title"), ("gitBranch", "git_branch"), ("startedAt", "started_at"), ("endedAt", "ended_at"), ("agentId", "agent_id")]
    meta = [blank(c)(n) for n, c in fields if c in have]
    if "is_sidechain" in have:
        meta.append(F.when(F.col("is_sidechain"), True).alias("isSidechain"))
    joined = sessions.join(grouped, "session_key", "left")
    body = F.struct(trace_id(F.col("session_key")).alias("traceId"), F.struct(*meta).alias("session"), F.col("spans"))
    return joined.select("session_key", _json_text(F.to_json(body)).alias("json"))

"""Pairing tool calls with their results, numbering events, and placing marks among them. Windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The payload of a call (tool, input, ts, cwd) and of a result (content, is_error); all are carried along.
CALL, RESULT = ("tool", "input", "ts"), ("content", "is_error")


def pair_latest(items: DataFrame, session: str = "session_key") -> DataFrame:
    """Calls with results, where a result takes the last open call of its id.

    items: session_key, pos (order in the session), kind ('call', 'result', or 'event' for a call that carries its own
    result), call_id, tool, input, ts, cwd (as known at that place), content, is_error. Results without an open call are
    dropped; a call that another of its id follows is replaced by it; calls left open come last, in the order in which
    their ids first occurred, without a result. Adds seq, counted from 0. pos of a paired event is that of its result.
    """
    same = Window.partitionBy(session, "kind_group", "call_id").orderBy("pos")
    both = items.withColumn("kind_group", F.when(F.col("kind") == "event", F.col("pos").cast("string")).otherwise(""))
    lagged = [F.lag(c).over(same).alias(f"call_{c}") for c in ("kind", *CALL)]
    marked = both.select("*", *lagged, F.lead("kind").over(same).alias("next_kind"), F.min(F.when(F.col("kind") == "call", F.col("pos"))).over(Window.partitionBy(session, "kind_group", "call_id")).alias("first_pos"),
                         F.last(F.col("cwd"), True).over(Window.partitionBy(session).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_cwd"))
    paired = marked.where((F.col("kind") == "result") & (F.col("call_kind") == "call")).select(
        session, "pos", F.lit(0).alias("open"), "call_id", *(F.col(f"call_{c}").alias(c) for c in CALL), "cwd", *RESULT)
    own = marked.where(F.col("kind") == "event").select(session, "pos", F.lit(0).alias("open"), "call_id", *CALL, "cwd", *RESULT)
    left = marked.where((F.col("kind") == "call") & F.col("next_kind").isNull()).select(
        session, F.col("first_pos").alias("pos"), F.lit(1).alias("open"), "call_id", *CALL, F.col("last_cwd").alias("cwd"), F.lit("").alias("content"), F.lit(False).alias("is_error"))
    order = Window.partitionBy(session).orderBy("open", "pos")
    return paired.unionByName(own).unionByName(left).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def pair_first(items: DataFrame, session: str = "session_key") -> DataFrame:
    """Calls with results, where the first call and, after it, the first result of an id count. seq follows the calls.

    items as for pair_latest (kinds 'call' and 'result').
    """
    same = Window.partitionBy(session, "call_id").orderBy("pos")
    after = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_call = F.min(F.when(F.col("kind") == "call", F.col("pos"))).over(after)
    seen = items.withColumn("call_pos", first_call)
    result = F.when((F.col("kind") == "result") & (F.col("pos") > F.col("call_pos")), F.struct(F.col("pos"), *RESULT))
    joined = seen.withColumn("r", F.min(result).over(after)).where((F.col("kind") == "call") & (F.col("pos") == F.col("call_pos")))
    order = Window.partitionBy(session).orderBy("pos")
    return joined.select(
        session, "pos", "call_id", *CALL, "cwd", F.coalesce("r.content", F.lit("")).alias("content"), F.coalesce("r.is_error", F.lit(False)).alias("is_error"),
        F.col("r").isNotNull().alias("answered")).withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def mark_positions(marks: DataFrame, events: DataFrame, session: str = "session_key") -> DataFrame:
    """marks with seq: the number of events that come before them. Both have session_key and pos; events come first at equal pos only if they carry a lesser tie."""
    order = Window.partitionBy(session).orderBy("pos", "is_event", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.select("*", F.lit(0).alias("is_event")).unionByName(
        events.select(session, "pos", F.lit(1).alias("is_event"), F.lit(0).alias("tie")), allowMissingColumns=True) if "tie" in marks.columns else marks.select(
        "*", F.lit(0).alias("is_event"), F.lit(0).alias("tie")).unionByName(events.select(session, "pos", F.lit(1).alias("is_event"), F.lit(0).alias("tie")), allowMissingColumns=True)
    return both.withColumn("seq", F.sum("is_event").over(order).cast("long")).where(F.col("is_event") == 0).drop("is_event", "tie")


def ride(marks: DataFrame, events: DataFrame, session: str = "session_key") -> DataFrame:
    """marks with event_seq: the first event at or after their seq; null while there is none."""
    order = Window.partitionBy(session).orderBy("seq", "is_event").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = marks.select("*", F.lit(0).alias("is_event"), F.lit(None).cast("long").alias("own")).unionByName(
        events.select(session, "seq", F.lit(1).alias("is_event"), F.col("seq").cast("long").alias("own")), allowMissingColumns=True)
    return both.withColumn("event_seq", F.first("own", True).over(order)).where(F.col("is_event") == 0).drop("is_event", "own")


def safe_watermark(items: DataFrame, session: str = "session_key", offset: str = "end_offset") -> DataFrame:
    """session_key, watermark: the last offset at which no call is open; null if there is none.

    items: session_key, pos, opens (+1 for a call, -1 for the result it gets, 0), and the offset past each record.
    """
    order = Window.partitionBy(session).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = items.withColumn("open", F.sum("opens").over(order))
    return running.groupBy(session).agg(F.max(F.when(F.col("open") == 0, F.col(offset))).alias("watermark"))


def running_first(value: Column, session: str = "session_key", order: str = "pos") -> Column:
    """The first non-empty value of a session so far."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.first(F.when(value != "", value), True).over(w)

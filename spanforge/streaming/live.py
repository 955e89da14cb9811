"""Live sessions: calls paired with results as they arrive, marks that ride on events, and sessions that fall silent.

One stateful operator for every source. Its input are a source's items (see ``claude.items``), row by row the same as a batch reads. Its state, by
session, are the open calls (a map by id), the marks that wait for an event (a list), and one row of what goes on from batch to batch: the
next number, the first working directory, and the last place seen. So a call whose result comes in a later batch is
given out then, once, against the directory that the head of its session named, and numbers go on after a restart or when a file is
written anew.

Timers end a session: after ``idle_after`` seconds without anything new, by the session's own times, it is reported idle; after ``forget_after`` more its open calls
are given out without a result, its last marks with them, and its state is dropped but for the number of the next event and the last place seen. New input makes
it active again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanforge.functions.text import parse_time
from spanforge.operators.classify import ClassifyOptions, build_events
from spanforge.sources import claude
from spanforge.streaming.tail import tail_lines

MARKS = "array<struct<type: string, note: string, ts: string, seq: long>>"
#: state: 'event' for an answered call, 'open' for one that was never answered, 'idle' when a session falls silent, 'gone' when it is forgotten.
LIVE = f"session_key string, state string, seq long, call_id string, tool string, input string, ts string, cwd string, content string, is_error boolean, marks {MARKS}, last_activity timestamp"
COLUMNS = ["session_key", "state", "seq", "call_id", "tool", "input", "ts", "cwd", "content", "is_error", "marks", "last_activity"]
IDLE_AFTER, FORGET_AFTER = 30.0, 3600.0


class Sessions(StatefulProcessor):
    def __init__(self, idle_after: float, forget_after: float):
        self.idle_ms, self.forget_ms = int(idle_after * 1000), int(forget_after * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.going = handle.getValueState("going", "seq long, cwd string, g long, a long, b long, c long, opened long")
        self.activity = handle.getValueState("activity", "at long, idle boolean")
        self.open = handle.getMapState("open", "call_id string", "tool string, input string, ts string, opened long")
        self.waiting = handle.getListState("waiting", "type string, note string, ts string, seq long")

    def _row(self, key: tuple, state: str, seq: int | None, at: int | None, call: tuple = (None,) * 7, marks: list | None = None) -> tuple:
        return (key[0], state, seq, *call, marks or [], None if at is None else pd.Timestamp(at, unit="ms"))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        out["seq"] = out["seq"].astype("Int64")
        out["last_activity"] = pd.to_datetime(out["last_activity"])
        return out

    def _due(self, at: int) -> None:
        """One timer, at this time."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, cwd, *last, opened = self.going.get() if self.going.exists() else (0, "", -1, -1, -1, -1, 0)
        last = tuple(last)
        now = timerValues.getCurrentProcessingTimeInMs()
        newest = self.activity.get()[0] if self.activity.exists() else None
        frame = pd.concat(list(rows))
        frame = frame.sort_values(["g", "a", "b", "c"], kind="stable")
        # What this batch does to the open calls and marks is gathered, so that state is written once for each.
        calls: dict[str, tuple | None] = {}
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        out = []
        for r in frame.itertuples(index=False):
            place = (r.g, r.a, r.b, r.c)
            if place <= last:
                continue  # read before
            last = place
            cwd = cwd or r.cwd
            if r.at_ms == r.at_ms and r.at_ms is not None:
                newest = max(newest or 0, int(r.at_ms))
            if r.kind == "call":
                first = self._open_call(calls, r.call_id)
                calls[r.call_id] = (r.tool, r.input, r.ts, first[3] if first else opened)
                opened += 1
            elif r.kind == "result":
                call = self._open_call(calls, r.call_id)
                if call is None:
                    continue
                calls[r.call_id] = None
                out.append((key[0], "event", seq, r.call_id, *call[:3], cwd, r.content, bool(r.is_error), waiting, None))
                waiting = []
                seq += 1
            elif r.kind != "cwd":
                waiting = [*waiting, (r.kind, r.note, r.mark_ts, seq)]
        for call_id, call in calls.items():
            if call is not None:
                self.open.updateValue((call_id,), call)
            elif self.open.containsKey((call_id,)):
                self.open.removeKey((call_id,))
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        self.going.update((seq, cwd, *last, opened))
        at = now if newest is None else newest
        self.activity.update((at, False))
        self._due(max(now, at + self.idle_ms) + 1)
        yield self._frame([(*r[:-1], pd.Timestamp(at, unit="ms")) for r in out])

    def _open_call(self, calls: dict[str, tuple | None], call_id: str) -> tuple | None:
        return calls[call_id] if call_id in calls else self.open.getValue((call_id,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, idle = self.activity.get() if self.activity.exists() else (None, True)
        if not idle:
            self.activity.update((at, True))
            self._due(expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)
            yield self._frame([self._row(key, "idle", None, at)])
            return
        seq, cwd, *last, opened = self.going.get()
        marks = [tuple(m) for m in self.waiting.get()] if self.waiting.exists() else []
        out = []
        left = sorted(self.open.iterator(), key=lambda e: e[1][3]) if self.open.exists() else []
        for (call_id,), (tool, given, ts, _) in left:
            out.append(self._row(key, "open", seq, at, (call_id, tool, given, ts, cwd, "", False)))
            seq += 1
        out.append(self._row(key, "gone", None, at, marks=marks))
        self.open.clear()
        self.waiting.clear()
        self.activity.clear()
        self.going.update((seq, cwd, *last, opened))
        yield self._frame(out)


def live_sessions(items: DataFrame, idle_after: float = IDLE_AFTER, forget_after: float = FORGET_AFTER, marks_have_times: bool = False) -> DataFrame:
    """A stream in the columns of LIVE from a stream of items: session_key, pos (of g, a, b, c), kind, call_id, tool, input, ts, cwd, content, is_error, note.

    marks_have_times: whether marks keep the time of their record, as the batch reading of the same source does.
    """
    place = [F.col(f"pos.{n}").alias(n) for n in "gabc"]
    rows = items.select(
        "session_key", *place, "kind", "call_id", "tool", "input", "ts", "cwd", "content", "is_error", "note", (F.unix_micros(parse_time(F.col("ts"))) / 1000).cast("long").alias("at_ms"), (F.col("ts") if marks_have_times else F.lit("")).alias("mark_ts"))
    return rows.groupBy("session_key").transformWithStateInPandas(Sessions(idle_after, forget_after), LIVE, "append", "processingTime")


def claude_items(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """The items of growing logs of harness claude-code."""
    lines = tail_lines(spark, folder, max_bytes=max_bytes).where(~F.col("path").rlike(r"(^|/)agent-[^/]*\z"))
    rows = claude.records(lines.withColumn("line_no", F.col("offset")), keep=("generation",))
    return claude.items(rows, F.col("generation"), F.col("line_no"), F.lit(0))


def live_events(sessions: DataFrame, options: ClassifyOptions = ClassifyOptions()) -> DataFrame:
    """The events of live_sessions, classified as a batch classifies them, with their marks."""
    return build_events(sessions.where(F.col("state").isin("event", "open")), options, split=False)


def activity(sessions: DataFrame) -> DataFrame:
    """session_key, state, last_activity: a row for each event ('active') and each time a session falls silent or is forgotten."""
    return sessions.select("session_key", F.when(F.col("state").isin("idle", "gone"), F.col("state")).otherwise("active").alias("state"), "last_activity")


"""Session tables: metadata folds, keys, filters, listing order, idleness, and graphs of parents and children."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.paths import path_clean
from spanforge.functions.text import parse_time
from spanforge.operators.ranking import ranked
from spanforge.session import checkpointed


def session_key(harness: Column, path: Column) -> Column:
    """A stable key from the harness and the path of a session, which sources give absolute and clean: Spark lists files so, and paths of stores are made so."""
    digest = F.sha2(F.concat(harness, F.lit("\x00"), path).cast("binary"), 256)
    return F.concat(harness, F.lit("-"), F.left(digest, F.lit(24)))


def first_value(value: Column, order: Column) -> Column:
    """Aggregate: the first non-empty value in order."""
    return F.min_by(F.when(value != "", value), F.when(value != "", order))


def last_value(value: Column, order: Column) -> Column:
    """Aggregate: the last non-empty value in order."""
    return F.max_by(F.when(value != "", value), F.when(value != "", order))


def cwd_matches(session_cwd: Column, wanted: str) -> Column:
    """Whether a working directory is the wanted one or lies in it, by whole path components. Nothing matches ''."""
    if not wanted:
        return F.lit(False)
    own, root = path_clean(session_cwd), path_clean(F.lit(wanted))
    return F.coalesce((session_cwd != "") & ((own == root) | F.startswith(own, F.concat(root, F.lit("/")))), F.lit(False))


def list_filtered(sessions: DataFrame, cwd: str | None = None, since: datetime | None = None) -> DataFrame:
    """Sessions in a working directory and started at an instant or later; without criteria, all of them.

    Sessions whose start is missing or can't be read don't pass a time criterion.
    """
    tests = []
    if cwd:
        tests.append(cwd_matches(F.col("cwd"), cwd))
    if since is not None:
        tests.append(F.col("started_ts") >= F.lit(since))
    return sessions.where(reduce(lambda a, b: a & b, tests)) if tests else sessions


def by_recency(sessions: DataFrame) -> DataFrame:
    """A total order: latest end first, unknown ends last, then by key."""
    return sessions.orderBy(F.col("ended_ts").desc_nulls_last(), F.col("session_key"))


def with_times(sessions: DataFrame) -> DataFrame:
    """sessions with started_ts and ended_ts."""
    return sessions.withColumns({"started_ts": parse_time(F.col("started_at")), "ended_ts": parse_time(F.col("ended_at"))})


def last_activity(events: DataFrame, marks: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_key, last_activity: the time of the last event, or else the session's end, or the newest mark if that is later."""
    e = events.groupBy("session_key").agg(F.max_by(parse_time(F.col("ts")), F.col("seq")).alias("event_ts"))
    m = marks.groupBy("session_key").agg(F.max(parse_time(F.col("ts"))).alias("mark_ts"))
    joined = sessions.select("session_key", parse_time(F.col("ended_at")).alias("ended")).join(e, "session_key", "left").join(m, "session_key", "left")
    return joined.select("session_key", F.greatest(F.coalesce("event_ts", "ended"), F.col("mark_ts")).alias("last_activity"))


def idle(activity: DataFrame, now: Column, after_seconds: float = 30.0) -> DataFrame:
    """activity with idle: unknown activity, or none for longer than the threshold."""
    quiet = F.unix_micros(now.cast("timestamp")) - F.unix_micros("last_activity")
    return activity.withColumn("idle", F.coalesce(quiet > F.lit(int(after_seconds * 1_000_000)), F.lit(True)))


def agent_nodes(sessions: DataFrame) -> DataFrame:
    """session_id, parent_id, harness, started_at, title of all sessions, sub-agents too; '' is no parent."""
    return sessions.select("session_id", F.when(F.col("parent_id") != "", F.col("parent_id")).alias("parent_id"), "harness", "started_at", "title")


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_id").isNull()).orderBy("started_at", "session_id")


def children(nodes: DataFrame) -> DataFrame:
    """parent_id, children: the ids under each parent (also of parents that are missing), by creation."""
    own = nodes.where(F.col("parent_id").isNotNull())
    listed = F.array_sort(F.collect_list(F.struct("started_at", "session_id")))
    return own.groupBy("parent_id").agg(F.transform(listed, lambda x: x["session_id"]).alias("children"))


def lineage(nodes: DataFrame) -> DataFrame:
    """session_id, root_id, depth, kind: where the parents of each node lead.

    kind is 'root' for nodes under a root (root_id is the root), 'orphan' for those whose line ends at an id that is no node (root_id is that
    id, depth counts from it), 'cycle' for nodes that are their own ancestors, and 'under cycle' for those that such nodes are ancestors of
    (root_id is the smallest id of the cycle; no depth). An id that occurs more than once counts once, with its smallest parent.

    By pointer doubling: each round joins what a node's pointer leads to, so a line of n nodes takes log2(n) rounds, each written to the shared
    folder. A round that ends no line shows that the rest leads into cycles.
    """
    own = nodes.groupBy("session_id").agg(F.min("parent_id").alias("parent_id")).select(F.col("session_id").alias("node"), "parent_id")
    known = own.select(F.col("node").alias("parent_id"), F.lit(True).alias("known"))
    first = own.join(known, "parent_id", "left")
    is_root = F.col("parent_id").isNull()
    # up: where the pointer leads; low: the smallest id it has passed; done: whether that is an end.
    state = checkpointed(first.select(
        "node", F.coalesce("parent_id", "node").alias("up"), F.when(is_root, 0).otherwise(1).cast("long").alias("depth"), F.when(is_root, "root").when(F.col("known").isNull(), "orphan").alias("kind"), F.least("node", "parent_id").alias("low")))
    left, jumped = state.where(F.col("kind").isNull()).count(), 1
    ended = True
    while left and (ended or jumped < left):
        at = state.select(F.col("node").alias("up"), *(F.col(c).alias(f"next_{c}") for c in ("up", "depth", "kind", "low")))
        open_rows = state.where(F.col("kind").isNull())
        moved = open_rows.join(at, "up", "left").select(
            "node", F.coalesce("next_up", "up").alias("up"), (F.col("depth") + F.coalesce("next_depth", F.lit(0))).alias("depth"), F.col("next_kind").alias("kind"), F.least("low", "next_low").alias("low"))
        state = checkpointed(state.where(F.col("kind").isNotNull()).unionByName(moved))
        rest = state.where(F.col("kind").isNull()).count()
        ended, left, jumped = rest < left, rest, jumped * 2
    # After as many steps as there are nodes left, pointers lead to all nodes of cycles and to no others.
    loops = state.where(F.col("kind").isNull())
    on = loops.select(F.col("up").alias("node")).distinct().withColumn("on", F.lit(True))
    smallest = loops.join(on, "node").select(F.col("node").alias("up"), F.col("low").alias("cycle"))
    named = loops.join(on, "node", "left").join(smallest, "up").select("node", F.col("cycle").alias("up"), F.lit(None).cast("long").alias("depth"), F.when(F.col("on"), "cycle").otherwise("under cycle").alias("kind"))
    out = state.where(F.col("kind").isNotNull()).select("node", "up", "depth", "kind").unionByName(named)
    return out.select(F.col("node").alias("session_id"), F.col("up").alias("root_id"), F.col("depth"), "kind")


def depths(nodes: DataFrame) -> DataFrame:
    """session_id, root_id, depth of all nodes that roots reach, however deep."""
    return lineage(nodes).where(F.col("kind") == "root").select("session_id", "root_id", F.col("depth").cast("int").alias("depth"))


#: The orders in which listings show sessions: by instants and keys; by the text of the end, as logs have it; by end and id.
RECENCY, TEXT, STORE = "recency", "text", "store"


def listing(sessions: DataFrame, order: str = RECENCY) -> DataFrame:
    """sessions with position, from 0, in the order of a listing: a total order over all rows, ranked by ranges (see ``ranking.ranked``).

    recency: latest end first, unknown ends last, then by key. text: by the text of the end, latest first, then by key. store: latest end first, then the larger id.
    """
    end = F.col("ended_ts").desc_nulls_last()
    by = {RECENCY: [end, F.col("session_key")], TEXT: [F.col("ended_at").desc(), F.col("session_key")], STORE: [end, F.col("session_id").desc()]}[order]
    narrow = sessions.select("session_key", "session_id", "ended_at", "ended_ts")
    return sessions.join(ranked(narrow, by, out="position").select("session_key", "position"), "session_key")

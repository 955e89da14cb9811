"""The known harnesses, where their logs lie below a home folder, and what is wrong where they don't."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from spanforge.sources import claude, codex, pi, stores
from spanforge.sources.parsed import Parsed
from spanforge.sources.sqlite import BUSY_SECONDS

CHECKS = "harness string, name string, status string, detail string"
#: What a store must have to be read.
TABLES = {"crush": ("sessions", "messages"), "opencode": ("session", "message", "part")}


@dataclass(frozen=True)
class Source:
    """A harness: its place below a home folder, whether that is a folder, and how it is read. New ones can be registered.

    filters: whether read takes cwd and since, to leave out early what can't pass; others are filtered after reading.
    """

    harness: str
    place: str
    is_folder: bool
    read: Callable[..., Parsed]
    filters: bool = False

    def at(self, root: str) -> str:
        return os.path.join(root, self.place)

    def sessions_of(self, spark: SparkSession, root: str, cwd: str | None = None, since: datetime | None = None) -> Parsed:
        """What the harness has below a home folder, of sessions in a working directory and begun at an instant or later."""
        if self.filters:
            return self.read(spark, self.at(root), cwd=cwd, since=since)
        return self.read(spark, self.at(root)).filtered(cwd, since)


def _codex(spark: SparkSession, folder: str, cwd: str | None = None, since: datetime | None = None) -> Parsed:
    index = os.path.join(os.path.dirname(folder.rstrip("/")), "session_index.jsonl")
    return codex.read(spark, folder, index if os.path.isfile(index) else None, cwd=cwd, since=since)


def _crush(spark: SparkSession, path: str, cwd: str | None = None, since: datetime | None = None) -> Parsed:
    return stores.crush(spark, stores.crush_projects(path, cwd), since).filtered(cwd, since)


def _opencode(spark: SparkSession, path: str, cwd: str | None = None, since: datetime | None = None) -> Parsed:
    return stores.opencode(spark, path, since).filtered(cwd, since)


SOURCES: dict[str, Source] = {
    "claude-code": Source("claude-code", ".claude/projects", True, claude.read, True),
    "codex": Source("codex", ".codex/sessions", True, _codex, True),
    "crush": Source("crush", ".local/share/crush/projects.json", False, _crush, True),
    "opencode": Source("opencode", ".opencode/opencode.db", False, _opencode, True),
    "pi": Source("pi", ".pi/agent/sessions", True, pi.read, True),
}


def register(source: Source) -> None:
    SOURCES[source.harness] = source


def read_all(spark: SparkSession, root: str, cwd: str | None = None, since: datetime | None = None) -> dict[str, Parsed]:
    """What every harness whose logs exist below a home folder has, of sessions that pass."""
    return {h: s.sessions_of(spark, root, cwd, since) for h, s in SOURCES.items() if os.path.exists(s.at(root))}


def check(source: Source, path: str) -> tuple[str, str, str, str]:
    """harness, name, status (ok, warn, error), detail of a source's place."""
    name = "directory" if source.is_folder else "file"
    if not path.strip():
        return source.harness, name, "error", "no path"
    if not os.path.exists(path):
        return source.harness, name, "warn", f"missing: {path}"
    if source.is_folder != os.path.isdir(path):
        return source.harness, name, "error", f"not a {name}: {path}"
    try:
        if source.is_folder:
            return source.harness, name, "ok", f"{len(os.listdir(path))} entries"
        if source.harness in TABLES and not path.endswith(".json"):
            return source.harness, "store", *store_status(path, TABLES[source.harness])
        with open(path, encoding="utf-8") as f:
            projects = json.load(f).get("projects") or []
        return source.harness, name, "ok", f"{len(projects)} projects"
    except (OSError, ValueError, AttributeError) as error:
        return source.harness, name, "error", f"can't be read: {error}"


def store_status(path: str, tables: Sequence[str]) -> tuple[str, str]:
    """Status and detail of a SQLite file: whether it opens, its pages are sound as far as a short check tells, and it has its tables."""
    if not os.path.isfile(path):
        return "warn", f"missing: {path}"
    try:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=BUSY_SECONDS)) as db:
            found = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
            lacking = [t for t in tables if t not in found]
            if lacking:
                return "error", "no table " + ", ".join(lacking)
            sound = db.execute("PRAGMA quick_check(1)").fetchone()[0]
            if sound != "ok":
                return "error", sound
            return "ok", ", ".join(f"{db.execute(f'SELECT count(*) FROM {t}').fetchone()[0]} {t}" for t in tables)
    except sqlite3.Error as error:
        return "error", f"can't be read: {error}"


def diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """harness, name, status, detail: whether the logs of each harness can be read, and a row for each store that a projects file names.

    The probes run in tasks, where stores are read too; the driver only lists them."""
    places = [(h, s.at(root), False) for h, s in SOURCES.items()]
    crush = SOURCES.get("crush")
    if crush is not None:
        places += [("crush", database, True) for database in stores.crush_databases(crush.at(root))]
    known = dict(SOURCES)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, "store", *store_status(path, TABLES[h])) if store else check(known[h], path) for h, path, store in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["harness", "name", "status", "detail"])

    return spark.createDataFrame(places, "harness string, path string, store boolean").repartition(max(1, min(len(places), 32))).mapInPandas(probe, CHECKS)

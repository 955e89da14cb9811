"""What every source gives: sessions, paired calls, and marks, from which events and spans follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.classify import ClassifyOptions, build_events
from spanforge.operators.pairing import mark_positions
from spanforge.operators.sessions import RECENCY, list_filtered, listing, with_times
from spanforge.operators.trace import build_spans


@dataclass(frozen=True)
class Parsed:
    """sessions: one row each; calls: one row per interaction with seq; marks: with seq and their own order."""

    sessions: DataFrame
    calls: DataFrame
    marks: DataFrame
    order: str = RECENCY  # of listings
    made: dict = field(default_factory=dict, repr=False, compare=False)  # events and spans that were asked for: building their plans takes seconds

    @classmethod
    def of(cls, sessions: DataFrame, calls: DataFrame, marks: DataFrame, numbered: bool = False, order: str = RECENCY) -> Parsed:
        """Marks without seq are placed among the answered calls by pos. Calls and marks of unknown sessions go."""
        if not numbered:
            answered = calls.where(F.col("open") == 0) if "open" in calls.columns else calls
            marks = mark_positions(marks, answered)
        known = sessions.select("session_key")
        return cls(with_times(sessions), calls.join(known, "session_key", "left_semi"), marks.join(known, "session_key", "left_semi").withColumn("mark_pos", F.col("pos")), order)

    def events(self, options: ClassifyOptions = ClassifyOptions(), repo_files: DataFrame | None = None) -> DataFrame:
        key = ("events", repr(options), id(repo_files))
        if key not in self.made:
            self.made[key] = build_events(self.calls, options, repo_files), repo_files
        return self.made[key][0]

    def spans(self, options: ClassifyOptions = ClassifyOptions()) -> DataFrame:
        key = ("spans", repr(options))
        if key not in self.made:
            self.made[key] = build_spans(self.sessions, self.events(options), self.marks)
        return self.made[key]

    def filtered(self, cwd: str | None = None, since: datetime | None = None) -> Parsed:
        """Only the sessions in a working directory, and begun at an instant or later, with what is theirs; the exact test, whatever a source has left out before."""
        if not cwd and since is None:
            return self
        sessions = list_filtered(self.sessions, cwd, since)
        known = sessions.select("session_key")
        return Parsed(sessions, self.calls.join(known, "session_key", "left_semi"), self.marks.join(known, "session_key", "left_semi"), self.order)

    def listed(self) -> DataFrame:
        """The sessions that a listing shows: no sub-agents."""
        return self.sessions.where(~F.col("auxiliary"))

    def listing(self) -> DataFrame:
        """The same, with their position in this source's order."""
        return listing(self.listed(), self.order)

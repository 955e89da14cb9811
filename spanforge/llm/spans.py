"""Native span location: regular-expression matches with code-point offsets, in DataFrame functions only.

Spark has no function that returns the positions of all matches. ``regexp_extract_all`` gives the matches and
``split`` by the same pattern gives what lies between them, so a running sum of lengths gives every position. The sum
runs in blocks, so that its cost stays close to linear in the number of matches of one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
FOUND = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Proposal:
    """A kind of span: its pattern, a cheaper pattern that every text with a match also has, and what confirms it."""

    kind: str
    pattern: str
    gate: str
    confirm: object  # Column of struct(hit, before, after) -> Column of boolean
    score: object  # Column of struct(hit, before, after) -> Column of double


def _placed(pieces: Column, base: Column) -> Column:
    """The pieces of one block with their positions, the first of which begins to be counted at base."""
    step = F.aggregate(
        pieces,
        F.struct(base.alias("at"), F.array().cast(FOUND).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["n_before"] + x["n_hit"]).alias("at"),
            F.array_append(
                acc["out"],
                F.struct(
                    (acc["at"] + x["n_before"]).alias("start"), (acc["at"] + x["n_before"] + x["n_hit"]).alias("end"),
                    x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"),
                ),
            ).alias("out"),
        ),
    )
    return step["out"]


def with_found(df: DataFrame, text: str, name: str, pattern: str, gate: str) -> DataFrame:
    """Add column name: every leftmost non-overlapping match with its place and the text on either side of it.

    Each stage is a projection of its own whose inputs are used more than once, so that Catalyst keeps it apart and
    no regular expression is evaluated again for each element.
    """
    has = F.col(text).rlike(gate)
    hits, gaps, pieces, blocks, bases = (f"__{name}_{x}" for x in ("hits", "gaps", "pieces", "blocks", "bases"))
    empty = F.array().cast("array<string>")
    df = df.withColumns({
        hits: F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty),
        gaps: F.when(has, F.split(text, pattern, -1)).otherwise(empty),
    })
    sides = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)), F.slice(gaps, F.lit(2), F.size(hits)),
        lambda b, a: F.struct(b.alias("before"), a.alias("after"), F.length(b).alias("n_before")),
    )
    df = df.withColumn(pieces, F.when(F.size(hits) > 0, F.zip_with(F.col(hits), sides, lambda h, s: F.struct(
        h.alias("hit"), F.length(h).alias("n_hit"), s["before"].alias("before"), s["after"].alias("after"), s["n_before"].alias("n_before")))))
    last = F.floor((F.size(pieces) - 1) / BLOCK).cast("int")
    df = df.withColumn(blocks, F.when(F.col(pieces).isNotNull(), F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK)))))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["n_before"] + x["n_hit"]))
    df = df.withColumn(bases, F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)))
    found = F.flatten(F.zip_with(F.col(blocks), F.slice(bases, F.lit(1), F.size(blocks)), _placed))
    df = df.withColumn(name, F.coalesce(found, F.array().cast(FOUND)))
    return df.drop(hits, gaps, pieces, blocks, bases)


def _as_span(p: Proposal, rank: int):
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(p.kind).alias("kind"),
        p.score(x).cast("double").alias("score"))


def of_rank(rank: int):
    """A filter's function: the spans of one kind."""
    return lambda s: s["rank"] == rank


def with_spans(df: DataFrame, text: str, proposals: list[Proposal], out: str) -> DataFrame:
    """Add column out: the confirmed spans of every proposal, by start, then by the proposals' order."""
    parts = []
    for rank, p in enumerate(proposals):
        name = f"__found_{p.kind}"
        df = with_found(df, text, name, p.pattern, p.gate)
        kept = F.filter(name, p.confirm)
        parts.append(F.transform(kept, _as_span(p, rank)).cast(SPAN))
    df = df.withColumn(out, F.array_sort(F.concat(*parts)))
    return df.drop(*(f"__found_{p.kind}" for p in proposals))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of spans that overlap, the first stays and the next is cut off."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(
        spans, begin,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(
                F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            ))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)


def near(x: Column, words: str, before: int = 40, after: int = 20) -> Column:
    """Whether one of the words (an alternation) stands close to a match, in the text between it and its neighbours."""
    around = F.concat_ws(" ", F.right(x["before"], F.lit(before)), F.left(x["after"], F.lit(after)))
    return F.lower(around).rlike(words)


def alone(x: Column) -> Column:
    """Whether no letter or digit adjoins a match."""
    return ~F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(x["after"], F.lit(1)).rlike("[A-Za-z0-9]")

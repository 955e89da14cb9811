"""Line-delimited JSON files as rows (path, line_no, line, end_offset), and decoded fields with their types checked."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.text import is_kind, parse_time, string_at, trim_space, value_at, variant
from spanforge.operators.sessions import cwd_matches


#: What is read of a file to know where and when its session began.
HEAD_LINES, HEAD_BYTES = 64, 1 << 18
#: Files of no more bytes are read whole where no offsets are asked for.
WHOLE_BYTES = 1 << 20


def mounted(folder: str) -> bool:
    """Whether a folder is one of a mounted file system, so that tasks can open its files."""
    return "://" not in folder or folder.startswith("file://")


def local_path(url: Column) -> Column:
    """The path of a URL of Spark's file readers; those of other stores stay as they are."""
    return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def listed_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path of each file below a folder; none is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select(local_path(F.col("path")).alias("path"))


def head_lines(files: DataFrame) -> DataFrame:
    """path, line_no, line, end_offset of the first lines of each file; each task opens its share of files and reads at most HEAD_BYTES of each. A last line that isn't ended is left out."""

    def peek(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(path, "rb") as f:
                    parts = f.read(HEAD_BYTES).split(b"\n")[:-1][:HEAD_LINES]
                if not parts:
                    continue
                ends = list(accumulate(len(p) + 1 for p in parts))
                yield pd.DataFrame({"path": path, "line_no": range(len(parts)), "line": [p.rstrip(b"\r").decode("utf-8", "replace") for p in parts], "end_offset": ends}, index=range(len(parts)))

    return files.select("path").mapInPandas(peek, "path string, line_no long, line string, end_offset long").where(F.col("line") != "")


def files_of(spark: SparkSession, folder: str, pattern: str, starts: Callable[[DataFrame], DataFrame], cwd: str | None, since: datetime | None) -> str | list[str]:
    """What of a folder can hold sessions in a working directory that began at an instant or later: the folder itself where nothing is asked, or its files can't be opened by tasks.

    starts: from lines to path, cwd, started_at, as the source's sessions have them; null where the lines don't tell. A file is left out only if its head tells that its session doesn't pass.
    """
    if (not cwd and since is None) or not mounted(folder):
        return folder
    files = listed_files(spark, folder, pattern)
    known = starts(head_lines(files))
    passes = F.lit(True)
    if cwd:
        passes &= F.coalesce(F.when(F.col("cwd") != "", cwd_matches(F.col("cwd"), cwd)), F.lit(True))
    if since is not None:
        passes &= F.when(F.coalesce(F.col("started_at"), F.lit("")) == "", True).otherwise(F.coalesce(parse_time(F.col("started_at")) >= F.lit(since), F.lit(False)))
    gone = known.where(~passes).select("path")
    return [r["path"] for r in files.join(gone, "path", "left_anti").collect()]


def json_lines(spark: SparkSession, folder: str | list[str], pattern: str = "*.jsonl", complete: bool = False, larger_than: int = -1) -> DataFrame:
    """path, line_no, line, end_offset: all non-empty lines of the files below a folder (or of some files), without line ends; a last line that
    isn't ended counts, unless only complete lines are wanted; files of larger_than bytes or less are left unread. line_no counts from 0, empty lines too; end_offset is the byte after a line.

    Spark's reader cuts files into byte ranges (spark.sql.files.maxPartitionBytes), so one large file takes all cores. A line belongs
    to the range it begins in. Lines are numbered inside their range as they are read, and a range's first number and first byte
    are the sums of the counts of the ranges before it, one row for each range: lines are not shuffled to be numbered. Their
    bytes are summed by range, which takes a shuffle, only where end_offset is used.
    """
    if not folder:
        return spark.createDataFrame([], "path string, line_no long, line string, end_offset long")
    # Carriage returns stay in the line until its bytes are counted.
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder).where(F.col("_metadata.file_size") > larger_than)
    rows = read.select(F.col("_metadata.file_path").alias("url"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"), "value", F.monotonically_increasing_id().alias("at"))
    size = F.octet_length("value") + 1
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("url", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"), F.sum(size).alias("bytes"))
    ranges = ranges.select("url", "block", "first", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "bytes")))
    so_far = Window.partitionBy("url", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(ranges, ["url", "block"]).withColumn("end_offset", F.col("bytes_before") + F.sum(size).over(so_far))
    if complete:
        placed = placed.where(F.col("end_offset") <= F.col("file_size"))
    out = placed.select(local_path(F.col("url")).alias("path"), (F.col("at") - F.col("first") + F.col("lines_before")).alias("line_no"), F.regexp_replace("value", r"\r+\z", "").alias("line"), "end_offset")
    return out.where(F.col("line") != "")


def numbered_lines(spark: SparkSession, folder: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """path, line_no, line, as json_lines gives them. A file of WHOLE_BYTES or less is one row that its lines are taken from in order, so many small
    files are opened once and nothing is shuffled or joined to number their lines; larger ones are read by ranges."""
    if not folder:
        return json_lines(spark, folder).drop("end_offset")
    size = F.col("_metadata.file_size")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    whole = reader.text(folder, wholetext=True).where(size <= WHOLE_BYTES).select(local_path(F.col("_metadata.file_path")).alias("path"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    small = whole.select("path", F.col("at").cast("long").alias("line_no"), F.regexp_replace("value", r"\r+\z", "").alias("line")).where(F.col("line") != "")
    large = json_lines(spark, folder, pattern, larger_than=WHOLE_BYTES).drop("end_offset")
    return small.unionByName(large)


def lines_between(path: str, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """(first byte, byte after, line with its end) of the lines of a local file that begin in [start, end); a last line that isn't ended is left out."""
    with open(path, "rb") as f:
        at = start
        if start:  # to the first line that begins here
            f.seek(start - 1)
            at += len(f.readline()) - 1
        while at < end:
            raw = f.readline()
            if not raw.endswith(b"\n"):
                return
            yield at, at + len(raw), raw
            at += len(raw)


def exists(folder: str) -> bool:
    """Whether a local folder is there; paths with a scheme are left to Spark."""
    return "://" in folder or os.path.isdir(folder)


def decoded(lines: DataFrame) -> DataFrame:
    """lines with v, what each says, decoded once: a filter on v would be moved below a plain column, and decode again for every field that it looks at."""
    return lines.select("*", F.explode(F.array(variant(F.col("line")))).alias("v"))


def text_field(v: Column, name: str) -> Column:
    """A string field; empty if missing or null."""
    return F.coalesce(string_at(v, f"$.{name}"), F.lit(""))


def well_typed(v: Column, strings: tuple[str, ...] = (), booleans: tuple[str, ...] = ()) -> Column:
    """Whether v is an object whose named fields have their types, or are missing or null; a record fails as a whole."""
    ok = is_kind(v, "OBJECT")

    def fits(name: str, kind: str) -> Column:
        x = value_at(v, f"$.{name}")
        return x.isNull() | F.is_variant_null(x) | is_kind(x, kind)

    for name in strings:
        ok = ok & fits(name, "STRING")
    for name in booleans:
        ok = ok & fits(name, "BOOLEAN")
    return ok


def content_items(v: Column) -> Column:
    """A message's content as an array of variants: null as none, a string as one text item, an array as it is."""
    wrapped = F.try_parse_json(F.to_json(F.struct(F.lit("text").alias("type"), F.try_variant_get(v, "$", "string").alias("text"))))
    none = F.array().cast("array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), none).when(is_kind(v, "STRING"), F.array(wrapped)).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), none))


def joined_texts(items: Column, any_type: bool = False) -> Column:
    """The trimmed, non-blank texts of content items, by line."""
    texts = F.transform(items, lambda x: F.when(F.lit(any_type) | string_at(x, "$.type").eqNullSafe("text"), trim_space(F.coalesce(string_at(x, "$.text"), F.lit("")))))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")

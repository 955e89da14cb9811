"""Files that grow, as a stream of their complete lines, each once.

An offset holds, for each file, a generation, the byte after the last line given out, and a digest of the file's first bytes. A file that
has become shorter, or whose first bytes have changed, was cut off or written anew: its generation goes up and it is read from its
beginning. (generation, byte) orders the lines of a path for good, so who numbers them goes on from where they were.

Half-written lines wait. With max_bytes a batch takes about so many bytes, dealt fairly: each file with a backlog may give an equal share, and
what a short one leaves goes to the others; a line that is longer than its file's share is given whole. The reader knows where the query is from
the batches that Spark plans, the last one before a restart too, so a backlog is taken up in as many batches as its bytes need.

Files lie on a file system that the driver and all executors mount. The driver lists it and reads, of files that have changed, the first bytes and the
stretch around the end of their share; executors read the lines, in ranges of ``RANGE`` bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from spanforge.sources.lines import lines_between

LINE = "path string, generation long, offset long, end_offset long, line string"
#: Bytes of one task, and first bytes by which a file is known.
RANGE, HEAD = 64 << 20, 256
STEP = 1 << 16


class FilePart(InputPartition):
    def __init__(self, path: str, generation: int, start: int, end: int):
        super().__init__(path)
        self.path, self.generation, self.start, self.end = path, generation, start, end


def digest(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.blake2b(f.read(min(size, HEAD)), digest_size=8).hexdigest()


def last_line_end(path: str, start: int, stop: int) -> int:
    """The byte after the last line end in [start, stop), or start."""
    with open(path, "rb") as f:
        at = stop
        while at > start:
            low = max(start, at - STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def next_line_end(path: str, start: int) -> int | None:
    """The byte after the first line end at or after start, if there is one."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start
        while piece := f.read(STEP):
            found = piece.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(piece)
    return None


def shares(backlogs: dict[str, int], most: int) -> dict[str, int]:
    """What each file may give of at most so many bytes: all of it, or as much as any other that isn't through."""
    out, left = {}, most
    for k, (path, size) in enumerate(sorted(backlogs.items(), key=lambda t: (t[1], t[0]))):
        out[path] = min(size, left // (len(backlogs) - k))
        left -= out[path]
    return out


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, max_bytes: int | None):
        self.folder, self.suffix, self.max_bytes = folder, suffix, max_bytes
        #: path -> [generation, offset, digest of the first bytes, how many of them]
        self.position: dict[str, list] = {}
        self.seen: dict[str, tuple] = {}  # what a file looked like when it was last known to be the same

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _known(self, path: str, stat: os.stat_result) -> tuple[int, int]:
        """Generation and offset to go on from."""
        if path not in self.position:
            return 0, 0
        generation, offset, head, length = self.position[path]
        look = (stat.st_ino, stat.st_size, stat.st_mtime_ns, generation, offset)
        if self.seen.get(path) != look:
            if stat.st_size < offset or (length and digest(path, length) != head):
                return generation + 1, 0
            self.seen[path] = look
        return generation, offset

    def latestOffset(self) -> dict:
        after = dict(self.position)
        backlog, begun = {}, {}
        for folder, _, names in os.walk(self.folder):
            for name in names:
                path = os.path.join(folder, name)
                if not name.endswith(self.suffix):
                    continue
                try:
                    stat = os.stat(path)
                    begun[path] = self._known(path, stat)
                except FileNotFoundError:
                    continue
                backlog[path] = stat.st_size - begun[path][1]
        # A last line that isn't complete takes no share.
        backlog = {p: end - begun[p][1] for p, n in backlog.items() if n > 0 and (end := last_line_end(p, begun[p][1], begun[p][1] + n)) > begun[p][1]}
        given = shares(backlog, self.max_bytes) if self.max_bytes else backlog
        taken = 0
        for path, share in sorted(given.items(), key=lambda t: (-t[1], t[0])):
            generation, start = begun[path]
            end = last_line_end(path, start, start + share)
            if end == start and not (self.max_bytes and taken >= self.max_bytes):
                end = next_line_end(path, start) or start
            if end > start:
                taken += end - start
                length = min(HEAD, end)
                after[path] = [generation, end, digest(path, length), length]
        return {"files": json.dumps(after, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.position = after
        parts = []
        for path, (generation, stop, *_) in sorted(after.items()):
            begin = before[path][1] if path in before and before[path][0] == generation else 0
            for at in range(begin, stop, RANGE):
                parts.append(FilePart(path, generation, at, min(stop, at + RANGE)))
        return parts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for begin, after, raw in lines_between(partition.path, partition.start, partition.end):
            line = raw.rstrip(b"\r\n").decode("utf-8", "replace")
            if line:
                yield partition.path, partition.generation, begin, after, line


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        most = self.options.get("max_bytes")
        return TailReader(self.options["folder"], self.options.get("suffix", ".jsonl"), int(most) if most else None)


def tail_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", max_bytes: int | None = None) -> DataFrame:
    """A stream of the complete lines of all files below a folder, each once, as files grow and are written anew.

    max_bytes: about what one batch takes; by default all there is. A query with the trigger availableNow runs one batch.
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("line_tail").option("folder", folder).option("suffix", suffix)
    return (reader.option("max_bytes", str(max_bytes)) if max_bytes else reader).load()

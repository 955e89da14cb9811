"""Lines of files that are cut into ranges, compared with reading them whole."""

import random

import pytest

from spanforge.sources.lines import WHOLE_BYTES, json_lines, numbered_lines


def whole(path, complete):
    raw = path.read_bytes()
    out, at = [], 0
    for no, part in enumerate(raw.split(b"\n")):
        ended = at + len(part) < len(raw)
        at += len(part) + 1
        if part.rstrip(b"\r") and (ended or not complete):
            out.append((str(path), no, part.rstrip(b"\r").decode(), at))
    return out


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "200")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("complete", [False, True])
def test_ranges(spark, tmp_path, small_ranges, complete):
    rng = random.Random(5)
    files = []
    for k in range(4):
        path = tmp_path / f"d {k}" / f"log+{k}.jsonl"
        path.parent.mkdir()
        lines = ["é" * rng.choice([0, 0, 1, 5, 30, 700]) + rng.choice(["", "\r"]) for _ in range(rng.choice([1, 60, 200]))]
        path.write_bytes(("\n".join(lines) + rng.choice(["", "\n", "tail"])).encode())
        files.append(path)
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("no")
    got = json_lines(spark, str(tmp_path), complete=complete)
    assert sorted(map(tuple, got.collect())) == sorted(r for p in files for r in whole(p, complete))


def test_plan(spark, tmp_path, small_ranges):
    (tmp_path / "a.jsonl").write_text("\n".join(f'{{"n": {k}}}' for k in range(3000)))
    got = json_lines(spark, str(tmp_path))
    assert got.select("path", "line").rdd.getNumPartitions() > 1
    numbered = got.select("line_no", "line")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1  # over ranges; the one over lines went with end_offset
    assert [r["line"] for r in numbered.orderBy("line_no").collect()] == [f'{{"n": {k}}}' for k in range(3000)]


def test_small_files_are_numbered_without_a_second_reading(spark, tmp_path):
    """Many small logs once were read twice, and their lines joined with counts of lines, to be numbered."""
    small, large = tmp_path / "a+b c.jsonl", tmp_path / "d" / "large.jsonl"
    large.parent.mkdir()
    small.write_bytes("\ré\r\n\n\r\nx\r\r\n\nlast".encode())
    large.write_text("".join(f"{k:0100d}\n" * (k % 3 > 0) + "\n" for k in range(2 * WHOLE_BYTES // 100)))
    (tmp_path / "empty.jsonl").write_text("")
    got = numbered_lines(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(r[:3] for p in (small, large) for r in whole(p, False))
    large.unlink()
    left = numbered_lines(spark, str(tmp_path))
    assert sorted(map(tuple, left.collect())) == sorted(r[:3] for r in whole(small, False))
    assert numbered_lines(spark, []).count() == 0


@pytest.mark.parametrize("source", ["claude", "codex", "pi"])
def test_records_written_once_shuffle_no_lines(spark, tmp_path, source, monkeypatch):
    """What is kept of logs that are read once was shuffled whole before, for offsets that nobody asked for."""
    from importlib import import_module

    module, kept = import_module(f"spanforge.sources.{source}"), []
    (tmp_path / "a.jsonl").write_text('{"type": "user", "timestamp": "2024-01-01T00:00:00Z"}\n')
    monkeypatch.setattr(module, "checkpointed", lambda df: kept.append(df) or df)
    module.read(spark, str(tmp_path), once=True)
    assert "end_offset" not in kept[0].columns
    if source != "pi":  # its branches are walked by session
        plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") <= 1  # that of large files

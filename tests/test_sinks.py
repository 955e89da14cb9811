"""Traces written to files: every row once, whatever runs twice."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import Row, StringType, StructType

from spanforge.sinks.traces import DATA, BatchWriter, StreamWriter, TraceFiles, manifests, read_traces, write_traces

SCHEMA = StructType().add("session_key", StringType()).add("json", StringType())


def rows_of(spark, folder):
    return sorted(r["json"] for r in read_traces(spark, folder).collect())


def test_batches_append_and_overwrite(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.range(100).select(F.col("id").cast("string").alias("session_key"), F.to_json(F.struct("id", F.lit("é <").alias("t"))).alias("json")).repartition(4)
    write_traces(df, folder)
    assert rows_of(spark, folder) == sorted(r["json"] for r in df.collect())
    write_traces(df.limit(3), folder)
    assert len(rows_of(spark, folder)) == 103
    write_traces(df.limit(7), folder, overwrite=True)
    assert len(rows_of(spark, folder)) == 7 and len(manifests(folder)) == 1
    assert read_traces(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="json"):
        write_traces(df.drop("json"), folder)


def test_a_task_that_runs_twice(spark, tmp_path):
    folder = str(tmp_path)
    writer = BatchWriter(SCHEMA, folder, False)
    first = writer.write(iter([Row("a", '{"n":1}'), Row("b", None)]))
    again = writer.write(iter([Row("a", '{"n":1}')]))
    other = writer.write(iter([Row("c", '{"n":2}')]))
    assert rows_of(spark, folder) == []  # nothing counts before the commit
    writer.commit([again, other])  # of a task's attempts one is told to the job
    assert rows_of(spark, folder) == ['{"n":1}', '{"n":2}'] and first.rows == 1
    failed = BatchWriter(SCHEMA, folder, False)
    lost = failed.write(iter([Row("d", "{}")]))
    failed.abort([lost, None])
    assert len(rows_of(spark, folder)) == 2 and lost.name not in os.listdir(f"{folder}/{DATA}")


def test_a_batch_that_runs_twice(spark, tmp_path):
    writer = StreamWriter(SCHEMA, str(tmp_path), "q")
    for _ in range(2):
        writer.commit([writer.write(iter([Row("a", '{"n":1}')])), writer.write(iter([]))], 0)
    writer.commit([writer.write(iter([Row("a", '{"n":2}')]))], 1)
    assert rows_of(spark, str(tmp_path)) == ['{"n":1}', '{"n":2}'] and len(os.listdir(tmp_path / DATA)) == 2


def test_stream(spark, tmp_path):
    spark.dataSource.register(TraceFiles)
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"n": k}) + "\n")
        stream = spark.readStream.schema("n long").json(str(source)).select(F.to_json(F.struct("n")).alias("json"))
        query = stream.writeStream.format("trace_files").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(60) and query.exception() is None
    assert rows_of(spark, out) == ['{"n":0}', '{"n":1}', '{"n":2}'] and len(manifests(out)) == 3

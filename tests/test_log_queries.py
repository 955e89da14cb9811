"""Queries over written logs, compared with their SQL where tasks are dealt otherwise than in a small local session."""

import os
import pickle

import pytest

from spanforge.plans import catalog
from spanforge.sources.sqlite import FILES, TASKS, SqliteReader, read_table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["codex_logs", "pi_logs"])
def test_one_log_for_each_user_however_partitions_are_joined(spark, name):
    """Partitions that are joined by their size once made a second log, with the head alone, for every user."""
    import duckdb

    given = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        got = catalog.queries()[name](spark, SMALL)
        columns = got.columns
        rows = sorted(map(repr, (tuple(r) for r in got.collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SMALL}/events.parquet')")
    assert rows == sorted(map(repr, db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()))


def test_many_stores_share_tasks(spark, tmp_path):
    """A task for each of many small stores costs more than reading them; a task is given the paths of its own files only."""
    import json
    import sqlite3

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType())])
    many = [f"/none/{k}.db" for k in range(100 * TASKS)]
    reader = SqliteReader(schema, {"paths": json.dumps(many), "table": "t"})
    parts = reader.partitions()
    assert len(parts) <= TASKS and max(len(p.paths) for p in parts) <= FILES and [x for p in parts for x in p.paths] == many
    assert len(pickle.dumps(reader)) < 2000
    assert len(SqliteReader(schema, {"paths": json.dumps(many[:TASKS]), "table": "t"}).partitions()) == TASKS
    paths = [str(tmp_path / f"{k}.db") for k in range(2 * TASKS + 1)]
    for k, p in enumerate(paths):
        with sqlite3.connect(p) as db:
            db.executescript(f"CREATE TABLE t (id INTEGER); INSERT INTO t VALUES ({k}), ({k + 1000})")
        db.close()
    os.remove(paths[5])
    rows = read_table(spark, paths, "t", "id long")
    assert rows.rdd.getNumPartitions() <= TASKS
    assert sorted((r["db_path"], r["id"]) for r in rows.collect()) == sorted((p, k + d) for k, p in enumerate(paths) if k != 5 for d in (0, 1000))

"""Queries over whole pages and tables, row by row against their SQL."""

import os

import pytest

from spanforge.plans import catalog

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@pytest.mark.parametrize("name, tables", [("extract_paths", "pages"), ("session_order", "orders"), ("mark_ride", "events")])
def test_whole(spark, name, tables):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW {tables} AS SELECT * FROM read_parquet('{SMALL}/{tables}.parquet')")
    got = catalog.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()))
    n = db.execute(f"SELECT count(*) FROM {tables}" + (" WHERE event_type = 'error'" if tables == "events" else "")).fetchone()[0]
    assert len(rows) == n > 0


def test_paths_late_in_a_page(spark, tmp_path):
    page = [(1, "u", "x " * 4000 + "late/in/page.go ")]
    spark.createDataFrame(page, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()["extract_paths"](spark, str(tmp_path)).first()
    assert "late/in/page.go" in got["paths"].split("\n")

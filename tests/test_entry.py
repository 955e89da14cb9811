"""The driver's contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from spanforge.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", ["trace_spans", "pair_latest", "mark_seq", "session_order", "output_failed", "target_merge", "agent_depths", "content_to_string"])
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("conversations", "events", "orders", "lineitem", "customer", "pages", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = catalog.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_without_llm(tmp_path):
    target = tmp_path / "repo"
    shutil.copytree(REPO, target, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert 'trace_spans' in e.queries() and not any(n.startswith('op') for n in e.queries() if n != 'output_failed'); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=target, env=os.environ | {"PYTHONPATH": str(target)}, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr

"""The registered queries: complete, joined without products, and equal to their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from workload.check import _rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["bm25_topk", "keyword_search", "dense_topk", "basic_retrieve", "rrf_fusion", "hybrid_search", "routed_retrieve", "simple_paths",
          "ego_edges", "graph_validate", "gap_batch", "context_block", "full_session", "upload_ingest", "graph_load"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_query_has_its_sql():
    own = {name for module in entry._MODULES for name in module.QUERIES}
    assert own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_result_equals_sql_and_plan_has_no_product(spark, name):
    frame = entry.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    db = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, [tuple(r) for r in frame.collect()])[0] == _rows(columns, cursor.fetchall())[0]


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

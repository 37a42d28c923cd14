"""Registered queries against DuckDB on the smallest data, and their plans."""

import os

import duckdb
import pytest

from cohort_ledger.plans import registry
from cohort_ledger.plans.dataset import Model

registry.load()
FOLDER = os.environ.get("COHORT_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
SAMPLE = [
    "active_assays", "status_by_analysis", "pair_by_assay_type", "completion_matrix", "append_results",
    "upsert_level", "replay_qc_log", "all_stale_outputs", "derived_reasons", "constraints", "sv_summary",
    "pair_by_timepoint", "pair_by_many_partitions", "autoflag_by_value", "dry_run_counts", "register_cohort", "validate_sheet",
    "find_cycles", "output_staleness", "read_event_log", "stream_flags", "export_everything", "sql_graph_views", "merge_outer",
]
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


def plain(value):
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(registry.PLANS) == set(registry.SQL)


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = registry.run(name, spark, FOLDER)
    result = con.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    assert sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect()) == want


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    frame = registry.PLANS["active_patients"](Model(spark, FOLDER))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

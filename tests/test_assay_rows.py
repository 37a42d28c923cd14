"""The mapped levels: how the assays are dealt, and what a plan that needs no status reads."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohort_ledger.operators.qc import recompute_status
from cohort_ledger.plans import dataset, registry
from cohort_ledger.plans.dataset import Model

FOLDER = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_assays_are_dealt_by_rows_and_specimen(spark, monkeypatch):
    monkeypatch.setattr(dataset, "ROWS_PER_PART", 500)
    model = Model(spark, FOLDER)
    parts = -(-model.raw("lineitem").count() // 500)
    plan = _plan(model.assay_rows.groupBy("specimen_id").count())
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+, (\d+)\)", plan) == [("specimen_id", str(parts))]
    assert parts > 10


def test_no_line_items(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert Model(spark, str(tmp_path)).assay_rows.count() == 0


@pytest.mark.parametrize("name", ["constraints", "constraints_schema", "lineage_orphans"])
def test_levels_without_status_read_no_events(spark, name):
    registry.load()
    found = registry.PLANS[name](Model(spark, FOLDER))
    assert not [f for f in found.inputFiles() if "events.parquet" in f]


def test_link_sources_looks_up_targets_once(spark, monkeypatch):
    from cohort_ledger.operators import artifacts as art

    written = []
    monkeypatch.setattr(art, "cut", lambda rows: written.append(rows) or rows)
    assays = spark.createDataFrame([("a",), ("b",), ("b",)], "assay_id string")
    specimens = spark.createDataFrame([("s",), ("a",)], "specimen_id string")
    rows = [
        ("a", "b", None), ("a", "b", None), ("a", None, "s"), ("b", None, "b"), ("a", "s", None),
        ("x", "b", None), ("x", "y", None), ("a", "a", None), ("a", None, None), (None, "b", None), ("a", "b", "s"),
    ]
    kind = "source_assay_id string, merged_assay_id string, consumer_specimen_id string"
    out = art.link_sources(spark.createDataFrame([("a", None, "s")], kind), spark.createDataFrame(rows, kind), assays, specimens)
    assert len(written) == 1
    assert [tuple(r) for r in out["added"].collect()] == [("a", "b", None)]
    assert out["n_valid"].first()[0] == 3
    assert sorted(r.reject for r in out["rejects"].collect()) == sorted(
        ["unknown_specimen", "unknown_merged_assay", "unknown_source", "unknown_source", "self_edge", "no_target", "source_missing", "two_targets"]
    )


def _own_tables(spark, folder):
    """Line items with repeats and missing keys, and events on the first assay of their specimen."""
    lines = [
        (2, 5, 7, 1, "A", "F", 30.0), (2, 5, 7, 1, "N", "O", 4.0), (2, None, 7, 2, "A", "F", 3.0), (2, 2, 7, None, "R", "F", 9.0),
        (5, None, 7, 2, "A", "F", 30.0), (5, 2, 7, None, "R", "F", 9.0), (20, 1, 1, 1, None, None, None), (None, 1, 1, 1, "A", "F", 1.0),
        (None, 20, 1, 1, "A", "F", 1.0), (None, 2, 7, 5, "A", "F", 1.0), (None, None, None, None, "A", "O", 2.0),
    ]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double"
    rows = spark.createDataFrame(lines, kind).withColumn("l_shipdate", F.lit("2024-01-01").cast("date"))
    rows.write.parquet(f"{folder}/lineitem.parquet")
    events = [(2, "click", 1), (20, "error", 1), (20, "view", 1), (5, "purchase", 1), (5, "view", 2), (8, "view", 3), (50, "view", 3)]
    made = spark.createDataFrame(events, "event_id long, event_type string, user_id long").withColumn("ts", F.lit(None).cast("timestamp"))
    made.write.parquet(f"{folder}/events.parquet")


def test_status_goes_to_the_assays_where_they_are(spark, tmp_path):
    """The status found by narrow rows is that of a join by assay, and whole rows are not dealt out by assay."""
    _own_tables(spark, tmp_path)
    model = Model(spark, str(tmp_path))
    joined = recompute_status(model.assay_rows, model.qc_events, "assay")
    assert model.assays.columns == joined.columns and model.assays.schema.names == joined.schema.names
    found = sorted(map(str, model.assays.collect()))
    assert found == sorted(map(str, joined.collect()))
    # The status of one id goes to all assays of that id, also to one without a specimen.
    assert [r.qc_status for r in model.assays.collect() if r.assay_id == "5-2-7"] == ["warn"] * 3
    assert {r.qc_status for r in model.assays.collect()} == {"pass", "warn", "fail"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(model.assays)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(specimen_id" in plan and "hashpartitioning(assay_id" not in plan


def test_unread_status_costs_no_join(spark):
    rows = spark.createDataFrame([("p",), ("p",), (None,)], "patient_id string")
    events = spark.createDataFrame([("patient", "p", "qc_fail", None), ("assay", "p", "qc_warn", None)], "level string, entity_id string, kind string, resolved_at timestamp")
    found = recompute_status(rows, events, "patient")
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [("p", "fail"), ("p", "fail"), (None, "pass")]))
    assert "Join" not in _plan(found.select("patient_id")) and "Join" in _plan(found)


INPUT_QUERIES = ["derivation_view", "direct_staleness", "direct_causes", "derived_staleness", "input_staleness", "censored_inputs", "list_artifacts"]


@pytest.mark.parametrize("name", INPUT_QUERIES)
def test_only_inputs_are_judged(spark, monkeypatch, name):
    registry.load()

    def refused(self):
        raise AssertionError("all assays are dealt out")

    monkeypatch.setattr(Model, "assay_rows", property(refused))
    _equals_sql(spark, name)


def test_validation_reads_written_levels(spark):
    registry.load()
    found = registry.PLANS["validate_all"](Model(spark, FOLDER))
    assert not [f for f in found.inputFiles() if re.search("(events|lineitem|orders|customer).parquet", f)]
    _equals_sql(spark, "validate_all")


def _equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    frame = registry.run(name, spark, FOLDER)
    result = con.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(tuple(map(str, r)) for r in frame.select(*columns).collect()) == sorted(tuple(map(str, r)) for r in result.fetchall())

"""The levels laid out by place: the same rows, and no exchange in the plan."""

import pytest
from pyspark.sql import functions as F

from cohort_ledger.operators import views
from cohort_ledger.sinks import colocated


@pytest.fixture()
def levels(spark):
    patients = spark.createDataFrame([(f"P{i}", "c", "pass") for i in range(6)], "patient_id string, cohort string, qc_status string")
    specimens = spark.createDataFrame(
        [(f"S{i}", "P0" if i % 2 else f"P{i % 7}", "fail") for i in range(60)] + [("S_none", None, "pass")], "specimen_id string, patient_id string, qc_status string"
    )
    assays = spark.createDataFrame([(f"A{i}", f"S{i % 70}", "pass") for i in range(300)] + [("A_none", None, "pass")], "assay_id string, specimen_id string, qc_status string")
    return patients, specimens, assays


def test_joins_meet_in_place(spark, rows, levels, tmp_path):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "true"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        colocated.write_colocated(*levels, str(tmp_path / "levels"), "coloc", buckets=4, per_place=20)
        placed = colocated.read_colocated(spark, "coloc")
        got = colocated.joined_colocated(placed)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = views.joined(*levels)
        assert rows(got, *want.columns) == rows(want)
        # The patient with half of all assays is in several places, none of which is much above the bound.
        sizes = placed["assay"].join(placed["specimen"].select("specimen_id", "patient_id"), "specimen_id").filter("patient_id = 'P0'").groupBy("place").count()
        assert sizes.count() >= 4 and sizes.agg(F.max("count")).first()[0] <= 60
        assert rows(colocated.patients_of(placed)) == rows(levels[0])
        assert placed["specimen"].count() == 61 and placed["assay"].count() == 301
    finally:
        for level in ("patient", "specimen", "assay"):
            spark.sql(f"DROP TABLE IF EXISTS coloc_{level}")
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_assays_may_be_counted_by_other_rows(spark, rows, levels, tmp_path):
    """Places follow the rows that are counted, so the assays are not worked out to be counted."""
    refused = F.raise_error(F.lit("the assays were worked out to be counted")).cast("string")
    counted = levels[2].select("specimen_id")
    broken = levels[2].select("assay_id", refused.alias("specimen_id"), "qc_status")
    try:
        with pytest.raises(Exception, match="worked out"):
            colocated.write_colocated(*levels[:2], broken, str(tmp_path / "broken"), "broken", buckets=2, per_place=20)
        with pytest.raises(Exception, match="worked out"):  # not before the places are there
            colocated.write_colocated(*levels[:2], broken, str(tmp_path / "broken"), "broken", buckets=2, per_place=20, counted=counted)
        assert spark.table("broken_specimen").count() == 61 and spark.table("broken_specimen").filter("patient_id = 'P0'").select("place").distinct().count() > 4
        colocated.write_colocated(*levels, str(tmp_path / "all"), "once", buckets=2, per_place=20, counted=counted)
        got = colocated.joined_colocated({lv: spark.table(f"once_{lv}") for lv in ("patient", "specimen", "assay")})
        want = views.joined(*levels)
        assert rows(got, *want.columns) == rows(want)
    finally:
        for level in ("patient", "specimen", "assay"):
            spark.sql(f"DROP TABLE IF EXISTS broken_{level}")
            spark.sql(f"DROP TABLE IF EXISTS once_{level}")

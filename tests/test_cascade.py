"""Derived status, the usability cascade and views on a small cohort."""

import pytest
from pyspark.sql import functions as F

from cohort_ledger.operators import active, qc, status, views

EVENT = "id string, level string, entity_id string, kind string, reason string, source string, " \
        "created_at timestamp, created_by string, resolved_at timestamp, resolved_by string, " \
        "resolved_reason string, transaction_id string"


def events(spark, *items):
    """(id, level, entity, kind, resolved) tuples as event rows."""
    rows = [
        (i, lv, e, k, "r", "manual", None, "me", None, None, None, "t", done) for i, lv, e, k, done in items
    ]
    frame = spark.createDataFrame(rows, EVENT + ", done boolean")
    stamp = F.when(F.col("done"), F.lit("2024-01-02").cast("timestamp"))
    return frame.withColumn("resolved_at", stamp).drop("done")


@pytest.fixture()
def cohort(spark):
    patients = spark.createDataFrame(
        [("P1", "consented", None), ("P2", "consented_limited_use", None), ("P3", "revoked", "2024-01-01"),
         ("P4", "pending", None)],
        "patient_id string, consent_status string, withdrawal_date string",
    ).withColumn("withdrawal_date", F.col("withdrawal_date").cast("date")).withColumn("qc_status", F.lit("pass"))
    specimens = spark.createDataFrame(
        [("S1", "P1", "tumor"), ("S2", "P1", "normal"), ("S3", "P2", "tumor"), ("S4", "P3", "tumor"), ("S5", "P4", "tumor")],
        "specimen_id string, patient_id string, tissue_site string",
    ).withColumn("qc_status", F.lit("pass"))
    assays = spark.createDataFrame(
        [("A1", "S1", "ONT", "x"), ("A2", "S2", "ONT", None), ("A3", "S3", "WGS", "x"), ("A4", "S4", "ONT", None),
         ("A5", "S5", "ONT", None), ("A6", "S1", "WGS", None)],
        "assay_id string, specimen_id string, assay_type string, align_done string",
    ).withColumn("qc_status", F.lit("pass"))
    return patients, specimens, assays


def test_most_severe_active_kind_wins(spark, rows):
    ev = events(
        spark,
        ("1", "assay", "A1", "qc_warn", False), ("2", "assay", "A1", "contamination", False),
        ("3", "assay", "A2", "qc_fail", True), ("4", "assay", "A2", "other", False),
        ("5", "specimen", "S1", "consent_revoked", False), ("6", "patient", "P1", "consent_revoked", False),
        ("7", "patient", "P1", "qc_fail", False), ("8", "assay", "A9", "never heard of", False),
    )
    assert rows(qc.derive_status(ev)) == [
        ("assay", "A1", "fail"), ("assay", "A2", "censored"), ("assay", "A9", "censored"),
        ("patient", "P1", "consent_revoked"), ("specimen", "S1", "censored"),
    ]


def test_recompute_falls_back_to_pass(spark, cohort, rows):
    ev = events(spark, ("1", "assay", "A1", "qc_fail", False), ("2", "assay", "A2", "qc_fail", True))
    out = qc.recompute_status(cohort[2].withColumn("qc_status", F.lit("fail")), ev, "assay")
    assert dict(rows(out, "assay_id", "qc_status")) == {
        "A1": "fail", "A2": "pass", "A3": "pass", "A4": "pass", "A5": "pass", "A6": "pass"
    }


def test_cascade_and_flags(cohort, rows):
    patients, specimens, assays = cohort
    specimens = specimens.withColumn("qc_status", F.when(F.col("specimen_id") == "S2", "fail").otherwise("pass"))
    assays = assays.withColumn("qc_status", F.when(F.col("assay_id") == "A6", "censored").otherwise("pass"))
    ids = lambda **f: [r[0] for r in rows(active.active_assays(patients, specimens, assays, **f), "assay_id")]
    assert ids() == ["A1", "A3"]
    assert ids(include_censored=True) == ["A1", "A2", "A3", "A6"]
    assert ids(include_consent_revoked=True) == ["A1", "A3", "A4", "A5"]
    reasons = rows(active.exclusion_reason(patients, specimens, assays))
    assert reasons == [("A2", "specimen_qc"), ("A4", "consent"), ("A5", "consent"), ("A6", "assay_qc")]
    breakdown = rows(active.exclusion_breakdown(patients, specimens, assays))
    assert ("censored_assay", "assay", "A6") in breakdown and ("consent_revoked_assay", "assay", "A4") in breakdown
    assert not [r for r in breakdown if r[2] == "A2"]


def test_null_status_is_not_active_but_counts_as_pass(cohort, rows):
    patients, specimens, assays = cohort
    assays = assays.withColumn("qc_status", F.when(F.col("assay_id") != "A1", F.col("qc_status")))
    assert "A1" not in [r[0] for r in rows(active.active_assays(patients, specimens, assays), "assay_id")]
    summary = {(s, i): v for s, i, v in rows(status.cohort_summary(patients, specimens, assays))}
    assert summary[("assays_by_qc", "pass")] == 6
    assert summary[("assays", "usable")] == 3 and summary[("assays", "excluded")] == 3  # A2, A3, A6


def test_joined_names_are_unique_and_active_is_a_subset(cohort, rows):
    frame = views.joined(*cohort)
    assert len(set(frame.columns)) == len(frame.columns)
    assert {"assay_qc_status", "specimen_qc_status", "patient_qc_status"} <= set(frame.columns)
    everything, usable = rows(frame, "assay_id"), rows(views.active(*cohort), "assay_id")
    assert set(usable) < set(everything) and len(everything) == 6


def test_rerun_covers_unknown_analysis(cohort, rows):
    assert rows(active.rerun_missing("align", "assay", *cohort)) == [("A2",), ("A6",)]
    assert len(rows(active.rerun_missing("align", "assay", *cohort, force_censored=True))) == 4
    assert len(rows(active.rerun_missing("never", "specimen", *cohort))) == 5


def test_empty_tables(cohort):
    empty = [f.limit(0) for f in cohort]
    assert active.active_assays(*empty).count() == 0
    assert status.status_by_analysis(*empty).first()["pct"] == 0.0
    assert status.cohort_summary(*empty).count() >= 1


def test_pair_by_paired_cohort(cohort, rows):
    patients, specimens, assays = cohort
    fine = status.pair_by(patients, specimens, assays, "tissue_site", partition_order=["tumor", "normal"], partitions=["normal", "tumor"])
    assert dict(rows(fine, "patient_id", "status")) == {
        "P1": "complete", "P2": "singleton", "P3": "singleton", "P4": "singleton"
    }
    assert fine.columns[1:3] == ["tumor", "normal"]
    broken = assays.withColumn("qc_status", F.when(F.col("assay_id") == "A2", "fail").otherwise("pass"))
    typed = status.pair_by(patients, specimens, broken, "tissue_site", assay_type="ONT", partitions=["normal", "tumor"])
    by_patient = {r.patient_id: r for r in typed.collect()}
    assert by_patient["P1"].status == "broken" and by_patient["P1"].normal == "FAIL"
    assert by_patient["P2"].tumor == "(none)" and by_patient["P3"].tumor == "CONSENT_REVOKED"
    assert status.pair_by_require(typed, 1).first().require_satisfied == 1


def test_pair_by_longitudinal(spark):
    specimens = spark.createDataFrame(
        [("1", "H1", "baseline"), ("2", "H1", "post"), ("3", "H1", "progression"), ("4", "H2", "baseline"),
         ("5", "H2", "post"), ("6", "H3", "baseline"), ("7", "H3", None), ("8", "H3", "")],
        "specimen_id string, patient_id string, timepoint string",
    ).withColumn("qc_status", F.lit(None).cast("string"))
    table = status.pair_by(None, specimens, None, "timepoint")
    assert status.pair_by_summary(table).first().asDict() == {
        "complete": 1, "broken": 0, "incomplete": 1, "singleton": 1
    }
    assert status.pair_by_require(table, 2).first().require_satisfied == 2
    assert status.pair_by_filter(table, "incomplete").first().patient_id == "H2"


def test_highest_specimen_wins_in_a_partition(spark):
    specimens = spark.createDataFrame(
        [("1", "H1", "tumor", "pass"), ("2", "H1", "tumor", "fail")],
        "specimen_id string, patient_id string, site string, qc_status string",
    )
    assert status.pair_by(None, specimens, None, "site").first().labels == {"tumor": "FAIL"}


def test_pair_by_has_no_bound_on_partitions(spark):
    specimens = spark.range(12).selectExpr("CAST(id AS string) AS specimen_id", "id % 2 AS patient_id", "CAST(id AS string) AS part", "'pass' AS qc_status")
    bound = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        got = status.pair_by(None, specimens, None, "part", partition_order=["9"]).collect()
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", bound)
    assert {r.patient_id: (r.present[:2], r.n_missing, r.passing, r.status) for r in got} == {0: (["0", "10"], 6, 6, "incomplete"), 1: (["9", "1"], 6, 6, "incomplete")}


def test_matrix_and_next_up(cohort, rows):
    patients, specimens, assays = cohort
    specimens = specimens.withColumn("merge_done", F.when(F.col("specimen_id") == "S1", "x"))
    assays = assays.withColumn("qc_status", F.when(F.col("assay_id") == "A2", "fail").otherwise("pass"))
    cells = {(r[0], r[1]): r[2] for r in rows(status.completion_matrix(specimens, "specimen", assays.filter("assay_id <> 'A5'")))}
    assert cells[("S1", "merge")] == "done" and cells[("S1", "align")] == "pending"
    assert cells[("S2", "align")] == "failed" and cells[("S3", "align")] == "done" and cells[("S5", "align")] == "na"
    frame = assays.withColumn("basecall_done", F.lit("x"))
    up = {r["analysis"]: r for r in status.next_up(frame, "assay", limit=2).collect()}
    assert up["align"]["count"] == 4 and up["align"]["ids"] == ["A2", "A4"] and up["align"]["more"] == 2
    assert "basecall" not in up
    assert status.row_level_choice({"patient": patients, "specimen": specimens, "assay": assays}) == "specimen"


def test_status_lists(cohort, rows):
    by_row = {r.assay_id: r for r in status.status_by_row(cohort[2], "assay").collect()}
    assert by_row["A1"].analyses_done == ["align"] and by_row["A2"].n_done == 0 and by_row["A2"].n_total == 1
    assert rows(status.status_by_patient(*cohort))[0] == ("P1", 2, 3, 1)
    assert status.overall_pct(cohort[2]).first().pct == pytest.approx(100 * 2 / 6)


def test_drill_has_one_row_per_record(spark, cohort):
    ev = events(spark, ("1", "assay", "A1", "qc_warn", False), ("2", "patient", "P9", "qc_warn", False))
    drill = views.patient_drill(*cohort, ev)
    assert {r["record"]: r["count"] for r in drill.groupBy("record").count().collect()} == {
        "patient": 4, "specimen": 5, "assay": 6, "event": 1
    }


def test_results_do_not_depend_on_partitions(spark, cohort, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append((rows(views.active(*cohort)), rows(status.status_by_patient(*cohort))))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

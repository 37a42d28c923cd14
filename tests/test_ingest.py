"""Merges, upserts, sheets and flat-table splitting."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cohort_ledger.model import DEFAULT_SCHEMA, ColumnSpec
from cohort_ledger.operators import ingest, qc, views
from cohort_ledger.plans.dataset import Model  # noqa: F401  (import check)


@pytest.fixture()
def manifest(spark):
    return spark.createDataFrame(
        [("s1", 0.5), ("s2", None), ("s3", None)], "sample_id string, meth double"
    )


def test_fill_only(spark, manifest, rows):
    results = spark.createDataFrame(
        [(1, "s1", 0.9), (2, "s2", 0.7), (3, "s2", 0.8), (4, "s9", 0.1)], "n int, sample_id string, meth double"
    )
    out = ingest.fill_only(manifest, results, "sample_id", ["meth"], order_col="n")
    assert rows(out) == [("s1", 0.5), ("s2", 0.7), ("s3", None)]
    again = ingest.fill_only(out, results, "sample_id", ["meth"], order_col="n")
    assert rows(again) == rows(out)


def test_fill_only_compares_keys_as_text(spark, rows):
    left = spark.createDataFrame([("1", None)], "sample_id string, n long")
    right = spark.createDataFrame([(1, 7)], "sample_id long, n long")
    assert rows(ingest.fill_only(left, right, "sample_id")) == [("1", 7)]


def test_append_flat_modes(spark, manifest, rows):
    results = spark.createDataFrame([("s1", 0.9, 3), ("s9", 0.1, 4)], "sample_id string, meth double, depth int")
    plain = ingest.append_flat(manifest, results, "sample_id", "mod", "2024-01-01")
    assert rows(plain) == [("s1", 0.5, 3, "2024-01-01"), ("s2", None, None, None), ("s3", None, None, None)]
    over = ingest.append_flat(manifest, results, "sample_id", "mod", "2024-01-01", overwrite=True)
    assert rows(over, "sample_id", "meth")[0] == ("s1", 0.9)
    new = ingest.append_flat(manifest, results, "sample_id", "mod", "2024-01-01", allow_new=True)
    assert ("s9", 0.1, 4, "2024-01-01") in rows(new)
    only_old = ingest.append_flat(manifest, results.select("sample_id", "meth"), "sample_id", "meth", "d", allow_new=True)
    assert "s9" in [r[0] for r in rows(only_old)]
    assert len(rows(views.merge_outer(manifest, results.select("sample_id", "depth"), "sample_id"))) == 4


def test_append_results_duplicates(spark, rows):
    base = spark.createDataFrame([("A1", None, 1), ("A2", 5, 1)], "assay_id string, x int, y int")
    results = spark.createDataFrame(
        [(1, "A1", None, 8), (2, "A1", 3, None), (3, "A2", 9, 9)], "n int, assay_id string, x int, y int"
    )
    fill = ingest.append_results(base, results, "assay", "q", "d", order_col="n")
    assert rows(fill, "assay_id", "x", "y") == [("A1", 3, 1), ("A2", 5, 1)]
    over = ingest.append_results(base, results, "assay", "q", "d", overwrite=True, order_col="n")
    assert rows(over, "assay_id", "x", "y") == [("A1", 3, None), ("A2", 9, 9)]


def test_autoflag_tokens(spark, rows):
    results = spark.createDataFrame(
        [("A1", "False", " low reads ", None), ("A2", "true", None, "YES"), ("A3", None, None, "within 3pp"),
         ("A4", " no", None, "true"), ("A5", "maybe", None, "0")],
        "assay_id string, qc_pass string, qc_fail_reason string, qc_warn string",
    )
    flags = qc.autoflag_extract(results, "assay_id")
    assert rows(flags) == [
        ("A1", "fail", "low reads"), ("A2", "warn", "slurm: qc_warn=True"), ("A4", "fail", "slurm: qc_pass=False")
    ]
    typed = results.select("assay_id", (F.col("assay_id") != "A1").alias("qc_pass"))
    assert rows(qc.autoflag_extract(typed, "assay_id")) == [("A1", "fail", "slurm: qc_pass=False")]
    assert rows(qc.autoflag_extract(results.select("assay_id"), "assay_id")) == []


@pytest.fixture()
def levels(spark):
    patients = spark.createDataFrame(
        [("P1", "c", None, "pass", "consented")],
        "patient_id string, cohort string, site string, qc_status string, consent_status string",
    )
    specimens = spark.createDataFrame(
        [("S1", "P1", None, None, "pass")],
        "specimen_id string, patient_id string, tissue_site string, timepoint string, qc_status string",
    )
    assays = spark.createDataFrame(
        [("A1", "S1", None, None, "pass")],
        "assay_id string, specimen_id string, assay_type string, batch_id string, qc_status string",
    )
    return {"patient": patients, "specimen": specimens, "assay": assays}


def test_upsert_level(spark, levels, rows):
    frame = spark.createDataFrame(
        [("S1", "P1", "tumor"), ("s1", "P1", "x"), ("S2", "P1", "normal"), ("S3", "P9", "normal"), ("bad id", "P1", "x"),
         ("S4", "P1", "a"), ("S4", "P1", "b")],
        "specimen_id string, patient_id string, tissue_site string",
    )
    out = ingest.upsert_level(levels["specimen"], frame, "specimen", levels["patient"], allow_new=True)
    assert rows(out["rows"], "specimen_id", "tissue_site") == [("S1", "tumor"), ("S2", "normal")]
    assert rows(out["rejects"]) == [
        ("S3", "missing_parent"), ("S4", "duplicate_key"), ("bad id", "id_format"), ("s1", "case_variant")
    ]
    assert rows(out["rows"].filter("specimen_id = 'S2'"), "qc_status") == [("pass",)]
    strict = ingest.upsert_level(levels["specimen"], frame, "specimen")
    assert len(rows(strict["rejects"])) == 5
    with pytest.raises(ValueError, match="not declared"):
        ingest.upsert_level(levels["specimen"], frame.withColumn("odd", F.lit(1)), "specimen")


def test_register_rows_with_stub_parent(spark, levels, rows):
    new = spark.createDataFrame([("S7", "P7"), ("S1", "P1")], "specimen_id string, patient_id string")
    out = ingest.register_rows(levels["specimen"], new, "specimen", levels["patient"], allow_new_parent=True)
    assert rows(out["stubs"]) == [("P7",)] and rows(out["rejects"]) == [("S1", "already_exists")]
    assert rows(out["inserted"], "specimen_id") == [("S7",)]
    plain = ingest.register_rows(levels["specimen"], new, "specimen", levels["patient"])
    assert ("S7", "missing_parent") in rows(plain["rejects"])
    with pytest.raises(ValueError, match="reserved"):
        ingest.register_rows(levels["specimen"], new.withColumn("qc_status", F.lit("fail")), "specimen")


SHEET = "patient_id string, cohort string, specimen_id string, tissue_site string, assay_id string, assay_type string"


def test_register_cohort(spark, levels, rows):
    sheet = spark.createDataFrame(
        [("P1", "c", "S1", "tumor", "A1", "ONT"), ("P2", "d", "S2", "tumor", "A2", "ONT"), ("P2", "d", "S2", "tumor", "A3", "WGS")],
        SHEET,
    )
    out = ingest.register_cohort(sheet, levels)
    assert rows(out["issues"]) == [] and rows(out["rejects"]) == []
    assert rows(out["assay"], "assay_id", "assay_type") == [("A1", "ONT"), ("A2", "ONT"), ("A3", "WGS")]
    again = ingest.register_cohort(sheet, {lv: out[lv] for lv in levels})
    for lv in levels:
        assert rows(again[lv]) == rows(out[lv])
    counts = {r["level"]: (r.n_new, r.n_existing) for r in ingest.dry_run_counts(ingest.explode_sheet(sheet), levels).collect()}
    assert counts == {"patient": (1, 1), "specimen": (1, 1), "assay": (2, 1)}


def test_register_cohort_reads_its_sheet_once(spark, levels, rows, monkeypatch):
    """The sheet is written first and read from there; the finest frame is not written."""
    written = []
    monkeypatch.setattr(ingest, "cut", lambda frame: written.append(frame.columns) or frame)
    sheet = spark.createDataFrame([("P1", "c", "S1", "tumor", "A1", "ONT"), ("P2", "d", "S2", "tumor", "A2", "ONT")], SHEET)
    out = ingest.register_cohort(sheet, levels)
    assert rows(out["assay"], "assay_id", "assay_type") == [("A1", "ONT"), ("A2", "ONT")]
    assert written[0] == sheet.columns and written.count(sheet.columns) == 1
    assert sum("assay_id" in names for names in written) == 2  # the sheet, and the new rows alone


def test_exploded_rows_are_upserted_like_others(spark, levels, rows):
    frame = spark.createDataFrame(
        [("S1", "P1", "x"), ("S2", "P1", "new"), ("s1", "P1", "variant"), ("S 3", "P1", "bad"), ("S4", "P_none", "lost"), ("S5", None, "lost"), (None, "P1", "no key")],
        "specimen_id string, patient_id string, tissue_site string",
    )
    for parents in (None, levels["patient"]):
        for overwrite in (False, True):
            plain, quick = (
                ingest.upsert_level(levels["specimen"], frame, "specimen", parents, True, overwrite, exploded=e) for e in (False, True)
            )
            for part in ("rows", "rejects", "inserted", "updated"):
                assert rows(quick[part]) == rows(plain[part])
            assert len(rows(quick["rejects"])) >= 2
    known = frame.filter("specimen_id = 'S1'")
    quick = ingest.upsert_level(levels["specimen"], known, "specimen", levels["patient"], True, True, exploded=True)
    assert rows(quick["rejects"]) == rows(quick["inserted"]) == [] and rows(quick["rows"], "specimen_id", "tissue_site") == [("S1", "x")]


def test_validate_sheet(spark, rows):
    sheet = spark.createDataFrame(
        [("P1", "c", "S1", "tumor", "A1", "ONT"), ("P2", "d", "S1", "tumor", "A2", "ONT"), ("P2", None, "S2", "x", "A3", "WGS"),
         ("P2", "d", "S3", "x", " ", "WGS"), ("P3", "e", "S4", "x", "A9", "WGS"), ("P3", "e", "S4", "x", "A9", "ONT")],
        SHEET,
    )
    assert rows(ingest.validate_sheet(sheet), "check", "key") == [
        ("assay_conflict", "A9"), ("blank_cell", " "), ("patient_conflict", "P2"), ("specimen_conflict", "S1"),
        ("specimen_with_several_parents", "S1"),
    ]
    with pytest.raises(ValueError, match="missing"):
        ingest.validate_sheet(sheet.drop("assay_id"))
    with pytest.raises(ValueError, match="not declared"):
        ingest.route_columns(sheet.columns + ["mystery"])
    lv = DEFAULT_SCHEMA.levels
    both = replace(DEFAULT_SCHEMA, levels=(lv[0], replace(lv[1], columns=lv[1].columns + (ColumnSpec("cohort"),)), lv[2]))
    with pytest.raises(ValueError, match="declared at"):
        ingest.route_columns(sheet.columns, both)


@pytest.fixture()
def flat(spark):
    return spark.createDataFrame(
        [("P1", "S1", "A1", 60, "F", "tumor", 30.5, "WGS"), ("P1", "S2", "A2", 60, "F", "normal", None, "ONT"),
         ("P2", "S3", "A3", None, "M", "tumor", 12.0, "WGS"), ("P2", "S3", "A4", 41, "M", "tumor", 13.0, "ONT")],
        "patient_id string, specimen_id string, assay_id string, age int, sex string, tissue_site string, "
        "coverage double, assay_type string",
    )


def test_classify_and_normalize(flat, rows):
    classes = {r["column"]: r["level"] for r in ingest.classify_columns(flat, overrides={"sex": "assay"}).collect()}
    assert classes == {"age": "patient", "sex": "assay", "tissue_site": "specimen", "coverage": "assay", "assay_type": "assay"}
    frames = ingest.normalize_flat(flat, classes)
    assert rows(frames["patient"]) == [("P1", 60), ("P2", 41)]
    assert rows(frames["specimen"]) == [("S1", "P1", "tumor"), ("S2", "P1", "normal"), ("S3", "P2", "tumor")]
    assert len(rows(frames["assay"])) == 4
    report = {r["column"]: (r["level"], r["type"]) for r in ingest.migration_report(flat).collect()}
    assert report["age"] == ("patient", "REAL") and report["coverage"] == ("assay", "REAL") and report["sex"] == ("patient", "TEXT")


def test_infer_and_coerce(spark, rows):
    frame = spark.createDataFrame(
        [("1", "True", "1.5", "x", None, "3"), ("2", "False", "2", "y", None, None)],
        "i string, b string, r string, t string, e string, n string",
    )
    types = {r["column"]: r["type"] for r in ingest.infer_types(frame).collect()}
    assert types == {"i": "INTEGER", "b": "BOOLEAN", "r": "REAL", "t": "TEXT", "e": "REAL", "n": "REAL"}
    good, bad = ingest.coerce_columns(frame, {"i": "INTEGER", "b": "BOOLEAN", "r": "INTEGER"})
    assert rows(good, "i", "b", "r") == [(2, False, 2)] and rows(bad, "i", "reject") == [("1", "r: expected INTEGER")]


def test_evolve_prefix_stamp(spark, manifest):
    extra = spark.createDataFrame([("s1", 1, True)], "sample_id string, depth int, qc_pass boolean")
    assert ingest.evolve_columns(manifest, extra, {"depth": "REAL"}).schema["depth"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        ingest.evolve_columns(manifest, extra, {"nope": "REAL"})
    done = ingest.stamp_done(extra, "m", "2024-01-01")
    assert ingest.prefix_columns(done, "m", "sample_id", "m").columns == ["sample_id", "m_depth", "qc_pass", "m_done"]


def test_whole_append(spark, levels, rows):
    events = spark.createDataFrame([], qc.QC_EVENT_SCHEMA)
    refs = spark.createDataFrame([("hg38", "v1")], "ref_key string, version string")
    usage = spark.createDataFrame([], "scope string, entity_level string, entity_id string, analysis string, "
                                      "artifact_id string, ref_key string, version_used string")
    results = spark.createDataFrame([("A1", 5, "false"), ("A9", 1, "true")], "assay_id string, depth int, qc_pass string")
    out = ingest.append(
        levels["assay"], results, "assay", "cov", events, "2024-01-01", "t1", prefix="cov",
        references=refs, usage=usage, uses=["hg38", "unknown"], upstreams=["reference:hg38"],
    )
    assert rows(out["missing_keys"]) == [("A9",)]
    assert rows(out["rows"], "assay_id", "cov_depth", "cov_done", "qc_status") == [("A1", 5, "2024-01-01", "fail")]
    assert rows(out["new_events"], "entity_id", "kind") == [("A1", "qc_fail")]
    assert rows(out["usage"], "entity_id", "ref_key") == [("A1", "hg38"), ("A9", "hg38")]
    assert out["candidate_edges"].count() == 2
    once = ingest.append_results(levels["assay"], results, "assay", "cov", "d")
    assert rows(ingest.append_results(once, results, "assay", "cov", "e")) == rows(once)


def test_merges_across_types(spark, rows):
    manifest = spark.createDataFrame([(1, None, "a"), (2, 5, None)], "id int, n int, note string")
    results = spark.createDataFrame([("1", "NA?", 3.5), ("x9", "7", 1.0)], "id string, n string, note double")
    assert rows(ingest.fill_only(manifest, results, "id"), "id", "n", "note") == [(1, "NA?", "a"), (2, "5", None)]
    flat = ingest.append_flat(manifest, results.select("id", "n"), "id", "cov", "t", allow_new=True)
    assert rows(flat, "id", "n") == [("1", "NA?"), ("2", "5"), ("x9", "7")]
    wide = spark.createDataFrame([(1, 2.5)], "id bigint, n double")
    assert rows(ingest.append_flat(manifest, wide, "id", "cov", "t"), "id", "n") == [(1, 2.5), (2, 5.0)]
    missing = ingest.gate_missing_keys(results, manifest, "id")
    assert rows(missing) == [("x9",)]
    censored = manifest.withColumn("qc_status", F.lit("fail"))
    assert rows(ingest.gate_censored(results, censored, "id")) == [(1, "fail")]


def test_flags_of_any_type(spark, rows):
    from cohort_ledger.operators import qc

    table = spark.createDataFrame(
        [("a", 0.0, "0.0"), ("b", 1.0, "1.0"), ("c", float("nan"), "nan"), ("d", None, " NO "), ("e", 2.0, "fine, 0 errors"), ("f", -0.0, "infinity")],
        "id string, qc_pass double, as_text string",
    )
    assert rows(qc.autoflag_extract(table, "id"), "entity_id") == [("a",), ("f",)]
    spelled = table.select("id", F.col("as_text").alias("qc_pass"))
    assert rows(qc.autoflag_extract(spelled, "id"), "entity_id") == [("a",), ("d",)]
    warned = table.select("id", F.col("qc_pass").alias("qc_warn"))
    assert rows(qc.autoflag_extract(warned, "id"), "entity_id") == [("b",), ("e",)]

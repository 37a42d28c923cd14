"""A third of all rows under one key, with broadcasts off and skew splitting forced."""

import random

import pytest
from pyspark.sql import functions as F

from cohort_ledger.operators import active, artifacts, ingest, status

TIGHT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}
N = 6000


@pytest.fixture()
def tight(spark):
    before = {k: spark.conf.get(k, None) for k in TIGHT}
    for k, v in TIGHT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def cohort(tight):
    ids = tight.range(N)
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    assays = ids.select(
        F.concat(F.lit("A"), "id").alias("assay_id"),
        F.concat(F.lit("S"), hot).alias("specimen_id"),
        F.lit("ONT").alias("assay_type"),
        F.when(F.col("id") % 2 == 0, "x").alias("align_done"),
        F.when(F.col("id") % 10 == 1, "fail").otherwise("pass").alias("qc_status"),
    )
    specimens = tight.range(500).select(
        F.concat(F.lit("S"), "id").alias("specimen_id"), F.concat(F.lit("P"), F.col("id") % 7).alias("patient_id"),
        F.lit("pass").alias("qc_status"),
    )
    patients = tight.range(7).select(
        F.concat(F.lit("P"), "id").alias("patient_id"), F.lit("pass").alias("qc_status"),
        F.when(F.col("id") == 3, "revoked").otherwise("consented").alias("consent_status"),
    )
    return patients, specimens, assays


def expected_active():
    out = 0
    for i in range(N):
        specimen = 0 if i % 3 == 0 else i % 500
        out += i % 10 != 1 and specimen % 7 != 3
    return out


def test_cascade_and_rollups(cohort):
    assert active.active_assays(*cohort).count() == expected_active()
    by_specimen = {r.specimen_id: r for r in status.status_by_specimen(*cohort).collect()}
    assert by_specimen["S0"].n_assays == sum(i % 3 == 0 or i % 500 == 0 for i in range(N))
    assert sum(r.n_assays for r in by_specimen.values()) == N and len(by_specimen) == 500
    per_patient = status.status_by_patient(*cohort).collect()
    assert sum(r.n_assays for r in per_patient) == N
    assert sum(r.align_done for r in per_patient) == sum(i % 2 == 0 for i in range(N))


def test_merge_and_staleness(tight, cohort):
    patients, specimens, assays = cohort
    results = assays.select("specimen_id", F.col("assay_id").alias("note"))
    merged = ingest.append_results(specimens, results, "specimen", "note", "d", order_col=None)
    assert merged.count() == 500
    inputs = assays.select(
        "assay_id", F.when(F.col("specimen_id") == "S0", "1").otherwise("2").alias("artifact_id")
    )
    table = artifacts.input_staleness(
        tight.createDataFrame([("1",), ("2",), ("3",)], "artifact_id string"), inputs, patients, specimens, assays
    )
    counts = {r.artifact_id: r.n_censored_inputs for r in table.collect()}
    assert counts["1"] + counts["2"] == N - expected_active() and counts["3"] == 0


def test_medians_in_rounds(spark):
    """One group of nearly all rows, cut again and again until a bucket fits, and small ones beside it."""
    from cohort_ledger.operators import rank

    rng = random.Random(9)
    values = {"hot": [round(rng.gauss(0, 1), 4) for _ in range(6001)], "even": list(range(10)), "same": [3.0] * 8, "one": [1.5], "ties": [0.0] * 50 + [1.0] * 50}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    for fits in (3, 200, 100_000):
        got = {r.k: (r.n, r.lower, r.upper) for r in rank.exact_middle(rank.histogram(frame, ["k"], "v"), ["k"], fits).collect()}
        assert got == {k: (len(vs), sorted(vs)[(len(vs) - 1) // 2], sorted(vs)[len(vs) // 2]) for k, vs in values.items()}

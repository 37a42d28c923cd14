"""Bulk censoring, batches, consent, and replay of the log."""

import random

import pytest
from pyspark.sql import functions as F

from cohort_ledger import sources, streaming
from cohort_ledger.model import LOG_SCHEMA, QC_EVENT_SCHEMA
from cohort_ledger.operators import active, qc, replay, status, validate


@pytest.fixture()
def cohort(spark):
    patients = spark.createDataFrame(
        [("P1", "consented", None, "pass"), ("P2", "consented", None, "pass")],
        "patient_id string, consent_status string, withdrawal_date string, qc_status string",
    ).withColumn("withdrawal_date", F.col("withdrawal_date").cast("date"))
    specimens = spark.createDataFrame(
        [("S1", "P1", "pass"), ("S2", "P1", "pass"), ("S3", "P2", "pass")],
        "specimen_id string, patient_id string, qc_status string",
    )
    assays = spark.createDataFrame(
        [("A01", "S1", "B1", "pass"), ("A02", "S1", "B1", "pass"), ("A03", "S2", None, "pass"), ("A_MERGED", "S2", None, "pass")],
        "assay_id string, specimen_id string, batch_id string, qc_status string",
    )
    return patients, specimens, assays


@pytest.fixture()
def no_events(spark):
    return spark.createDataFrame([], QC_EVENT_SCHEMA)


REQUEST = "level string, entity_id string, kind string, reason string"


def test_bulk_censor_is_all_or_nothing(spark, cohort, no_events, rows):
    good = [("assay", "A01", "qc_fail", "r"), ("patient", "P2", "consent_revoked", "withdrew")]
    out = qc.bulk_censor(spark.createDataFrame(good, REQUEST), no_events, *cohort, "2024-03-04", "t")
    assert rows(out["patients"], "patient_id", "consent_status", F.col("withdrawal_date").cast("string"), "qc_status") == [
        ("P1", "consented", None, "pass"), ("P2", "revoked", "2024-03-04", "consent_revoked")
    ]
    assert rows(out["assays"].filter("qc_status <> 'pass'"), "assay_id") == [("A01",)]
    assert validate.status_mismatch(
        {"patient": out["patients"], "specimen": out["specimens"], "assay": out["assays"]}, out["events"]
    ).count() == 0
    assert qc.consent_violations(out["patients"], out["events"]).count() == 0
    bad = good + [("specimen", "S1", "consent_revoked", "r"), ("assay", "nope", "qc_fail", "r")]
    out = qc.bulk_censor(spark.createDataFrame(bad, REQUEST), no_events, *cohort, "2024-03-04", "t")
    assert rows(out["rejects"], "entity_id", "reject") == [("S1", "kind_not_allowed_at_level"), ("nope", "unknown_entity")]
    assert out["new_events"].count() == 0 and rows(out["patients"], "consent_status") == [("consented",)] * 2


def test_second_active_event_is_refused_until_resolved(spark, cohort, no_events, rows):
    one = spark.createDataFrame([("assay", "A01", "qc_fail", "r")], REQUEST)
    first = qc.bulk_censor(one, no_events, *cohort, "2024-03-04", "t1")
    second = qc.bulk_censor(one, first["events"], *cohort, "2024-03-05", "t2")
    assert rows(second["rejects"], "reject") == [("already_active",)]
    close = spark.createDataFrame([(None, "assay", "A01", "checked")], "id string, level string, entity_id string, reason string")
    resolved = qc.resolve_events(first["events"], close, "2024-03-06")
    assert qc.active_events(resolved["events"]).count() == 0
    third = qc.bulk_censor(one, resolved["events"], *cohort, "2024-03-07", "t3")
    assert third["events"].count() == 2
    again = qc.resolve_events(resolved["events"], close, "2024-03-08")
    assert rows(again["rejects"], "reject") == [("no_active_event",)]


def test_consent_reversal_needs_a_reason(spark, cohort, no_events, rows):
    revoke = spark.createDataFrame([("patient", "P1", "consent_revoked", "asked")], REQUEST)
    out = qc.bulk_censor(revoke, no_events, *cohort, "2024-03-04", "t")
    text = "id string, level string, entity_id string, reason string"
    weak = spark.createDataFrame([(None, "patient", "P1", "seems fine")], text)
    kept = qc.uncensor(out["events"], weak, out["patients"], *cohort[1:], "2024-04-01")
    assert rows(kept["rejects"], "reject") == [("ethics_reason_required",)]
    assert rows(kept["patients"], "consent_status") == [("consented",), ("revoked",)]
    strong = spark.createDataFrame([(None, "patient", "P1", "re-consent signed")], text)
    back = qc.uncensor(out["events"], strong, out["patients"], *cohort[1:], "2024-04-01")
    assert rows(back["patients"], "consent_status", "withdrawal_date", "qc_status") == [("consented", None, "pass")] * 2


@pytest.mark.parametrize(
    "reason, ok",
    [("IRB 2024-1", True), ("per irb", True), ("ERB approved", True), ("Ethics   Committee ok", True),
     ("patient reconsented", True), ("form of 2024-03-01", True), ("seems fine", False), ("", False), ("firbush", False), (None, False)],
)
def test_ethics_gate(spark, reason, ok):
    frame = spark.createDataFrame([(reason,)], "reason string")
    assert qc.ethics_gate(frame).first().allowed is ok


def test_batch_cascade_goes_one_hop(spark, cohort, no_events, rows):
    links = spark.createDataFrame(
        [("A01", None, "S2"), ("A02", "A_MERGED", None), ("A_MERGED", None, "S3")],
        "source_assay_id string, merged_assay_id string, consumer_specimen_id string",
    )
    batch = spark.createDataFrame([("B1",)], "batch_id string")
    out = qc.censor_batch(batch, cohort[2], cohort[1], links, no_events, "2024-03-04", "t")
    assert out["counts"].first().asDict() == {"censored_assays": 2, "warned_specimens": 1, "censored_derived_assays": 1}
    assert dict(rows(out["assays"], "assay_id", "qc_status")) == {"A01": "fail", "A02": "fail", "A03": "pass", "A_MERGED": "fail"}
    assert dict(rows(out["specimens"], "specimen_id", "qc_status")) == {"S1": "pass", "S2": "warn", "S3": "pass"}
    again = qc.censor_batch(batch, cohort[2], cohort[1], links, out["events"], "2024-03-05", "t2")
    assert again["new_events"].count() == 0
    manual = qc.new_events(
        spark.createDataFrame([("assay", "A_MERGED", "other", "by hand")], REQUEST), "2024-03-05", "t3"
    )
    everything = out["events"].unionByName(manual)
    undone = qc.uncensor_batch(batch, cohort[2], cohort[1], links, everything, "2024-03-06")
    assert set(r[0] for r in rows(undone["assays"], "qc_status")) == {"pass"}
    own = qc.uncensor_batch(batch, cohort[2], cohort[1], links, everything, "2024-03-06", only_batch_events=True)
    assert dict(rows(own["assays"], "assay_id", "qc_status"))["A_MERGED"] == "censored"


def log_rows(spark, entries):
    names = LOG_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], LOG_SCHEMA)


def walk(entries, known):
    """Brute-force replay: a dictionary of open keys."""
    opened, events = {}, []
    for e in sorted(entries, key=lambda e: e["seq"]):
        key = (e["level"], e["entity_id"], e["kind"])
        if e["action"] == "censor":
            if key[:2] in known and key not in opened:
                opened[key] = len(events)
                events.append([key, e["timestamp"], None])
        elif key in opened:
            events[opened.pop(key)][2] = e["timestamp"]
    return sorted((k, a, b or "") for k, a, b in events)


@pytest.mark.parametrize("chunk", [1, 7, 1_000_000])
def test_replay_agrees_with_a_walk(spark, cohort, chunk):
    rng = random.Random(chunk)
    entries = []
    for i in range(120):
        level, ids = rng.choice([("assay", ["A01", "A02", "A99"]), ("specimen", ["S1"]), ("patient", ["P1"])])
        entries.append(
            {
                "seq": i, "action": rng.choice(["censor", "uncensor"]), "level": level, "entity_id": rng.choice(ids),
                "kind": rng.choice(["qc_fail", "qc_warn"]), "timestamp": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}",
                "reason": "r", "transaction_id": f"t{i}",
            }
        )
    known = {("assay", "A01"), ("assay", "A02"), ("specimen", "S1"), ("patient", "P1")}
    out = replay.replay_qc_log(log_rows(spark, entries), *cohort, chunk=chunk)
    text = "yyyy-MM-dd'T'HH:mm:ss"
    got = sorted(
        ((r.level, r.entity_id, r.kind), r.a, r.b or "")
        for r in out["events"].select(
            "level", "entity_id", "kind", F.date_format("created_at", text).alias("a"), F.date_format("resolved_at", text).alias("b")
        ).collect()
    )
    assert got == walk(entries, known)


def test_replay_of_consent_batches_and_legacy(spark, cohort, rows):
    entries = [
        {"seq": 1, "action": "censor", "level": "patient", "entity_id": "P1", "kind": "consent_revoked", "qc_event_id": "1",
         "withdrawal_date": "2024-02-01", "timestamp": "2024-02-01T00:00:00"},
        {"seq": 2, "action": "censor_batch", "batch_id": "B1", "reason": "bad lot", "censored_assays": ["A01", "A02"],
         "censored_derived_assays": ["A_MERGED"], "warned_specimens": ["S2"], "timestamp": "2024-02-02T00:00:00"},
        {"seq": 3, "action": "migrate_qc", "migrated_rows": [("A03",)], "timestamp": "2024-02-03T00:00:00"},
        {"seq": 4, "action": "uncensor_batch", "batch_id": "B1", "reason": "fine", "resolved_assays": ["A01"],
         "timestamp": "2024-02-04T00:00:00"},
        {"seq": 5, "action": "ethics_override", "qc_event_id": "1", "reason": "IRB", "timestamp": "2024-02-05T00:00:00"},
        {"seq": 6, "action": "uncensor", "qc_event_id": "77", "timestamp": "2024-02-06T00:00:00"},
    ]
    out = replay.replay_qc_log(log_rows(spark, entries), *cohort)
    open_now = qc.active_events(out["events"])
    assert rows(open_now, "entity_id", "kind") == [
        ("A02", "qc_fail"), ("A03", "qc_fail"), ("A_MERGED", "qc_fail"), ("S2", "qc_warn")
    ]
    assert rows(out["consent"], "patient_id", "consent_status", "withdrawal_date") == [("P1", "consented", None)]
    assert rows(out["warnings"], "seq", "warning") == [(6, "event_not_found")]


def test_replay_entities(spark, rows):
    entries = [
        {"seq": 1, "action": "register", "level": "assay", "id": "A1", "parent": "S1", "meta": {"assay_type": "ONT"}},
        {"seq": 2, "action": "append", "level": "assay", "analysis": "cov", "results_file": "r1", "timestamp": "2024-01-01"},
        {"seq": 3, "action": "add_metadata", "level": "assay", "results_file": "m1"},
        {"seq": 4, "action": "append", "level": "assay", "analysis": "cov", "results_file": "lost"},
    ]
    files = spark.createDataFrame(
        [("r1", "A1", "30", None), ("r1", "A7", "1", None), ("m1", "A1", None, "WGS"), ("m1", "A2", None, "WGS")],
        "results_file string, assay_id string, depth string, assay_type string",
    )
    out = replay.replay_entities(log_rows(spark, entries), files, "assay", ["depth", "assay_type", "cov_done"])
    assert rows(out["rows"], "assay_id", "specimen_id", "depth", "assay_type", "cov_done") == [
        ("A1", "S1", "30", "ONT", "2024-01-01"), ("A2", None, None, "WGS", None)
    ]
    assert rows(out["missing_sources"], "results_file") == [("lost",)]


def test_event_log_reader(spark, tmp_path, rows):
    path = tmp_path / "log.jsonl"
    path.write_text('{"action": "censor", "entity_id": "A1"}\nnot json\n{"action": "uncensor", "entity_id": "A2"}\n')
    log = sources.read_event_log(spark, str(path))
    assert [r.entity_id for r in log.orderBy("seq").collect()] == ["A1", "A2"]
    with pytest.raises(Exception):
        sources.read_event_log(spark, str(path), strict=True).collect()
    assert rows(active.log_filter(log.withColumn("timestamp", F.lit("t")), last=1), "entity_id") == [("A2",)]


def test_stream_of_log_lines(spark, tmp_path, rows, cohort):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    lines = [
        '{"seq": 5, "action": "uncensor", "qc_event_id": "e1", "reason": "ok", "timestamp": "2024-01-02T00:00:00"}',
        '{"seq": 1, "action": "censor", "qc_event_id": "e1", "level": "assay", "entity_id": "A01", "kind": "qc_fail", "timestamp": "2024-01-01T00:00:00"}',
        '{"seq": 2, "action": "censor", "qc_event_id": "e2", "level": "assay", "entity_id": "A02", "kind": "qc_warn", "timestamp": "2024-01-01T00:00:00"}',
        '{"seq": 2, "action": "censor", "qc_event_id": "e2", "level": "assay", "entity_id": "A02", "kind": "qc_warn", "timestamp": "2024-01-01T00:00:00"}',
        '{"seq": 3, "action": "censor_batch", "batch_id": "b", "reason": "bad lot", "censored_assays": ["A03"], "timestamp": "2024-01-01T00:00:00"}',
        '{"seq": 4, "action": "censor", "level": "assay", "entity_id": "A_MERGED", "kind": "qc_fail", "timestamp": "2024-01-01T00:00:00"}',
        '{"seq": 6, "action": "uncensor", "level": "assay", "entity_id": "A_MERGED", "kind": "qc_fail", "timestamp": "2024-01-03T00:00:00"}',
    ]
    for i, line in enumerate(lines):
        (landing / f"{i}.json").write_text(line + "\n")
        streaming.stream_qc_log(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    events = streaming.current_events(spark.read.parquet(f"{out}/log"), *cohort)
    assert rows(qc.derive_status(events)) == [("assay", "A02", "warn"), ("assay", "A03", "fail")]
    assert events.count() == 4


def test_stream_keeps_different_log_lines(spark, tmp_path):
    """Places beyond 2,048 partitions, two files that number their lines from 0, and a line delivered twice."""
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    for i in range(2):
        (landing / f"{i}.json").write_text("".join('{"seq": %d, "action": "censor", "entity_id": "A%d%d"}\n' % (j, i, j) for j in range(3)))
        streaming.stream_qc_log(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    (landing / "2.json").write_text('{"seq": 1, "action": "censor", "entity_id": "A11"}\n{"action": "censor", "entity_id": "B"}\n{"action": "censor", "entity_id": "B"}\n')
    streaming.stream_qc_log(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    found = streaming.current_log(spark.read.parquet(f"{out}/log")).orderBy("seq").collect()
    assert [r.entity_id for r in found] == ["A00", "A10", "A01", "A11", "A02", "A12", "B", "B"]
    assert [r.seq for r in found] == list(range(8))


def test_stream_keeps_lines_of_very_many_partitions(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    wave = lambda n, name: "".join('{"action": "censor", "entity_id": "%s%d"}\n' % (name, i) for i in range(n))
    (landing / "0.json").write_text(wave(2200, "a"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        streaming.stream_qc_log(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    (landing / "1.json").write_text(wave(1, "b"))
    streaming.stream_qc_log(spark, str(landing), out, str(tmp_path / "ck")).awaitTermination()
    found = streaming.current_log(spark.read.parquet(f"{out}/log"))
    assert found.count() == found.select("seq").distinct().count() == 2201
    assert found.orderBy("seq").tail(1)[0].entity_id == "b0"


def test_log_reports(spark, rows):
    entries = [
        {"seq": 1, "action": "append", "analysis": "merge", "slurm_job_id": "1", "columns_added": ["x", "merge_done"]},
        {"seq": 2, "action": "append", "analysis": "merge", "slurm_job_id": "2", "columns_added": ["x"]},
        {"seq": 3, "action": "append", "analysis": "merge", "slurm_job_id": "3"},
        {"seq": 4, "action": "append", "analysis": "merge", "slurm_job_id": "4"},
        {"seq": 5, "action": "censor", "slurm_job_id": "9", "analysis": None},
        {"seq": 6, "action": "project_status_change", "project_id": "p", "to_status": "complete"},
        {"seq": 7, "action": "project_status_change", "project_id": "p", "to_status": "archived"},
    ]
    log = log_rows(spark, entries)
    jobs = spark.createDataFrame(
        [("1", 10, 2), ("2", 40, 1), ("3", 20, 1), ("4", 30, 1)], "slurm_job_id string, elapsed_s long, req_cpus int"
    )
    timing = {r.phase: r for r in status.phase_timing(log, jobs).collect()}
    assert timing["merge_ont"].median_s == 30 and timing["merge_ont"].cpu_hours == pytest.approx(110 / 3600)
    assert timing["censor"].n_jobs == 1 and timing["censor"].median_s is None
    assert rows(status.analysis_columns(log)) == [("merge", "merge_done"), ("merge", "x")]
    assert rows(status.last_status_change(log), "project_id", "to_status") == [("p", "archived")]


def test_event_log_of_several_files_and_odd_fields(spark, tmp_path):
    for name, ids in (("a.jsonl", "12"), ("b.jsonl", "345")):
        (tmp_path / name).write_text("".join('{"action": "censor", "entity_id": "%s", "columns_added": "text"}\n' % i for i in ids))
    log = sources.read_event_log(spark, str(tmp_path))
    got = log.orderBy("seq").collect()
    assert [r.entity_id for r in got] == list("12345") and len({r.seq for r in got}) == 5
    assert log.select("entity_id", "columns_added").count() == log.select("entity_id").count() == 5
    assert sources.read_event_log(spark, str(tmp_path), strict=True).count() == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_closes_by_id(spark, cohort, seed):
    """Late, repeated and unknown ids: a close that names an event resolves that one or nothing."""
    rng = random.Random(seed)
    known = [("patient", r.patient_id) for r in cohort[0].collect()][:3]
    opened, events, entries = {}, {}, []
    for seq in range(150):
        level, entity = rng.choice(known)
        key = (level, entity, "qc_fail")
        base = {"seq": seq, "timestamp": f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}", "level": level, "entity_id": entity, "kind": "qc_fail"}
        if key not in opened and rng.random() < 0.6:
            entries.append({**base, "action": "censor", "qc_event_id": str(seq)})
            opened[key], events[str(seq)] = str(seq), [key, None]
            continue
        named = rng.choice([None, str(rng.randrange(150)), *list(events)[-4:]])
        entries.append({**base, "action": "uncensor", "qc_event_id": named})
        target = named if named in events else opened.get(key)
        if target is not None and events[target][1] is None:
            events[target][1] = base["timestamp"]
            del opened[events[target][0]]
    for chunk in (7, 1_000_000):
        got = replay.replay_qc_log(log_rows(spark, entries), *cohort, chunk=chunk)["events"].collect()
        assert {r.id: r.resolved_at is not None for r in got} == {i: e[1] is not None for i, e in events.items()}

"""Publishing several tables at once, and merging appended batches under readers."""

import random

import pytest
from pyspark.sql import functions as F

from cohort_ledger.operators import validate
from cohort_ledger.sinks import versions
from cohort_ledger.streaming import compact

CHANGES = "place long, v string, deleted boolean"


def levels(spark, assay_parents):
    patients = spark.createDataFrame([("P1",)], "patient_id string")
    specimens = spark.createDataFrame([("S1", "P1")], "specimen_id string, patient_id string")
    assays = spark.createDataFrame([(f"A{i}", s) for i, s in enumerate(assay_parents)], "assay_id string, specimen_id string")
    return {"patient": patients, "specimen": specimens, "assay": assays}


AUDITS = {"orphans": validate.fk_orphans}


def test_commit_is_all_or_nothing(spark, tmp_path, rows, monkeypatch):
    root = str(tmp_path / "store")
    assert versions.read_tables(spark, root) == {}
    assert versions.commit_tables(spark, root, levels(spark, ["S1"]), AUDITS)["version"] == 1
    bad = versions.commit_tables(spark, root, levels(spark, ["S1", "S9"]), AUDITS)
    assert bad["version"] is None and bad["rejects"]["orphans"].count() == 1
    assert versions.latest(spark, root) == 1 and versions.read_tables(spark, root)["assay"].count() == 1
    assert len([n for n in versions.listed(spark, f"{root}/assay")]) == 1  # nothing of the refused one stays

    real, calls = type(levels(spark, [])["assay"].write).parquet, []

    def failing(self, path, *a, **k):
        calls.append(path)
        if "/specimen/" in path:
            raise OSError("lost between two tables")
        return real(self, path, *a, **k)

    monkeypatch.setattr(type(levels(spark, [])["assay"].write), "parquet", failing)
    with pytest.raises(OSError):
        versions.commit_tables(spark, root, levels(spark, ["S1", "S1"]), AUDITS)
    monkeypatch.undo()
    assert len(calls) == 2 and versions.latest(spark, root) == 1
    assert rows(versions.read_tables(spark, root)["assay"]) == [("A0", "S1")]


def test_of_two_writers_one_wins(spark, tmp_path):
    root = str(tmp_path / "store")
    versions.commit_tables(spark, root, levels(spark, ["S1"]))
    one = versions.commit_tables(spark, root, {"assay": levels(spark, ["S1", "S1"])["assay"]}, AUDITS, after=1)
    assert one["version"] == 2 and versions.read_tables(spark, root)["patient"].count() == 1
    with pytest.raises(versions.VersionConflict):
        versions.commit_tables(spark, root, {"assay": levels(spark, [])["assay"]}, after=1)
    assert versions.read_tables(spark, root)["assay"].count() == 2
    assert versions.read_tables(spark, root, 1)["assay"].count() == 1
    assert len(versions.vacuum_tables(spark, root, keep=1)) == 1
    assert versions.read_tables(spark, root)["assay"].count() == 2


def test_compaction_keeps_the_state(spark, tmp_path):
    path, draw, state = str(tmp_path / "changes"), random.Random(2), {}
    merge = compact.latest_changes(["place"])
    for batch in range(14):
        changes = {draw.randrange(30): (f"b{batch}", draw.random() < 0.2) for _ in range(8)}
        state |= changes
        spark.createDataFrame([(k, v, d) for k, (v, d) in changes.items()], CHANGES).write.parquet(f"{path}/_batch={batch}")
        before = compact.current(spark, path)
        compact.compact(spark, path, merge, ["place"], fan=3)
        for frame in (before, compact.current(spark, path)):  # a reader from before goes on reading what it saw
            newest = merge(frame, True).collect()
            assert {r.place: r.v for r in newest} == {k: v for k, (v, d) in state.items() if not d}
    runs = versions.content(spark, path)["runs"]
    assert max(r["level"] for r in runs) >= 2
    assert all(a["to"] + 1 == b["from"] for a, b in zip(runs, runs[1:], strict=False))
    assert compact.vacuum(spark, path)
    assert {r.place: r.v for r in merge(compact.current(spark, path), True).collect()} == {k: v for k, (v, d) in state.items() if not d}


def test_readers_see_no_half_of_a_merge(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    for batch in range(5):
        spark.createDataFrame([("k", None if batch < 2 else f"v{batch}"), (f"k{batch}", "x")], "key string, v string").write.parquet(f"{path}/_batch={batch}")
    spark.createDataFrame([("k", "half")], "key string, v string").write.parquet(f"{path}/_batch=5")
    (tmp_path / "results" / "_batch=5" / "_SUCCESS").unlink()  # a batch that is still being written
    merge = compact.first_values("key")
    read = lambda: {r.key: r.v for r in merge(compact.current(spark, path), True).collect()}
    want = {"k": "v2"} | {f"k{b}": "x" for b in range(5)}
    assert read() == want

    def lost(*a):
        raise OSError("lost before the version was published")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "publish", lost)
        with pytest.raises(OSError):
            compact.compact(spark, path, merge, ["key"], fan=2)
    assert read() == want  # the snapshot is there, and nobody reads it
    assert compact.compact(spark, path, merge, ["key"], fan=2) == 1
    assert read() == want
    assert compact.current(spark, path).filter(F.col("key") == "k").count() == 2
    assert any(n.startswith("_runs/") for n in compact.vacuum(spark, path))
    assert read() == want

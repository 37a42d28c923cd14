"""Compaction of the batches that streams append.

A stream appends one folder ``_batch=<id>`` for each batch.  ``compact`` merges runs
of batches into snapshots, sorted by key: ``fan`` batches make a snapshot of the
first level, ``fan`` snapshots of a level one of the next, so every row is rewritten
a number of times that follows the logarithm of the batches.  A version file
names the snapshots and the batches each covers; it is made after they are
written, and readers follow it, so they see the runs before a merge or those
after it, never both or half.  Runs cover batches without gaps and in order, which
keeps "first value" and "latest change" what they are over single batches.

What is left behind is deleted by ``vacuum``, once no reader needs it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.sinks import versions

FAN = 8

Merge = Callable[[DataFrame, bool], DataFrame]


def first_values(key: str) -> Merge:
    """Merges appended results: for each key the earliest value of each column."""

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        others = [c for c in rows.columns if c not in (key, "_batch")]
        picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_batch"))).alias(c) for c in others]
        return rows.groupBy(key).agg(*picks, F.min("_batch").alias("_batch"))

    return merge


def latest_changes(place: list[str], deleted: str = "deleted") -> Merge:
    """Merges appended changes: the latest of each place; deletions go once nothing older is left."""

    def merge(rows: DataFrame, whole: bool) -> DataFrame:
        others = [c for c in rows.columns if c not in (*place, "_batch")]
        newest = rows.groupBy(*place).agg(F.max_by(F.struct(*others), "_batch").alias("_c"), F.max("_batch").alias("_batch")).select(*place, "_c.*", "_batch")
        return newest.filter(~F.col(deleted)) if whole else newest

    return merge


def _loose(spark: SparkSession, path: str, after: int) -> list[int]:
    """Finished batches beyond ``after``, in order."""
    names = [n for n in versions.listed(spark, path) if n.startswith("_batch=")]
    later = sorted(b for b in (int(n.split("=")[1]) for n in names) if b > after)
    return [b for b in later if versions.exists(spark, f"{path}/_batch={b}/_SUCCESS")]


def _runs(spark: SparkSession, path: str, runs: list[dict], loose: list[int]) -> DataFrame:
    frames = [spark.read.parquet(f"{path}/{r['folder']}") for r in runs]
    if loose:
        frames.append(spark.read.option("basePath", path).parquet(*[f"{path}/_batch={b}" for b in loose]).withColumn("_batch", F.col("_batch").cast("long")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def current(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a stream's folder with their ``_batch``: the snapshots of the newest version and the batches after them."""
    runs = versions.content(spark, path).get("runs", [])
    return _runs(spark, path, runs, _loose(spark, path, max((r["to"] for r in runs), default=-1)))


def compact(spark: SparkSession, path: str, merge: Merge, sort_by: list[str], fan: int = FAN) -> int | None:
    """Merge what is due; the new version's number, or None where nothing was.

    The last batch stays loose: a stream that starts again may write it once more.
    """
    number = versions.latest(spark, path)
    runs = versions.content(spark, path, number).get("runs", [])
    loose = _loose(spark, path, max((r["to"] for r in runs), default=-1))[:-1]
    made = None
    if len(loose) >= fan:
        made = {"from": loose[0], "to": loose[-1], "level": 1}
        taken, runs = [], list(runs)
    else:
        loose = []
        levels = sorted({r["level"] for r in runs})
        due = next((lv for lv in levels if sum(r["level"] == lv for r in runs) >= fan), None)
        if due is None:
            return None
        # Runs of one level stand together, larger ones before smaller ones.
        taken = [r for r in runs if r["level"] == due]
        made = {"from": taken[0]["from"], "to": taken[-1]["to"], "level": due + 1}
    rest = [r for r in runs if r not in taken]
    whole = not any(r["to"] < made["from"] for r in rest)
    made["folder"] = f"_runs/{made['level']}-{made['from']}-{made['to']}-{uuid.uuid4().hex}"
    merged = merge(_runs(spark, path, taken, loose), whole)
    merged.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by).write.parquet(f"{path}/{made['folder']}")
    ordered = sorted([*rest, made], key=lambda r: r["from"])
    return versions.publish(spark, path, number, {"runs": ordered})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete batches and snapshots that the newest version does not need; returns them."""
    runs = versions.content(spark, path).get("runs", [])
    if not runs:
        return []
    last, wanted = max(r["to"] for r in runs), {r["folder"] for r in runs}
    batches = [n for n in versions.listed(spark, path) if n.startswith("_batch=") and int(n.split("=")[1]) <= last]
    snapshots = [f"_runs/{n}" for n in versions.listed(spark, f"{path}/_runs") if f"_runs/{n}" not in wanted]
    for name in [*batches, *snapshots]:
        versions.removed(spark, f"{path}/{name}")
    return sorted([*batches, *snapshots])

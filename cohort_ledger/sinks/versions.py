"""Versions of several tables, published together by one pointer file.

A version is a small JSON file ``_versions/<number>.json`` below a root folder.  It
names the folders that hold each table.  Tables are written first, into folders
of their own; the version file is made last, under its final name, and only if no
file of that number is there.  So readers see all tables of a version or none of
it, and of two writers that start from one version only one succeeds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Audit = Callable[[dict[str, DataFrame]], DataFrame]


class VersionConflict(RuntimeError):
    """Another writer has published the next version."""


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is missing."""
    place, store = _folder(spark, path)
    return [x.getPath().getName() for x in store.listStatus(place)] if store.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _folder(spark, path)
    return store.exists(place)


def removed(spark: SparkSession, path: str) -> None:
    place, store = _folder(spark, path)
    store.delete(place, True)


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 before the first."""
    names = [n.removesuffix(".json") for n in listed(spark, f"{root}/_versions") if n.endswith(".json")]
    return max((int(n) for n in names if n.isdigit()), default=0)


def content(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """What a version says; empty before the first."""
    number = latest(spark, root) if number is None else number
    if not number:
        return {}
    return json.loads(spark.read.text(f"{root}/_versions/{number}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, after: int, what: dict) -> int:
    """Make the version that follows ``after``; fails if it is there already.

    The file is written beside and renamed, so it is never seen in part.
    """
    target, store = _folder(spark, f"{root}/_versions/{after + 1}.json")
    draft, _ = _folder(spark, f"{root}/_versions/.{uuid.uuid4().hex}")
    if store.exists(target):
        raise VersionConflict(f"version {after + 1} of {root} is there already")
    out = store.create(draft, False)
    try:
        out.write(bytearray(json.dumps(what).encode()))
    finally:
        out.close()
    if not store.rename(draft, target):
        store.delete(draft, False)
        raise VersionConflict(f"version {after + 1} of {root} is there already")
    return after + 1


def read_tables(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version, the newest if none is named."""
    return {name: spark.read.parquet(f"{root}/{folder}") for name, folder in content(spark, root, number).get("tables", {}).items()}


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame], audits: dict[str, Audit] | None = None, after: int | None = None) -> dict:
    """Write tables, audit what was written, and publish them as one version, or change nothing.

    An audit gets all tables of the version to be, those left as they are
    included, and returns the rows that must not be there.  Returns ``version``, or
    None with the ``rejects`` of each audit that found any.  ``after`` is the version
    the tables were made from; a newer one in the meantime is a conflict.
    """
    after = latest(spark, root) if after is None else after
    before = content(spark, root, after).get("tables", {})
    folders = {name: f"{name}/{uuid.uuid4().hex}" for name in tables}
    try:
        for name, rows in tables.items():
            rows.write.parquet(f"{root}/{folders[name]}")
        written = {name: spark.read.schema(rows.schema).parquet(f"{root}/{folders[name]}") for name, rows in tables.items()}
        whole = {**{n: spark.read.parquet(f"{root}/{f}") for n, f in before.items() if n not in tables}, **written}
        found = {name: audit(whole) for name, audit in (audits or {}).items()}
        rejects = {name: rows for name, rows in found.items() if not rows.isEmpty()}
        if not rejects:
            return {"version": publish(spark, root, after, {"tables": {**before, **folders}}), "rejects": {}}
        # The audits read what is about to go.
        kept = {name: rows.sparkSession.createDataFrame(rows.limit(REPORTED).collect(), rows.schema) for name, rows in rejects.items()}
    except Exception:
        for folder in folders.values():
            removed(spark, f"{root}/{folder}")
        raise
    for folder in folders.values():
        removed(spark, f"{root}/{folder}")
    return {"version": None, "rejects": kept}


#: Rows that a refused commit reports of each audit.
REPORTED = 1_000


def vacuum_tables(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders that none of the last ``keep`` versions names; returns them."""
    last = latest(spark, root)
    tables = [content(spark, root, n)["tables"] for n in range(max(1, last - keep + 1), last + 1)]
    wanted = {folder for t in tables for folder in t.values()}
    gone = [f"{name}/{x}" for name in {n for t in tables for n in t} for x in listed(spark, f"{root}/{name}") if f"{name}/{x}" not in wanted]
    for folder in gone:
        removed(spark, f"{root}/{folder}")
    return sorted(gone)

"""Session helpers: settings for a long job and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohort-ledger", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Only where neither is set (a local test run) is a temporary folder made,
    once per session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = spark.conf.get("spark.cohort.scratch", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="cohort-ledger-")
        spark.conf.set("spark.cohort.scratch", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the run's folder, or else the shared folder."""
    base = spark.conf.get("spark.cohort.run", None) or shared_folder(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder that owns what ``cut`` and ``fresh_path`` write inside the block.

    It is deleted at the end, so results must be written or collected before.
    """
    before = spark.conf.get("spark.cohort.run", None)
    folder = fresh_path(spark, "run")
    spark.conf.set("spark.cohort.run", folder)
    try:
        yield folder
    finally:
        if before is None:
            spark.conf.unset("spark.cohort.run")
        else:
            spark.conf.set("spark.cohort.run", before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Ends the lineage like ``checkpoint()``, so a lost executor repeats only
    later work.  A written table is computed once, stays columnar, and has a
    known size, from which Spark decides by itself what is small enough to
    broadcast.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` on the shared folder; cheaper than a table for small rounds."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()

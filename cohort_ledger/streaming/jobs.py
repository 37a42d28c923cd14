"""Result files and log lines as streams.

A micro-batch only appends its own partition ``_batch=<id>``, written with
overwrite so that a replayed batch replaces itself.  The current state is
computed at read time from the appended rows: no table is rewritten per batch,
rows may arrive in any order, and losing an executor repeats one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohort_ledger.model import (
    AUTOFLAG_COLUMNS,
    DEFAULT_SCHEMA,
    LOG_SCHEMA,
    CohortSchema,
)
from cohort_ledger.operators.ingest import gate_censored, merge_fill, one_per_key, stamp_done
from cohort_ledger.operators.qc import ACTIVE_KEY, autoflag_extract, dedupe_active, new_events
from cohort_ledger.operators.replay import replay_qc_log
from cohort_ledger.session import cut


def _append(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")


def stream_append(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    key: str,
    analysis: str,
    out: str,
    checkpoint: str,
    as_of,
    level: str = "assay",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Result files landing in a folder, as appended results and flag events.

    A file whose header differs from ``schema`` in names or order fails its
    batch; columns are never taken by position alone.
    """
    reader = spark.readStream.schema(schema).option("sep", "\t").option("header", True)
    files = reader.option("enforceSchema", False).csv(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = stamp_done(batch.drop(*AUTOFLAG_COLUMNS), analysis, as_of)
        _append(one_per_key(stamped, key), batch_id, f"{out}/results")
        flags = autoflag_extract(batch, key).select(
            F.lit(level).alias("level"),
            "entity_id",
            F.when(F.col("action") == "fail", "qc_fail").otherwise("qc_warn").alias("kind"),
            "reason",
        )
        events = new_events(flags, as_of, f"{analysis}:{batch_id}", "slurm:stream", "slurm")
        _append(events, batch_id, f"{out}/events")

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_rows(rows: DataFrame, results: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Level rows filled from all appended batches; the earliest value wins.

    Unknown keys are left out, and so are results of rows whose own status
    forbids loading, unless forced.
    """
    if "qc_status" in rows.columns and not force:
        barred = gate_censored(results, rows, key).select(F.col(key).cast("string").alias("_barred"))
        results = results.join(barred, F.col(key).cast("string") == F.col("_barred"), "left_anti")
    return merge_fill(rows, one_per_key(results, key, "_batch", "first_value"), key)


def current_flags(flags: DataFrame, rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """The appended flag events that count, beside the ``events`` there are.

    Only known entities; of repeated flags the first batch's; none whose kind is
    already active on its entity.
    """
    once = (
        flags.groupBy(*ACTIVE_KEY)
        .agg(F.min(F.struct("_batch", *[c for c in flags.columns if c not in (*ACTIVE_KEY, "_batch")])).alias("_e"))
        .select(*ACTIVE_KEY, "_e.*")
        .drop("_batch")
        .select(*[c for c in flags.columns if c != "_batch"])
    )
    known = rows.select(F.col(key).cast("string").alias("entity_id"))
    return dedupe_active(once.join(known, "entity_id", "left_semi").select(*once.columns), events)


def stream_qc_log(
    spark: SparkSession, landing: str, out: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Log lines as appended rows of the log schema, with the ``_place`` of each in its batch.

    Places number the rows of a batch in the order it was read.
    """
    lines = spark.readStream.schema(LOG_SCHEMA).json(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        _append(batch.withColumn("_place", F.monotonically_increasing_id()), batch_id, f"{out}/log")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _numbered(rows: DataFrame, order: list[str], start) -> DataFrame:
    """``seq`` counted up from ``start`` in the order of the columns, in as many tasks as there are ranges."""
    part = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy(F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    # One row for each range.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_of", before.alias("_start"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    counted = part.withColumn("_nth", place).join(starts, F.col("_part") == F.col("_of"))
    return counted.withColumn("seq", (start + F.col("_start") + F.col("_nth")).cast("bigint")).drop("_part", "_of", "_start", "_nth")


def current_log(log: DataFrame) -> DataFrame:
    """The appended log without lines delivered twice, each line with a ``seq`` of its own.

    A line with ``seq`` is delivered twice if all its fields are equal; a line
    without one never, as a repeated batch replaces itself.  Lines keep the
    ``seq`` they bring.  Where different lines bring the same one, all lines with
    ``seq`` are numbered anew by ``seq``, batch and place.  Lines without follow
    after them, by batch and place.
    """
    names = [c for c in log.columns if c not in ("_batch", "_place")]
    given = log.filter(F.col("seq").isNotNull()).groupBy(*names).agg(F.min(F.struct("_batch", "_place")).alias("_at"))
    given = cut(given.select(*names, "_at._batch", "_at._place"))
    if not given.groupBy("seq").count().filter("count > 1").isEmpty():
        given = _numbered(given, ["seq", "_batch", "_place"], F.lit(0))
    plain = log.filter(F.col("seq").isNull())
    if plain.isEmpty():
        return given.select(*names)
    last = given.agg(F.max("seq")).first()[0]
    plain = _numbered(plain, ["_batch", "_place"], F.lit(-1 if last is None else last) + 1)
    return given.select(*names).unionByName(plain.select(*names))


def current_events(
    log: DataFrame, patients: DataFrame, specimens: DataFrame, assays: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Event rows from the appended log: its replay, by ids, keys, batches and legacy entries.

    The order is that of ``seq``, so it does not matter in which batch a line came.
    """
    return replay_qc_log(current_log(log), patients, specimens, assays, schema)["events"]

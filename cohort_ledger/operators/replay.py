"""Rebuilding events and entities from the provenance log.

The log is ordered by ``seq``.  A key's sequence is cut into segments, each of
which acts on the key's state (open or closed) like a small automaton; segments
are folded on their own and the folds combined, so that a key with most of the
log is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohort_ledger.functions.qc import event_id
from cohort_ledger.model import DEFAULT_SCHEMA, DONE_SUFFIX, EVENT_COLUMNS, CohortSchema
from cohort_ledger.operators.qc import ACTIVE_KEY
from cohort_ledger.session import cut

CHUNK = 1_000_000


def _beside(rows: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their segment is given; a key that lacks a part is a key like any other."""
    names = [*keys, "_segment"]
    given = given.withColumnsRenamed({c: f"_of_{c}" for c in names})
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names])
    return rows.join(given, same, "left").drop(*[f"_of_{c}" for c in names])


def fold_steps(steps: DataFrame, keys: list[str], order: str, chunk: int = CHUNK) -> DataFrame:
    """Opening and closing steps with what they do, by the two states of their key.

    ``steps`` have ``op`` (open, close) and ``_opened``, the order of the event that a
    close names, or NULL.  Adds ``_open``, whether the key is open before the step,
    and ``_next``, the close that follows; a close of an event that was closed by key
    since is left out.

    A segment of a key's sequence covers a fixed range of ``order``, so that a key with
    most of the log is many.  It acts on the key's state like a small automaton, known
    by its last close by key, its last operation and its first close.  Segments are
    walked on their own, and their folds, one row each, combined along the key.  A log
    that fits one segment has nothing to combine.
    """
    close = F.col("op") == "close"
    by_key = F.when(close & F.col("_opened").isNull(), F.col(order))
    rows = cut(steps.withColumn("_segment", F.floor(F.col(order) / chunk)))
    span = rows.agg(F.min("_segment").alias("low"), F.max("_segment").alias("high")).first()
    many = span.low != span.high
    names = [*keys, "_segment"]
    chain, along = W.partitionBy(*keys).orderBy("_segment"), W.partitionBy(*names).orderBy(order)
    earlier = chain.rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(F.desc("_segment")).rowsBetween(W.unboundedPreceding, -1)
    last_close = F.max(by_key).over(along.rowsBetween(W.unboundedPreceding, -1))
    if many:
        tops = rows.groupBy(*names).agg(F.max(by_key).alias("_top"))
        rows = _beside(rows, tops.select(*names, F.max("_top").over(earlier).alias("_far")), keys)
        last_close = F.greatest(last_close, "_far")
    rows = rows.withColumn("_closed", last_close).filter(F.coalesce(F.col("_closed") <= F.col("_opened"), F.lit(True)))

    back = W.partitionBy(*names).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    closing = F.when(close, F.struct(order, "at", "by", "reason"))
    rows = rows.withColumn("_before", F.lag("op").over(along)).withColumn("_next", F.last(closing, ignorenulls=True).over(back))
    rows = cut(rows)
    if many:
        folds = rows.groupBy(*names).agg(F.max_by("op", order).alias("_last"), F.min(closing).alias("_first"))
        carried = folds.select(*names, F.lag("_last").over(chain).alias("_came"), F.last("_first", ignorenulls=True).over(later).alias("_comes"))
        rows = _beside(rows, carried, keys).withColumns({"_before": F.coalesce("_before", "_came"), "_next": F.coalesce("_next", "_comes")})
    return rows.withColumn("_open", F.coalesce("_before", F.lit("close")) == "open")


def log_entries(log: DataFrame) -> DataFrame:
    """Log rows as single open and close entries on ``(level, entity_id, kind)``.

    One pass over the log: each row becomes an array of its entries.
    """
    none = F.lit(None).cast("string")
    action, reason = F.col("action"), F.coalesce("reason", F.lit(""))
    opened_at = F.to_timestamp(F.coalesce("created_at", "timestamp"))
    closed_at = F.to_timestamp(F.coalesce("resolved_at", "timestamp"))
    opened_by = F.coalesce("created_by", F.lit("unknown"))
    closed_by = F.coalesce("resolved_by", F.lit("unknown"))
    source = F.coalesce("source", F.lit("manual"))

    def entry(op, level, entity, kind, reason, at, by, source, ref=none, withdrawal=none):
        return F.struct(
            F.lit(op).alias("op"),
            level.alias("level"),
            entity.alias("entity_id"),
            kind.alias("kind"),
            reason.alias("reason"),
            at.alias("at"),
            by.alias("by"),
            ref.alias("qc_event_id"),
            source.alias("source"),
            withdrawal.alias("withdrawal_date"),
        )

    def each(column, make):
        return F.coalesce(F.transform(column, make), F.array().cast(empty))

    one = entry(
        "open", F.col("level"), F.col("entity_id"), F.col("kind"), reason, opened_at, opened_by,
        source, F.col("qc_event_id"), F.col("withdrawal_date"),
    )
    empty = log.select(F.array(one).alias("e")).schema["e"].dataType
    close = entry(
        "close", F.col("level"), F.col("entity_id"), F.col("kind"), reason, closed_at, closed_by,
        source, F.col("qc_event_id"),
    )
    legacy = each(
        "migrated_rows",
        lambda e: entry(
            "open", F.lit("assay"), e["assay_id"], F.lit("qc_fail"),
            F.lit("migrated from legacy qc_pass"), F.to_timestamp("timestamp"),
            F.lit("import:migrate-qc"), F.lit("import"),
        ),
    )
    via = F.concat(F.lit("source assay in batch '"), F.col("batch_id"), F.lit("' censored"))

    def opens(column, level, kind, why):
        return each(
            column,
            lambda e: entry("open", F.lit(level), e, F.lit(kind), why, opened_at, opened_by, source),
        )

    def closes(column, level):
        return each(
            column,
            lambda e: entry("close_all", F.lit(level), e, none, reason, closed_at, closed_by, source),
        )

    batch_opens = F.concat(
        opens("censored_assays", "assay", "qc_fail", reason),
        opens("censored_derived_assays", "assay", "qc_fail", via),
        opens("warned_specimens", "specimen", "qc_warn", via),
    )
    batch_closes = F.concat(
        closes("resolved_assays", "assay"),
        closes("resolved_derived_assays", "assay"),
        closes("resolved_specimens", "specimen"),
    )
    entries = (
        F.when(action == "censor", F.array(one))
        .when(action.isin("uncensor", "ethics_override"), F.array(close))
        .when(action == "migrate_qc", legacy)
        .when(action == "censor_batch", batch_opens)
        .when(action == "uncensor_batch", batch_closes)
    )
    return log.select(
        "seq",
        F.coalesce("transaction_id", F.lit("txn_recover")).alias("transaction_id"),
        F.explode(entries).alias("_e"),
    ).select("seq", "transaction_id", "_e.*")


def replay_qc_log(
    log: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
    chunk: int = CHUNK,
) -> dict[str, DataFrame]:
    """Events, consent updates and warnings from the log.

    An open entry counts unless its key is already open or its entity is
    missing.  A close entry that names an id opened before it closes that event
    and no other: only the first such entry counts, and only if no close by key
    came between.  Any other close entry closes the open event of its key.
    Batch reversals close every open event of an entity.  The entries and their
    order are each written once, because later steps read them several times.
    """
    frames = {"patient": patients, "specimen": specimens, "assay": assays}
    known = reduce(
        DataFrame.unionByName,
        [
            frames[lv.name].select(F.lit(lv.name).alias("level"), F.col(lv.key).cast("string").alias("entity_id"))
            for lv in schema.levels
        ],
    )
    everything = log_entries(log)
    opening = everything.filter(F.col("op") == "open")
    there = opening.join(known, ["level", "entity_id"], "left_semi").select(*everything.columns)
    entries = cut(there.unionByName(everything.filter(F.col("op") != "open")))
    opens = entries.filter(F.col("op") == "open")
    orphans = opening.join(known, ["level", "entity_id"], "left_anti")

    closes = entries.filter(F.col("op") == "close")
    named = (
        opens.filter(F.col("qc_event_id").isNotNull())
        .groupBy("qc_event_id")
        .agg(F.min("seq").alias("_opened"), F.min_by(F.struct(*ACTIVE_KEY), "seq").alias("_k"))
    )
    with_id = closes.filter(F.col("qc_event_id").isNotNull()).join(named, "qc_event_id", "left")
    late = F.col("_opened") < F.col("seq")
    as_key = with_id.filter(~F.coalesce(late, F.lit(False))).select(*entries.columns)
    first = (
        with_id.filter(late)
        .groupBy("qc_event_id")
        .agg(F.min_by(F.struct(*[c for c in with_id.columns if c != "qc_event_id"]), "seq").alias("_c"))
        .select("qc_event_id", "_c.*")
    )
    by_id = first.select(
        *[(F.col(f"_k.{c}").alias(c) if c in ACTIVE_KEY else F.col(c)) for c in entries.columns], "_opened"
    )
    by_key = closes.filter(F.col("qc_event_id").isNull()).unionByName(as_key)
    opened_kinds = opens.select(*ACTIVE_KEY).distinct()
    all_kinds = (
        entries.filter(F.col("op") == "close_all")
        .drop("kind")
        .join(opened_kinds, ["level", "entity_id"])
        .withColumn("op", F.lit("close"))
        .withColumn("qc_event_id", F.lit("*"))
        .select(*entries.columns)
    )
    never = F.lit(None).cast("bigint").alias("_opened")
    plain = opens.unionByName(by_key).unionByName(all_kinds).select("*", never)
    marked = fold_steps(plain.unionByName(by_id), ACTIVE_KEY, "seq", chunk)
    opens_here = F.col("op") == "open"
    turns = marked.filter(opens_here != F.col("_open"))
    from_batch = F.coalesce(F.col("qc_event_id"), F.lit("")) == "*"
    unmatched = marked.filter(~opens_here & ~F.col("_open") & ~from_batch)
    events = turns.filter(opens_here).select(
        F.coalesce(
            F.col("qc_event_id"),
            event_id(F.col("level"), F.col("entity_id"), F.col("kind"),
                     F.concat_ws(":", "transaction_id", F.col("seq").cast("string"))),
        ).alias("id"),
        "level",
        "entity_id",
        "kind",
        "reason",
        "source",
        F.col("at").alias("created_at"),
        F.col("by").alias("created_by"),
        F.col("_next.at").alias("resolved_at"),
        F.col("_next.by").alias("resolved_by"),
        F.col("_next.reason").alias("resolved_reason"),
        "transaction_id",
    ).select(*EVENT_COLUMNS)
    consent = (
        turns.filter((F.col("level") == "patient") & (F.col("kind") == "consent_revoked"))
        .groupBy(F.col("entity_id").alias("patient_id"))
        .agg(F.max_by(F.struct("op", "withdrawal_date"), "seq").alias("_c"))
        .select(
            "patient_id",
            F.when(F.col("_c.op") == "open", "revoked").otherwise("consented").alias("consent_status"),
            F.when(F.col("_c.op") == "open", F.col("_c.withdrawal_date"))
            .cast("date")
            .alias("withdrawal_date"),
        )
    )
    warnings = orphans.select("seq", *ACTIVE_KEY, F.lit("entity_missing").alias("warning")).unionByName(
        unmatched.select("seq", *ACTIVE_KEY, F.lit("event_not_found").alias("warning"))
    )
    return {"events": events, "consent": consent, "warnings": warnings}


def replay_entities(
    log: DataFrame,
    sources: DataFrame,
    level: str,
    columns: list[str],
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Level rows rebuilt from the log and the files it names.

    ``sources`` holds the rows of all named files, read in one job, with their
    ``results_file``.  Per cell the first non-NULL value in log order wins.
    Rows come from registrations, metadata and migrations; appended results
    fill rows but add none.
    """
    spec = schema.level(level)
    key = spec.key
    wanted = ([spec.parent_key] if spec.parent_key else []) + list(columns)
    entries = log.filter(
        F.col("action").isin("append", "add_metadata", "migrate", "register_cohort")
        & (F.coalesce("level", F.lit(level)) == level)
    ).select("seq", "action", "analysis", "timestamp", "results_file")
    missing = entries.filter(F.col("results_file").isNotNull()).join(
        sources.select("results_file").distinct(), "results_file", "left_anti"
    )
    from_files = sources.join(entries, "results_file")
    done = [c for c in wanted if c.endswith(DONE_SUFFIX)]

    def cell(c: str):
        given = F.col(c) if c in sources.columns else F.lit(None).cast("string")
        if c in done:
            stamp = (F.col("action") == "append") & (F.col("analysis") == c[: -len(DONE_SUFFIX)])
            return F.coalesce(given, F.when(stamp, F.col("timestamp"))).alias(c)
        return given.alias(c)

    file_cells = from_files.select(
        key, "seq", (F.col("action") != "append").alias("_adds"), *[cell(c) for c in wanted]
    )
    registered = log.filter((F.col("action") == "register") & (F.col("level") == level)).select(
        F.col("id").alias(key),
        "seq",
        F.lit(True).alias("_adds"),
        *[
            (F.col("parent") if c == spec.parent_key else F.try_element_at("meta", F.lit(c))).alias(c)
            for c in wanted
        ],
    )
    cells = file_cells.unionByName(registered).filter(F.col(key).isNotNull())
    rows = cells.groupBy(key).agg(
        F.max("_adds").alias("_adds"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in wanted],
    )
    return {"rows": rows.filter("_adds").drop("_adds"), "missing_sources": missing}

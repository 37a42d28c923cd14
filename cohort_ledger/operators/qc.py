"""QC events, derived status and consent.

Status is always derived set-wise: one hash aggregate over the active events
(an integer ``max``, combined before the shuffle) and one left join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_ledger.functions.qc import (
    ethics_reason_ok,
    event_id,
    flag_value,
    kind_severity,
    severity_status,
)
from cohort_ledger.model import (
    CONSENT_REVOKED,
    CONSENT_STATUSES,
    DEFAULT_SCHEMA,
    EVENT_COLUMNS,
    QC_EVENT_SCHEMA,
    CohortSchema,
)

ACTIVE_KEY = ["level", "entity_id", "kind"]


def active_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("resolved_at").isNull())


def derive_status(events: DataFrame, level: str | None = None) -> DataFrame:
    """Status per entity with an active event: the most severe active kind.

    Of one level, rows are grouped by the entity alone: that it is unique is then
    seen by Spark, which leaves out joins whose status nobody reads.
    """
    current = active_events(events)
    if level is not None:
        current = current.filter(F.col("level") == level)
    severity = kind_severity(F.col("kind"), F.col("level"))
    by = ["level", "entity_id"] if level is None else ["entity_id"]
    named = F.col("level") if level is None else F.lit(level).alias("level")
    return (
        current.groupBy(*by)
        .agg(F.max(severity).alias("severity"))
        .select(named, "entity_id", severity_status(F.col("severity")).alias("qc_status"))
    )


def recompute_status(
    rows: DataFrame, events: DataFrame, level: str, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """The level table with ``qc_status`` replaced by the derived status."""
    key = schema.key(level)
    derived = derive_status(events, level).select(
        F.col("entity_id").alias(key), F.col("qc_status").alias("_derived")
    )
    others = [F.col(c) for c in rows.columns if c != "qc_status"]
    return rows.join(derived, key, "left").select(
        *others, F.coalesce(F.col("_derived"), F.lit("pass")).alias("qc_status")
    )


def with_derived_status(rows: DataFrame, key: Column, events: DataFrame, level: str) -> DataFrame:
    """The rows of entities that have a derived status, with it as ``qc_status``; few beside all.

    ``key`` makes the entity of a row of its columns.  It is worked out where it is compared,
    first by its hash, and is no column of the rows that are dealt out.
    """
    derived = derive_status(events, level).select(F.col("entity_id").alias("_entity"), "qc_status")
    same = (F.xxhash64(key) == F.xxhash64("_entity")) & (key == F.col("_entity"))
    return rows.join(derived, same).select(*rows.columns, "qc_status")


def validate_kinds(events: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Events with the first broken rule in ``reject``; NULL means accepted."""
    level, kind = F.col("level"), F.col("kind")
    known_level = level.isin([lv.name for lv in schema.levels])
    allowed: Column = F.lit(True)
    for name, levels in schema.kind_levels.items():
        allowed = F.when(kind == name, level.isin(list(levels))).otherwise(allowed)
    return events.withColumn(
        "reject",
        F.when(kind.isNull() | ~kind.isin(list(schema.kinds)), "unknown_kind")
        .when(level.isNull() | ~allowed, "kind_not_allowed_at_level")
        .when(~known_level, "unknown_level"),
    )


def _entities(
    patients: DataFrame, specimens: DataFrame, assays: DataFrame, schema: CohortSchema
) -> DataFrame:
    frames = {"patient": patients, "specimen": specimens, "assay": assays}
    parts = [
        frames[lv.name].select(F.lit(lv.name).alias("level"), F.col(lv.key).alias("entity_id"))
        for lv in schema.levels
        if frames.get(lv.name) is not None
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def new_events(
    flags: DataFrame,
    as_of,
    transaction_id: str,
    created_by: str = "unknown",
    source: str = "manual",
) -> DataFrame:
    """Turn ``(level, entity_id, kind, reason)`` rows into full event rows."""
    given = {c: F.col(c) for c in flags.columns}
    txn = given.get("transaction_id", F.lit(transaction_id))
    values = {
        "id": event_id(F.col("level"), F.col("entity_id"), F.col("kind"), txn),
        "level": F.col("level"),
        "entity_id": F.col("entity_id"),
        "kind": F.col("kind"),
        "reason": F.col("reason"),
        "source": given.get("source", F.lit(source)),
        "created_at": given.get("created_at", F.lit(as_of).cast("timestamp")),
        "created_by": given.get("created_by", F.lit(created_by)),
        "transaction_id": txn,
    }
    return flags.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in QC_EVENT_SCHEMA.fields
        ]
    )


def dedupe_active(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates that would not be a second active event of the same kind.

    Twins inside the batch collapse to the smallest (reason, id): ``min_by`` is
    combined before the shuffle, so a heavily repeated key costs one row per
    task.
    """
    rest = [c for c in candidates.columns if c not in ACTIVE_KEY]
    order = [c for c in ("reason", "id") if c in rest] or rest
    one_each = (
        candidates.groupBy(*ACTIVE_KEY)
        .agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row"))
        .select(*ACTIVE_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*candidates.columns)
    )
    taken = active_events(events).select(*ACTIVE_KEY).distinct()
    return one_each.join(taken, ACTIVE_KEY, "left_anti")


def censor_rejects(
    rows: DataFrame,
    events: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Every row of a bulk censor request with its reason for refusal, or NULL."""
    known = _entities(patients, specimens, assays, schema).withColumn("_known", F.lit(True))
    taken = active_events(events).select(*ACTIVE_KEY).distinct().withColumn("_taken", F.lit(True))
    repeats = rows.groupBy(*ACTIVE_KEY).agg(F.count(F.lit(1)).alias("_copies"))
    checked = (
        validate_kinds(rows, schema)
        .join(known, ["level", "entity_id"], "left")
        .join(taken, ACTIVE_KEY, "left")
        .join(repeats, ACTIVE_KEY, "left")
    )
    reason = (
        F.when(F.col("reject").isNotNull(), F.col("reject"))
        .when(F.col("_known").isNull(), "unknown_entity")
        .when(F.col("_taken").isNotNull(), "already_active")
        .when(F.col("_copies") > 1, "repeated_in_batch")
    )
    return checked.select(*rows.columns, reason.alias("reject"))


def bulk_censor(
    rows: DataFrame,
    events: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    as_of,
    transaction_id: str,
    created_by: str = "unknown",
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Apply a bulk censor request as one transaction.

    One bad row refuses the whole request: a scalar subquery with the number of
    rejects decides, so nothing is collected while the plan is built.
    Revoking consent at patient level also sets the consent columns.
    """
    checked = censor_rejects(rows, events, patients, specimens, assays, schema)
    rejects = checked.filter(F.col("reject").isNotNull())
    n_bad = rejects.agg(F.count(F.lit(1))).scalar()
    accepted = new_events(
        checked.drop("reject"), as_of, transaction_id, created_by
    ).filter(n_bad == 0)
    all_events = events.select(*EVENT_COLUMNS).unionByName(accepted)
    withdrawn = (
        accepted.filter((F.col("kind") == "consent_revoked") & (F.col("level") == "patient"))
        .select(
            F.col("entity_id").alias("patient_id"),
            F.lit("revoked").alias("consent_status"),
            F.to_date(F.lit(as_of).cast("timestamp")).alias("withdrawal_date"),
        )
    )
    patients_out, _ = apply_consent(patients, withdrawn)
    return {
        "events": all_events,
        "new_events": accepted,
        "rejects": rejects,
        "patients": recompute_status(patients_out, all_events, "patient", schema),
        "specimens": recompute_status(specimens, all_events, "specimen", schema),
        "assays": recompute_status(assays, all_events, "assay", schema),
    }


def resolve_events(
    events: DataFrame,
    resolutions: DataFrame,
    as_of,
    resolved_by: str = "unknown",
) -> dict[str, DataFrame]:
    """Close active events named by ``id``, or by their entity.

    ``resolutions`` has ``id`` (may be NULL), ``level``, ``entity_id``,
    ``reason``.  Naming an entity needs exactly one active event there;
    anything else is rejected.
    """
    current = active_events(events)
    by_id = resolutions.filter(F.col("id").isNotNull())
    by_entity = resolutions.filter(F.col("id").isNull()).select(
        "level", "entity_id", "reason"
    )
    per_entity = current.groupBy("level", "entity_id").agg(
        F.count(F.lit(1)).alias("n_active"), F.min("id").alias("_only")
    )
    matched = by_entity.join(per_entity, ["level", "entity_id"], "left")
    named = by_id.select("id", "reason").unionByName(
        matched.filter(F.col("n_active") == 1).select(F.col("_only").alias("id"), "reason")
    )
    named = named.groupBy("id").agg(F.min("reason").alias("_reason"))
    entity_rejects = matched.filter(F.coalesce("n_active", F.lit(0)) != 1).select(
        F.lit(None).cast("string").alias("id"),
        "level",
        "entity_id",
        F.when(F.col("n_active").isNull(), "no_active_event")
        .otherwise("ambiguous")
        .alias("reject"),
    )
    id_rejects = (
        by_id.join(current.select("id"), "id", "left_anti")
        .select("id", "level", "entity_id", F.lit("not_active").alias("reject"))
    )
    stamp = F.lit(as_of).cast("timestamp")
    closes = F.col("_reason").isNotNull() & F.col("resolved_at").isNull()
    joined = events.join(named, "id", "left")
    closed = {
        "resolved_at": F.when(closes, stamp).otherwise(F.col("resolved_at")),
        "resolved_by": F.when(closes, F.lit(resolved_by)).otherwise(F.col("resolved_by")),
        "resolved_reason": F.when(closes, F.col("_reason")).otherwise(F.col("resolved_reason")),
    }
    return {
        "events": joined.select(*[closed.get(c, F.col(c)).alias(c) for c in events.columns]),
        "rejects": entity_rejects.unionByName(id_rejects),
    }


def append_resolved(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Load events that are already closed; the one-active rule does not apply."""
    return events.select(*EVENT_COLUMNS).unionByName(
        resolved.filter(F.col("resolved_at").isNotNull()).select(*EVENT_COLUMNS)
    )


def uncensor(
    events: DataFrame,
    resolutions: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    as_of,
    resolved_by: str = "unknown",
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Resolve events and recompute; reversing a revocation restores consent.

    A consent reversal must pass the ethics gate, or it is rejected.
    """
    keyed = resolutions.filter(F.col("id").isNotNull()).join(
        events.select("id", F.col("kind").alias("_kind")), "id", "left"
    )
    barred = keyed.filter(
        (F.col("_kind") == "consent_revoked") & ~ethics_reason_ok(F.col("reason"))
    )
    single = active_events(events).groupBy("level", "entity_id").agg(F.max("kind").alias("_kind"))
    barred_entities = (
        resolutions.filter(F.col("id").isNull())
        .join(single, ["level", "entity_id"])
        .filter((F.col("_kind") == "consent_revoked") & ~ethics_reason_ok(F.col("reason")))
        .select("level", "entity_id")
    )
    allowed_by_id = resolutions.filter(F.col("id").isNotNull()).join(
        barred.select("id"), "id", "left_anti"
    )
    allowed_by_entity = resolutions.filter(F.col("id").isNull()).join(
        barred_entities, ["level", "entity_id"], "left_anti"
    )
    allowed = allowed_by_id.unionByName(allowed_by_entity)
    out = resolve_events(events, allowed, as_of, resolved_by)
    was = active_events(events).filter(
        (F.col("kind") == "consent_revoked") & (F.col("level") == "patient")
    )
    reversed_ = (
        was.select("id", "entity_id")
        .join(active_events(out["events"]).select("id"), "id", "left_anti")
        .select(F.col("entity_id").alias("patient_id"))
        .distinct()
        .select(
            "patient_id",
            F.lit("consented").alias("consent_status"),
            F.lit(None).cast("date").alias("withdrawal_date"),
        )
    )
    patients_out, _ = apply_consent(patients, reversed_)
    refused = barred.select("id", "level", "entity_id").unionByName(
        barred_entities.select(F.lit(None).cast("string").alias("id"), "level", "entity_id")
    )
    return {
        "events": out["events"],
        "rejects": out["rejects"].unionByName(
            refused.withColumn("reject", F.lit("ethics_reason_required"))
        ),
        "patients": recompute_status(patients_out, out["events"], "patient", schema),
        "specimens": recompute_status(specimens, out["events"], "specimen", schema),
        "assays": recompute_status(assays, out["events"], "assay", schema),
    }


def apply_consent(patients: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set consent columns; rows that break the withdrawal-date rule are rejected.

    A withdrawal date is present exactly for the revoked family.  ``updates``
    has one row per ``patient_id`` with ``consent_status``, ``withdrawal_date``
    and optionally ``consent_date``.
    """
    status, date = F.col("consent_status"), F.col("withdrawal_date")
    family = status.isin(*CONSENT_REVOKED)
    checked = updates.withColumn(
        "reject",
        F.when(status.isNull() | ~status.isin(*CONSENT_STATUSES), "unknown_consent_status")
        .when(family & date.isNull(), "withdrawal_date_required")
        .when(~family & date.isNotNull(), "withdrawal_date_not_allowed"),
    )
    good = checked.filter(F.col("reject").isNull()).select(
        "patient_id",
        F.col("consent_status").alias("_status"),
        F.col("withdrawal_date").alias("_withdrawal"),
        (F.col("consent_date") if "consent_date" in updates.columns else F.lit(None).cast("date"))
        .alias("_consent"),
    )
    hit = F.col("_status").isNotNull()
    new = {
        "consent_status": F.coalesce("_status", "consent_status"),
        "withdrawal_date": F.when(hit, F.col("_withdrawal")).otherwise(F.col("withdrawal_date")),
    }
    if "consent_date" in patients.columns:
        new["consent_date"] = F.coalesce("_consent", "consent_date")
    joined = patients.join(good, "patient_id", "left")
    columns = [new.get(c, F.col(c)).alias(c) for c in patients.columns]
    return joined.select(*columns), checked.filter(F.col("reject").isNotNull())


def consent_violations(patients: DataFrame, events: DataFrame) -> DataFrame:
    """Patients whose consent columns contradict the events or each other."""
    revoked_events = active_events(events).filter(
        (F.col("level") == "patient") & (F.col("kind") == "consent_revoked")
    ).select(F.col("entity_id").alias("patient_id")).distinct()
    missing_event = (
        patients.filter(F.col("consent_status") == "revoked")
        .join(revoked_events, "patient_id", "left_anti")
        .select(F.lit("missing_consent_revoked_event").alias("violation"), "patient_id")
    )
    family = F.coalesce(F.col("consent_status").isin(*CONSENT_REVOKED), F.lit(False))
    dated = F.col("withdrawal_date").isNotNull()
    dates = (
        patients.select(
            F.when(family & ~dated, "missing_withdrawal_date")
            .when(~family & dated, "spurious_withdrawal_date")
            .alias("violation"),
            "patient_id",
        ).filter(F.col("violation").isNotNull())
    )
    return missing_event.unionByName(dates)


def ethics_gate(rows: DataFrame) -> DataFrame:
    """Consent reversals with ``allowed`` set from their reason text."""
    return rows.withColumn("allowed", ethics_reason_ok(F.col("reason")))


def qc_history(
    events: DataFrame,
    level: str | None = None,
    entity_id: str | None = None,
    include_resolved: bool = True,
) -> DataFrame:
    """Events of one entity, or all active events, by id."""
    if level is not None:
        events = events.filter(F.col("level") == level)
    if entity_id is not None:
        events = events.filter(F.col("entity_id") == entity_id)
    if not include_resolved or (level is None and entity_id is None):
        events = active_events(events)
    return events.orderBy("id")


def qc_event_summary(events: DataFrame) -> DataFrame:
    """Active events in the three dashboard buckets, with their total."""
    kind = F.col("kind")
    return active_events(events).agg(
        F.count_if(kind == "qc_fail").alias("fail"),
        F.count_if(kind == "qc_warn").alias("warn"),
        F.count_if(~kind.isin("qc_fail", "qc_warn")).alias("censored"),
        F.count(F.lit(1)).alias("total"),
    )


def autoflag_extract(results: DataFrame, key: str, source: str = "slurm") -> DataFrame:
    """Pass/fail columns of a result file as ``(entity_id, action, reason)`` rows."""
    has = set(results.columns)
    no = F.lit(False)
    failed = F.coalesce(~flag_value(results, "qc_pass"), no) if "qc_pass" in has else no
    warned = F.coalesce(flag_value(results, "qc_warn"), no) if "qc_warn" in has else no
    text = (
        F.nullif(F.trim(F.col("qc_fail_reason").cast("string"), F.lit(" \t\r\n")), F.lit(""))
        if "qc_fail_reason" in has
        else F.lit(None).cast("string")
    )
    action = F.when(failed, "fail").when(warned, "warn")
    # Default reasons.
    default = F.when(failed, f"{source}: qc_pass=False").otherwise(f"{source}: qc_warn=True")
    return results.select(
        F.col(key).cast("string").alias("entity_id"),
        action.alias("action"),
        F.coalesce(text, default).alias("reason"),
    ).filter(F.col("action").isNotNull())


def autoflag_apply(
    flags: DataFrame,
    level: str,
    rows: DataFrame,
    events: DataFrame,
    as_of,
    transaction_id: str,
    created_by: str = "slurm:unknown",
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Write flags as events, skipping unknown entities and active twins."""
    key = schema.key(level)
    candidates = flags.select(
        F.lit(level).alias("level"),
        "entity_id",
        F.when(F.col("action") == "fail", "qc_fail").otherwise("qc_warn").alias("kind"),
        "reason",
    ).join(rows.select(F.col(key).alias("entity_id")), "entity_id", "left_semi")
    added = new_events(
        dedupe_active(candidates, events), as_of, transaction_id, created_by, "slurm"
    )
    all_events = events.select(*EVENT_COLUMNS).unionByName(added)
    return {
        "new_events": added,
        "events": all_events,
        "rows": recompute_status(rows, all_events, level, schema),
    }


def _batch_hits(
    batch_rows: DataFrame, assays: DataFrame, assay_sources: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch assays, and the merged assays and specimens one hop downstream."""
    own = assays.select("assay_id", "batch_id").join(batch_rows, "batch_id")
    downstream = assay_sources.join(
        own.withColumnRenamed("assay_id", "source_assay_id"), "source_assay_id"
    )
    merged = downstream.filter(F.col("merged_assay_id").isNotNull())
    consumers = downstream.filter(F.col("consumer_specimen_id").isNotNull())
    return own, merged, consumers


def censor_batch(
    batches: DataFrame,
    assays: DataFrame,
    specimens: DataFrame,
    assay_sources: DataFrame,
    events: DataFrame,
    as_of,
    transaction_id: str,
    created_by: str = "unknown",
    source: str = "manual",
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Fail whole batches (``batch_id`` and optional ``reason``) and one hop on.

    Batch assays and the assays merged from them fail; specimens that consume
    them get a warning.  Entities with an active twin event are left alone.
    """
    given = F.col("reason") if "reason" in batches.columns else F.lit(None).cast("string")
    default = F.concat(F.lit("batch '"), F.col("batch_id"), F.lit("' censored"))
    requests = batches.select("batch_id", F.coalesce(given, default).alias("reason"))
    own, merged, consumers = _batch_hits(requests, assays, assay_sources)
    via = F.concat(F.lit("source assay in batch '"), F.col("batch_id"), F.lit("' censored"))

    def flag(frame, entity, level, kind, reason, origin):
        return frame.select(
            F.lit(level).alias("level"),
            F.col(entity).alias("entity_id"),
            F.lit(kind).alias("kind"),
            reason.alias("reason"),
            F.lit(origin).alias("_origin"),
        )

    candidates = (
        flag(own, "assay_id", "assay", "qc_fail", F.col("reason"), 0)
        .unionByName(flag(merged, "merged_assay_id", "assay", "qc_fail", via, 1))
        .unionByName(flag(consumers, "consumer_specimen_id", "specimen", "qc_warn", via, 2))
    )
    # A batch assay that is also a merged target counts as a batch assay.
    first = (
        candidates.groupBy(*ACTIVE_KEY)
        .agg(F.min(F.struct("_origin", "reason")).alias("_row"))
        .select(*ACTIVE_KEY, "_row._origin", "_row.reason")
        .join(active_events(events).select(*ACTIVE_KEY).distinct(), ACTIVE_KEY, "left_anti")
    )
    added = new_events(first.drop("_origin"), as_of, transaction_id, created_by, source)
    all_events = events.select(*EVENT_COLUMNS).unionByName(added)
    counts = first.agg(
        F.count_if(F.col("_origin") == 0).alias("censored_assays"),
        F.count_if(F.col("_origin") == 2).alias("warned_specimens"),
        F.count_if(F.col("_origin") == 1).alias("censored_derived_assays"),
    )
    return {
        "new_events": added,
        "events": all_events,
        "counts": counts,
        "assays": recompute_status(assays, all_events, "assay", schema),
        "specimens": recompute_status(specimens, all_events, "specimen", schema),
    }


def uncensor_batch(
    batches: DataFrame,
    assays: DataFrame,
    specimens: DataFrame,
    assay_sources: DataFrame,
    events: DataFrame,
    as_of,
    resolved_by: str = "unknown",
    only_batch_events: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Resolve every active event on the batch assays and one hop downstream.

    ``only_batch_events`` limits this to events whose reason is a batch censor.
    """
    given = F.col("reason") if "reason" in batches.columns else F.lit(None).cast("string")
    default = F.concat(F.lit("batch '"), F.col("batch_id"), F.lit("' uncensored"))
    requests = batches.select("batch_id", F.coalesce(given, default).alias("reason"))
    own, merged, consumers = _batch_hits(requests, assays, assay_sources)

    def target(frame, entity, level):
        return frame.select(
            F.lit(level).alias("level"), F.col(entity).alias("entity_id"), "reason"
        )

    targets = (
        target(own, "assay_id", "assay")
        .unionByName(target(merged, "merged_assay_id", "assay"))
        .unionByName(target(consumers, "consumer_specimen_id", "specimen"))
        .groupBy("level", "entity_id")
        .agg(F.min("reason").alias("_reason"))
    )
    joined = events.join(targets, ["level", "entity_id"], "left")
    closes = F.col("_reason").isNotNull() & F.col("resolved_at").isNull()
    if only_batch_events:
        closes = closes & F.col("reason").rlike(r"\A(source assay in )?batch '.*' censored\z")
    new = {
        "resolved_at": F.when(closes, F.lit(as_of).cast("timestamp")).otherwise(
            F.col("resolved_at")
        ),
        "resolved_by": F.when(closes, F.lit(resolved_by)).otherwise(F.col("resolved_by")),
        "resolved_reason": F.when(closes, F.col("_reason")).otherwise(F.col("resolved_reason")),
    }
    out = joined.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])
    return {
        "events": out,
        "resolved": joined.filter(closes).select("id", "level", "entity_id"),
        "assays": recompute_status(assays, out, "assay", schema),
        "specimens": recompute_status(specimens, out, "specimen", schema),
    }

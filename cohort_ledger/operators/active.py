"""The usability cascade and the filters built on it.

The cascade is resolved from the coarse end: patients (small) are filtered and
joined to specimens first, so the large assays table is shuffled once, on
``specimen_id``, against keys that already passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_ledger.functions.qc import consent_usable, qc_usable
from cohort_ledger.model import CONSENT_USABLE, DEFAULT_SCHEMA, DONE_SUFFIX, CohortSchema


def active_patients(
    patients: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
) -> DataFrame:
    """Patients whose own QC status and consent allow use."""
    return patients.filter(
        qc_usable(F.col("qc_status"), include_censored)
        & consent_usable(F.col("consent_status"), include_consent_revoked)
    )


def active_specimens(
    patients: DataFrame,
    specimens: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Specimens that pass their own test and belong to an active patient."""
    key = schema.level("specimen").parent_key
    usable = active_patients(patients, include_censored, include_consent_revoked)
    return specimens.filter(qc_usable(F.col("qc_status"), include_censored)).join(
        usable.select(F.col(schema.key("patient")).alias(key)), key, "left_semi"
    )


def active_assays(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Assays that pass their own test and belong to an active specimen."""
    key = schema.level("assay").parent_key
    usable = active_specimens(
        patients, specimens, include_censored, include_consent_revoked, schema
    )
    return assays.filter(qc_usable(F.col("qc_status"), include_censored)).join(
        usable.select(F.col(schema.key("specimen")).alias(key)), key, "left_semi"
    )


def active_level(
    level: str,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """The active rows of one level by name."""
    if level == "patient":
        return active_patients(patients, include_censored, include_consent_revoked)
    if level == "specimen":
        return active_specimens(
            patients, specimens, include_censored, include_consent_revoked, schema
        )
    return active_assays(
        patients, specimens, assays, include_censored, include_consent_revoked, schema
    )


def exclusion_breakdown(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Excluded ids in long form ``(reason, level, id)``.

    Each reason looks at one cause only, so an assay may appear twice and the
    reasons need not add up to the number of excluded assays.
    """
    patient, specimen, assay = (schema.key(x) for x in ("patient", "specimen", "assay"))

    def rows(frame: DataFrame, reason, level: str, key: str) -> DataFrame:
        return frame.select(
            (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
            F.lit(level).alias("level"),
            F.col(key).alias("id"),
        )

    own = assays.filter(F.col("qc_status").isin("fail", "censored"))
    own_reason = F.when(F.col("qc_status") == "fail", "qc_failed_assay").otherwise(
        "censored_assay"
    )
    refused = patients.filter(~F.col("consent_status").isin(*CONSENT_USABLE)).select(patient)
    refused_specimens = specimens.join(
        refused.withColumnRenamed(patient, schema.level("specimen").parent_key),
        schema.level("specimen").parent_key,
        "left_semi",
    ).select(F.col(specimen).alias(schema.level("assay").parent_key))
    under = assays.join(refused_specimens, schema.level("assay").parent_key, "left_semi")
    return (
        rows(own, own_reason, "assay", assay)
        .unionByName(rows(refused, "consent_revoked_patient", "patient", patient))
        .unionByName(rows(under, "consent_revoked_assay", "assay", assay))
    )


def exclusion_reason(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """One first cause per excluded assay; unlike the breakdown it adds up."""
    joined = _statuses(patients, specimens, assays, schema)
    reason = (
        F.when(~F.coalesce(qc_usable(F.col("assay_status")), F.lit(False)), "assay_qc")
        .when(~F.coalesce(qc_usable(F.col("specimen_status")), F.lit(False)), "specimen_qc")
        .when(~F.coalesce(qc_usable(F.col("patient_status")), F.lit(False)), "patient_qc")
        .when(~F.coalesce(consent_usable(F.col("consent")), F.lit(False)), "consent")
    )
    return (
        joined.select(schema.key("assay"), reason.alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


def _statuses(patients, specimens, assays, schema) -> DataFrame:
    p_key = schema.level("specimen").parent_key
    s_key = schema.level("assay").parent_key
    above = specimens.select(
        F.col(schema.key("specimen")).alias(s_key),
        F.col(p_key),
        F.col("qc_status").alias("specimen_status"),
    ).join(
        patients.select(
            F.col(schema.key("patient")).alias(p_key),
            F.col("qc_status").alias("patient_status"),
            F.col("consent_status").alias("consent"),
        ),
        p_key,
    )
    return assays.select(
        schema.key("assay"), s_key, F.col("qc_status").alias("assay_status")
    ).join(above, s_key)


def rerun_missing(
    analysis: str,
    level: str,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    force_censored: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Keys at ``level`` still missing an analysis, in key order.

    Only the assay level is limited to active rows; a level without the done
    column is missing throughout.
    """
    frame = {"patient": patients, "specimen": specimens, "assay": assays}[level]
    if level == "assay" and not force_censored:
        frame = active_assays(patients, specimens, assays, schema=schema)
    done = f"{analysis}{DONE_SUFFIX}"
    if done in frame.columns:
        frame = frame.filter(F.col(done).isNull())
    key = schema.key(level)
    return frame.select(key).orderBy(key)


def rerun_missing_flat(manifest: DataFrame, analysis: str, key: str = "sample_id") -> DataFrame:
    """Flat-manifest form: ids without the done stamp."""
    done = f"{analysis}{DONE_SUFFIX}"
    frame = manifest.filter(F.col(done).isNull()) if done in manifest.columns else manifest
    return frame.select(key).orderBy(key)


def rerun_with_sources(
    missing: DataFrame,
    level: str,
    assay_sources: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Distinct source assays that feed the missing keys of a level."""
    if level == "specimen":
        target = "consumer_specimen_id"
    elif level == "assay":
        target = "merged_assay_id"
    else:
        return assay_sources.select("source_assay_id").limit(0)
    keys = missing.select(F.col(schema.key(level)).alias(target))
    return (
        assay_sources.filter(F.col(target).isNotNull())
        .join(keys, target, "left_semi")
        .select("source_assay_id")
        .distinct()
    )


def pending_work(
    analysis: str,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Assays ready for an analysis: everything above passes, and it is not done."""
    p_key = schema.level("specimen").parent_key
    s_key = schema.level("assay").parent_key
    ready = assays.filter((F.col("qc_status") == "pass") & F.col(analysis + DONE_SUFFIX).isNull())
    above = specimens.select(F.col(schema.key("specimen")).alias(s_key), p_key).join(
        patients.select(F.col(schema.key("patient")).alias(p_key)), p_key, "left_semi"
    )
    return ready.select(schema.key("assay"), s_key).join(above, s_key)


def log_filter(
    log: DataFrame,
    level: str | None = None,
    transaction_id: str | None = None,
    last: int | None = None,
) -> DataFrame:
    """Log rows by level or transaction in time order; ``last`` keeps the newest."""
    if level is not None:
        log = log.filter(F.col("level") == level)
    if transaction_id is not None:
        log = log.filter(F.col("transaction_id") == transaction_id)
    ties = [F.col("seq")] if "seq" in log.columns else []
    if last is not None:
        newest = [F.col("timestamp").desc_nulls_last()] + [c.desc() for c in ties]
        log = log.orderBy(*newest).limit(last)
    return log.orderBy(F.col("timestamp"), *ties)


def project_filter(projects: DataFrame, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """Projects in one of the given lifecycle states; a missing state is active."""
    return projects.filter(F.coalesce(F.col("status"), F.lit("active")).isin(*statuses))

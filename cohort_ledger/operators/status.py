"""Completion, cohort and dashboard summaries.

All analyses of a level are counted in one aggregate; unpivoting happens on the
aggregated row, never on the entities (except where one row per entity and
analysis *is* the result).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohort_ledger.functions.qc import status_severity
from cohort_ledger.model import DEFAULT_SCHEMA, DONE_SUFFIX, CohortSchema
from cohort_ledger.operators.active import (
    active_assays,
    active_level,
    active_patients,
    exclusion_breakdown,
)
from cohort_ledger.operators.rank import exact_middle, histogram
from cohort_ledger.operators.views import rollup_join


def done_columns(frame: DataFrame) -> list[str]:
    return sorted(c for c in frame.columns if c.endswith(DONE_SUFFIX))


def analyses_of(frame: DataFrame) -> list[str]:
    return [c[: -len(DONE_SUFFIX)] for c in done_columns(frame)]


def unpivot_counts(row: DataFrame, names: list[str], fields: dict[str, callable], keep=()) -> DataFrame:
    """One output row per name from columns of an aggregated row."""
    items = [
        F.struct(F.lit(n).alias("analysis"), *[make(n).alias(f) for f, make in fields.items()])
        for n in names
    ]
    return row.select(*keep, F.explode(F.array(*items)).alias("_i")).select(*keep, "_i.*")


def percent(done, total):
    """Unrounded percentage, 0 for an empty total."""
    return F.when(total > 0, 100.0 * done / total).otherwise(F.lit(0.0))


def completion_counts(frame: DataFrame) -> DataFrame:
    """``(analysis, done, total, pct)`` over every done column of a frame."""
    names = analyses_of(frame)
    if not names:
        return frame.sparkSession.createDataFrame(
            [], "analysis string, done bigint, total bigint, pct double"
        )
    row = frame.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count(n + DONE_SUFFIX).alias(n) for n in names]
    )
    return unpivot_counts(
        row,
        names,
        {
            "done": F.col,
            "total": lambda n: F.col("_total"),
            "pct": lambda n: percent(F.col(n), F.col("_total")),
        },
    )


def status_by_analysis(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Completion of each analysis per level, over the active rows."""
    out = None
    for level in schema.levels:
        rows = active_level(
            level.name, patients, specimens, assays,
            include_censored, include_consent_revoked, schema,
        )
        part = completion_counts(rows).select(F.lit(level.name).alias("level"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def status_counts(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Active and total entities per level."""
    frames = {"patient": patients, "specimen": specimens, "assay": assays}
    out = None
    for level in schema.levels:
        usable = active_level(
            level.name, patients, specimens, assays,
            include_censored, include_consent_revoked, schema,
        )
        part = (
            frames[level.name]
            .agg(F.count(F.lit(1)).alias("total"), F.lit(0).cast("bigint").alias("active"))
            .unionByName(
                usable.agg(
                    F.lit(0).cast("bigint").alias("total"), F.count(F.lit(1)).alias("active")
                )
            )
            .agg(F.sum("active").alias("active"), F.sum("total").alias("total"))
            .select(F.lit(level.name).alias("level"), "active", "total")
        )
        out = part if out is None else out.unionByName(part)
    return out


def status_by_row(frame: DataFrame, level: str, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Per entity: the done analyses as an array, and how many of how many."""
    names = analyses_of(frame)
    done = F.array_compact(
        F.array(*[F.when(F.col(n + DONE_SUFFIX).isNotNull(), F.lit(n)) for n in names])
    ) if names else F.array().cast("array<string>")
    return frame.select(
        schema.key(level),
        done.alias("analyses_done"),
        F.size(done).alias("n_done"),
        F.lit(len(names)).alias("n_total"),
    )


def status_by_specimen(patients, specimens, assays, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Assays and done counts per specimen, without any QC filter."""
    return rollup_join(patients, specimens, assays, "specimen", done_columns(assays), schema)


def status_by_patient(patients, specimens, assays, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Specimens, assays and done counts per patient, without any QC filter."""
    return rollup_join(patients, specimens, assays, "patient", done_columns(assays), schema)


def status_usable(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    analysis: str | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Usable and excluded assays with exclusion counts, as ``(metric, value)``."""
    usable = active_assays(patients, specimens, assays, schema=schema)
    done = F.lit(None).cast("bigint")
    column = f"{analysis}{DONE_SUFFIX}"
    if analysis and column in assays.columns:
        done = F.count(column)
    counted = usable.agg(F.count(F.lit(1)).alias("usable"), done.alias("complete"))
    metrics = counted.select(
        F.explode(
            F.array(
                F.struct(F.lit("usable").alias("metric"), F.col("usable").alias("value")),
                F.struct(F.lit("complete").alias("metric"), F.col("complete").alias("value")),
                F.struct(
                    F.lit("pending").alias("metric"),
                    (F.col("usable") - F.col("complete")).alias("value"),
                ),
                F.struct(F.lit("excluded").alias("metric"), (-F.col("usable")).alias("value")),
            )
        ).alias("_m")
    ).select("_m.*").filter(F.col("value").isNotNull())
    totals = assays.agg(F.count(F.lit(1)).alias("value"))
    metrics = (
        metrics.unionByName(totals.select(F.lit("total").alias("metric"), "value"))
        .unionByName(totals.select(F.lit("excluded").alias("metric"), "value"))
    )
    reasons = (
        exclusion_breakdown(patients, specimens, assays, schema)
        .groupBy(F.col("reason").alias("metric"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return metrics.unionByName(reasons).groupBy("metric").agg(F.sum("value").alias("value"))


def status_flat(manifest: DataFrame, analysis: str | None = None) -> DataFrame:
    """Completion of each analysis of a flat manifest."""
    counts = completion_counts(manifest).withColumnRenamed("done", "completed")
    return counts.filter(F.col("analysis") == analysis) if analysis else counts


def status_flat_missing(
    manifest: DataFrame, key: str = "sample_id", analysis: str | None = None
) -> DataFrame:
    """The missing ids as rows ``(analysis, id)`` in order."""
    names = [n for n in analyses_of(manifest) if analysis in (None, n)]
    if not names:
        return manifest.select(F.lit("").alias("analysis"), F.col(key)).limit(0)
    absent = F.array_compact(
        F.array(*[F.when(F.col(n + DONE_SUFFIX).isNull(), F.lit(n)) for n in names])
    )
    return manifest.select(F.explode(absent).alias("analysis"), key).orderBy("analysis", key)


def project_summary(
    manifests: DataFrame, project: str = "project", columns: str = "manifest_columns"
) -> DataFrame:
    """Per project: samples, analyses, completed cells, all cells and percentage.

    ``manifests`` is a union by name.  If it carries the array of each
    manifest's own columns, that decides which analyses a project has; else
    an analysis counts where it has at least one value.
    """
    names = analyses_of(manifests)
    has_columns = columns in manifests.columns

    def present(n):
        if has_columns:
            return F.max(F.array_contains(columns, n + DONE_SUFFIX))
        return F.count(n + DONE_SUFFIX) > 0

    row = manifests.groupBy(project).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.count(n + DONE_SUFFIX).alias(f"_d{i}") for i, n in enumerate(names)],
        *[present(n).cast("bigint").alias(f"_p{i}") for i, n in enumerate(names)],
    )
    zero = F.lit(0).cast("bigint")
    completed = sum((F.col(f"_d{i}") for i in range(len(names))), zero)
    n_analyses = sum((F.col(f"_p{i}") for i in range(len(names))), zero)
    out = row.select(
        project,
        "n_samples",
        n_analyses.alias("n_analyses"),
        completed.alias("completed_cells"),
        (n_analyses * F.col("n_samples")).alias("total_cells"),
    )
    return out.withColumn("pct", percent(F.col("completed_cells"), F.col("total_cells")))


def project_level_summary(patients: DataFrame, specimens: DataFrame, assays: DataFrame) -> DataFrame:
    """Level counts per project over tables unioned with a ``project`` column."""
    parts = [
        frame.groupBy("project").agg(
            *[
                (F.count(F.lit(1)) if name == own else F.lit(0).cast("bigint")).alias(name)
                for name in ("n_patients", "n_specimens", "n_assays")
            ]
        )
        for frame, own in (
            (patients, "n_patients"), (specimens, "n_specimens"), (assays, "n_assays"),
        )
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("project").agg(
        *[F.sum(n).alias(n) for n in ("n_patients", "n_specimens", "n_assays")]
    )


def cohort_summary(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """The cohort overview as ``(section, item, value)``; NULL status is pass here."""
    usable = active_assays(patients, specimens, assays, schema=schema)

    def buckets(frame, section, column, default):
        return frame.groupBy(F.coalesce(column, F.lit(default)).alias("item")).agg(
            F.count(F.lit(1)).alias("value")
        ).select(F.lit(section).alias("section"), "item", "value")

    consent = buckets(patients, "patients_by_consent", "consent_status", "consented")
    by_specimen = buckets(specimens, "specimens_by_qc", "qc_status", "pass")
    by_assay = buckets(assays, "assays_by_qc", "qc_status", "pass")
    n_usable = usable.agg(F.count(F.lit(1)).alias("value"))

    def total(source, section):
        return source.agg(F.sum("value").alias("value")).select(
            F.lit(section).alias("section"), F.lit("total").alias("item"), "value"
        )

    excluded = (
        by_assay.select("value")
        .unionByName(n_usable.select((-F.col("value")).alias("value")))
        .agg(F.sum("value").alias("value"))
    )
    return (
        consent.unionByName(by_specimen)
        .unionByName(by_assay)
        .unionByName(total(consent, "patients"))
        .unionByName(total(by_specimen, "specimens"))
        .unionByName(total(by_assay, "assays"))
        .unionByName(
            n_usable.select(F.lit("assays").alias("section"), F.lit("usable").alias("item"), "value")
        )
        .unionByName(
            excluded.select(F.lit("assays").alias("section"), F.lit("excluded").alias("item"), "value")
        )
    )


def completion(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Done and pending per analysis over usable assays."""
    counts = completion_counts(active_assays(patients, specimens, assays, schema=schema))
    return counts.select(
        "analysis",
        "done",
        (F.col("total") - F.col("done")).alias("pending"),
        F.col("total").alias("total_usable"),
    )


NONE_LABEL = "(none)"
FAILING_LABELS = ("FAIL", "CENSORED", "CONSENT_REVOKED", NONE_LABEL)


def partition_count(specimens: DataFrame, pair_by: str) -> Column:
    """Number of distinct non-blank values of the partition column, as a scalar subquery."""
    value = F.nullif(F.col(pair_by).cast("string"), F.lit(""))
    return specimens.agg(F.count_distinct(value)).scalar()


def specimen_labels(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame | None,
    pair_by: str,
    assay_type: str | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Per specimen its partition value and display label.

    With ``assay_type`` the worst status of the matching assays counts too, no
    matching assay gives the none label, and the patient cascade applies.
    """
    key, parent = schema.key("specimen"), schema.level("specimen").parent_key
    own = F.coalesce(F.col("qc_status"), F.lit("pass"))
    base = specimens.select(
        F.col(parent).alias("patient_id"),
        F.col(key).alias("specimen_id"),
        F.col(pair_by).cast("string").alias("part"),
        own.alias("own"),
    ).filter(F.col("part").isNotNull() & (F.col("part") != ""))
    effective = F.col("own")
    if assay_type is not None:
        severity = status_severity(F.coalesce(F.col("qc_status"), F.lit("pass")))
        worst = (
            assays.filter(F.col("assay_type") == assay_type)
            .groupBy(F.col(schema.level("assay").parent_key).alias("specimen_id"))
            .agg(F.max(severity).alias("_sev"))
        )
        usable = active_patients(patients).select(
            F.col(schema.key("patient")).alias("patient_id"), F.lit(True).alias("_ok")
        )
        base = base.join(worst, "specimen_id", "left").join(usable, "patient_id", "left")
        names = F.array(*[F.lit(n) for n in ("pass", "warn", "censored", "fail", "consent_revoked")])
        effective = (
            F.when(F.col("_sev").isNull(), NONE_LABEL)
            .when(F.col("_ok").isNull(), "consent_revoked")
            .when(
                F.col("_sev") > status_severity(F.col("own")),
                F.element_at(names, F.col("_sev") + 1),
            )
            .otherwise(F.col("own"))
        )
    shout = F.col("label").isin("fail", "censored", "consent_revoked")
    return (
        base.withColumn("label", effective)
        .select("patient_id", "specimen_id", "part", F.when(shout, F.upper("label")).otherwise(F.col("label")).alias("label"))
    )


def pair_by(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame | None,
    pair_by: str,
    assay_type: str | None = None,
    partition_order: list[str] | None = None,
    partitions: list[str] | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Per patient: readiness over all partitions.

    Rows hold the labels by partition as a map, the partitions present in
    order, how many are missing and how many pass.  Two specimens of one patient
    in one partition: the highest specimen id counts.  However many partitions
    there are, a patient gathers only its own; nothing runs before the first
    action.  With ``partitions`` only these are looked at, and each gets a
    column of labels; the missing ones are then listed.
    """
    labels = specimen_labels(patients, specimens, assays, pair_by, assay_type, schema)
    if partitions is not None:
        labels = labels.filter(F.col("part").isin(*partitions))
    n_parts = F.lit(len(partitions)) if partitions is not None else partition_count(specimens, pair_by)
    cells = labels.groupBy("patient_id", "part").agg(F.max(F.struct("specimen_id", "label")).alias("_latest"))
    place = F.lit(len(partition_order or []))
    for i, p in enumerate(partition_order or []):
        place = F.when(F.col("part") == p, F.lit(i)).otherwise(place)
    label = F.col("_latest.label")
    row = cells.groupBy("patient_id").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("place"), "part", label.alias("label")))).alias("_cells"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~label.isin(*FAILING_LABELS)).alias("passing"),
    )
    row = row.withColumn("_parts", n_parts.cast("bigint"))
    status = (
        F.when((F.col("_n") == 1) & (F.col("_parts") > 1), "singleton")
        .when(F.col("_n") < F.col("_parts"), "incomplete")
        .when(F.col("passing") < F.col("_parts"), "broken")
        .otherwise("complete")
    )
    table = row.select(
        "patient_id",
        F.map_from_entries(F.transform("_cells", lambda c: F.struct(c["part"], c["label"]))).alias("labels"),
        status.alias("status"),
        F.transform("_cells", lambda c: c["part"]).alias("present"),
        (F.col("_parts") - F.col("_n")).alias("n_missing"),
        "passing",
    )
    if partitions is None:
        return table
    first = [p for p in (partition_order or []) if p in partitions]
    ordered = first + [p for p in partitions if p not in first]
    return table.select(
        "patient_id",
        *[F.coalesce(F.try_element_at("labels", F.lit(p)), F.lit(NONE_LABEL)).alias(p) for p in ordered],
        "status",
        "present",
        F.array_except(F.array(*[F.lit(p) for p in ordered]), F.col("present")).alias("missing"),
        "passing",
    )


def pair_by_require(table: DataFrame, require: int) -> DataFrame:
    """How many patients have at least ``require`` passing partitions."""
    return table.agg(F.count_if(F.col("passing") >= require).alias("require_satisfied"))


def pair_by_filter(table: DataFrame, status: str) -> DataFrame:
    return table.filter(F.col("status") == status)


def pair_by_summary(table: DataFrame) -> DataFrame:
    """Patients per readiness class, classes without patients included."""
    classes = ("complete", "broken", "incomplete", "singleton")
    return table.agg(*[F.count_if(F.col("status") == c).alias(c) for c in classes])


def row_level_choice(frames: dict[str, DataFrame]) -> str:
    """The level with most analyses; ties go to specimens, then assays, then patients."""
    preference = ("specimen", "assay", "patient")
    return max(preference, key=lambda lv: (len(done_columns(frames[lv])), -preference.index(lv)))


def _state(done, status):
    return F.when(status == "fail", "failed").when(done.isNotNull(), "done").otherwise("pending")


def completion_matrix(
    rows: DataFrame,
    level: str,
    children: DataFrame | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Entity × analysis states: ``(row_id, analysis, state, n_failed, n_done, n_pending)``.

    For specimens, analyses found only on the assays are summarised from the
    child rows: the worst state, with counts; no child gives ``na``.
    """
    key = schema.key(level)
    own = analyses_of(rows)
    inner = [a for a in analyses_of(children) if a not in own] if children is not None else []
    cells = []
    for a in own:
        state = _state(F.col(a + DONE_SUFFIX), F.col("qc_status"))
        counts = [
            (state == s).cast("bigint").alias(f"n_{s}") for s in ("failed", "done", "pending")
        ]
        cells.append(F.struct(F.lit(a).alias("analysis"), state.alias("state"), *counts))
    frame = rows.select(F.col(key).alias("row_id"), "qc_status", *[a + DONE_SUFFIX for a in own])
    if inner:
        failed = F.coalesce(F.col("qc_status") == "fail", F.lit(False))
        per_parent = children.groupBy(
            F.col(schema.level("assay").parent_key).alias("row_id")
        ).agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(failed).alias("_failed"),
            *[
                F.count_if(~failed & F.col(a + DONE_SUFFIX).isNotNull()).alias(f"_d{i}")
                for i, a in enumerate(inner)
            ],
        )
        frame = frame.join(per_parent, "row_id", "left")
        for i, a in enumerate(inner):
            n, bad = F.coalesce("_n", F.lit(0)), F.coalesce("_failed", F.lit(0))
            done = F.coalesce(f"_d{i}", F.lit(0))
            waiting = n - bad - done
            worst = (
                F.when(n == 0, "na")
                .when(bad > 0, "failed")
                .when(waiting > 0, "pending")
                .otherwise("done")
            )
            cells.append(
                F.struct(
                    F.lit(a).alias("analysis"),
                    worst.alias("state"),
                    bad.alias("n_failed"),
                    done.alias("n_done"),
                    waiting.alias("n_pending"),
                )
            )
    return frame.select("row_id", F.explode(F.array(*cells)).alias("_c")).select("row_id", "_c.*")


def next_up(
    rows: DataFrame, level: str, limit: int = 6, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Per analysis, in name order: how many rows could run it now, and the first few.

    A row is ready when the analysis is not done but its predecessor is.  The
    rank filter lets Spark keep only ``limit`` rows per analysis and task before
    the shuffle.
    """
    key = schema.key(level)
    names = analyses_of(rows)
    ready = []
    for i, a in enumerate(names):
        test = F.col(a + DONE_SUFFIX).isNull()
        if i:
            test = test & F.col(names[i - 1] + DONE_SUFFIX).isNotNull()
        ready.append(F.when(test, F.lit(a)))
    long = rows.select(
        F.col(key).alias("id"), F.explode(F.array_compact(F.array(*ready))).alias("analysis")
    )
    counts = long.groupBy("analysis").agg(F.count(F.lit(1)).alias("count"))
    order = W.partitionBy("analysis").orderBy("id")
    top = long.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
    firsts = top.groupBy("analysis").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return counts.join(firsts, "analysis").select(
        "analysis", "count", "ids", F.greatest(F.col("count") - limit, F.lit(0)).alias("more")
    )


def dashboard_specimen_pct(
    patients: DataFrame, specimens: DataFrame, assays: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Per specimen: done cells over assays times analyses."""
    names = done_columns(assays)
    table = rollup_join(patients, specimens, assays, "specimen", names, schema)
    done = sum((F.col(n) for n in names), F.lit(0).cast("bigint"))
    cells = F.col("n_assays") * len(names)
    return table.select(
        schema.level("assay").parent_key,
        "n_assays",
        done.alias("done_cells"),
        cells.alias("total_cells"),
        percent(done, cells).alias("pct"),
    )


def dashboard_analysis_pct(assays: DataFrame) -> DataFrame:
    """Per analysis the completion over all assays."""
    return completion_counts(assays)


def overall_pct(frame: DataFrame) -> DataFrame:
    """Completed cells over all cells of one table."""
    counts = completion_counts(frame)
    return counts.agg(
        F.coalesce(F.sum("done"), F.lit(0)).alias("completed_cells"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_cells"),
    ).withColumn("pct", percent(F.col("completed_cells"), F.col("total_cells")))


def extract_table(
    patients: DataFrame, specimens: DataFrame, assays: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Per patient the number of specimens and of distinct assay types."""
    s_key, p_key = schema.level("assay").parent_key, schema.level("specimen").parent_key
    types = assays.select(s_key, "assay_type").distinct()
    links = specimens.select(F.col(schema.key("specimen")).alias(s_key), p_key)
    n_types = (
        types.join(links, s_key)
        .select(p_key, "assay_type")
        .distinct()
        .groupBy(p_key)
        .agg(F.count("assay_type").alias("n_assay_types"))
    )
    n_specimens = links.groupBy(p_key).agg(F.count(s_key).alias("n_specimens"))
    zero = F.lit(0)
    return (
        patients.join(n_specimens, p_key, "left")
        .join(n_types, p_key, "left")
        .select(
            F.col(schema.key("patient")),
            F.coalesce("n_specimens", zero).alias("n_specimens"),
            F.coalesce("n_assay_types", zero).alias("n_assay_types"),
        )
        .orderBy(schema.key("patient"))
    )


def log_phase(action, analysis):
    """Phase of a log entry; NULL for actions that run no job."""
    # Phase names.
    named = (
        F.when(analysis == "premerge_flagstat", "premerge_flagstat")
        .when(analysis == "merge", "merge_ont")
        .when(analysis.startswith("modkit_"), "modkit_merged")
        .when(analysis == "mock_scrna", "mock_scrna")
        .when(analysis == "attach_bams", "attach_bams")
        .otherwise(F.concat(F.lit("other:"), F.coalesce(analysis, F.lit(""))))
    )
    return F.when(action == "append", named).when(action == "censor", "censor")


def phase_timing(log: DataFrame, accounting: DataFrame) -> DataFrame:
    """Per phase: jobs, shortest, upper-median and longest run, CPU hours.

    ``accounting`` has ``slurm_job_id, elapsed_s, req_cpus``.
    """
    jobs = log.filter(
        F.col("slurm_job_id").isNotNull() & (F.col("slurm_job_id") != "")
    ).select("slurm_job_id", log_phase(F.col("action"), F.col("analysis")).alias("phase")).filter(
        F.col("phase").isNotNull()
    )
    timed = jobs.join(accounting, "slurm_job_id", "left")
    busy = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s") * F.col("req_cpus")).otherwise(0)
    totals = timed.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.min("elapsed_s").alias("min_s"),
        F.max("elapsed_s").alias("max_s"),
        (F.coalesce(F.sum(busy), F.lit(0)) / 3600.0).alias("cpu_hours"),
    )
    middle = exact_middle(histogram(timed, ["phase"], "elapsed_s"), ["phase"]).select(
        "phase", F.col("upper").alias("median_s")
    )
    return totals.join(middle, "phase", "left").select(
        "phase", "n_jobs", "min_s", "median_s", "max_s", "cpu_hours"
    )


def last_status_change(log: DataFrame) -> DataFrame:
    """The most recent lifecycle change of each project."""
    changes = log.filter(F.col("action") == "project_status_change")
    return (
        changes.groupBy("project_id")
        .agg(F.max_by(F.struct("from_status", "to_status", "timestamp", "reason"), "seq").alias("_c"))
        .select("project_id", "_c.*")
    )


def analysis_columns(log: DataFrame) -> DataFrame:
    """Distinct ``(analysis, column)`` pairs that appends have added."""
    return (
        log.filter((F.col("action") == "append") & (F.col("analysis") != ""))
        .select("analysis", F.explode("columns_added").alias("column"))
        .distinct()
    )

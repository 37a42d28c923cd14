"""Integrity checks; each yields ``(check, table, key, detail)`` rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.functions.ids import id_rule, suggest_id
from cohort_ledger.functions.nodes import parse_node
from cohort_ledger.model import (
    DEFAULT_SCHEMA,
    DONE_SUFFIX,
    QC_MANAGED_COLUMNS,
    CohortSchema,
)
from cohort_ledger.operators import graph
from cohort_ledger.operators.qc import active_events, consent_violations, derive_status

ISSUE = "check string, table string, key string, detail string"


def issue(frame: DataFrame, check, table, key, detail="") -> DataFrame:
    def column(x):
        return F.lit(x) if isinstance(x, str) else x

    return frame.select(
        column(check).cast("string").alias("check"),
        column(table).cast("string").alias("table"),
        column(key).cast("string").alias("key"),
        column(detail).cast("string").alias("detail"),
    )


def _static(frame: DataFrame, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Issues found on schemas alone, as rows of the frame's session."""
    return frame.sparkSession.createDataFrame(rows, ISSUE)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def declared_missing(tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Declared columns that a table lacks."""
    rows = [
        ("declared_missing", lv.table, c, "declared but not in the table")
        for lv in schema.levels
        for c in lv.column_names()
        if c not in tables[lv.name].columns
    ]
    return _static(next(iter(tables.values())), rows)


def fk_orphans(tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Rows whose parent does not exist."""
    out = []
    for lv in schema.levels[1:]:
        parent = schema.parent(lv.name)
        keys = tables[parent.name].select(F.col(parent.key).alias(lv.parent_key))
        bad = (
            tables[lv.name]
            .filter(F.col(lv.parent_key).isNotNull())
            .join(keys, lv.parent_key, "left_anti")
        )
        out.append(issue(bad, "fk_orphan", lv.table, F.col(lv.key), F.col(lv.parent_key)))
    return _all(out)


def done_without_data(
    tables: dict[str, DataFrame], columns: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Done columns with values whose analysis added no data column.

    ``columns`` is ``(analysis, column)`` as collected from the log.
    """
    companions = (
        columns.filter(F.col("column") != F.concat("analysis", F.lit(DONE_SUFFIX)))
        .select("analysis")
        .distinct()
    )
    out = []
    for lv in schema.levels:
        frame = tables[lv.name]
        done = [c for c in frame.columns if c.endswith(DONE_SUFFIX)]
        if not done:
            continue
        counts = frame.agg(*[F.count(c).alias(c) for c in done])
        cells = [
            F.struct(F.lit(c[: -len(DONE_SUFFIX)]).alias("analysis"), F.col(c).alias("n"))
            for c in done
        ]
        long = counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
        bad = long.filter("n > 0").join(companions, "analysis", "left_anti")
        out.append(
            issue(bad, "done_without_data", lv.table,
                  F.concat("analysis", F.lit(DONE_SUFFIX)), F.col("n").cast("string"))
        )
    return _all(out) if out else _static(columns, [])


def consent_invariants(patients: DataFrame, events: DataFrame) -> DataFrame:
    bad = consent_violations(patients, events)
    return issue(bad, "consent_invariant", "patients", F.col("patient_id"), F.col("violation"))


def orphan_events(
    events: DataFrame, tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Active events on entities that do not exist."""
    known = _all(
        [
            tables[lv.name].select(F.lit(lv.name).alias("level"), F.col(lv.key).alias("entity_id"))
            for lv in schema.levels
        ]
    )
    bad = active_events(events).join(known, ["level", "entity_id"], "left_anti")
    return issue(
        bad, "orphan_event", "qc_events", F.col("id"),
        F.concat_ws(" ", F.col("level"), F.col("entity_id")),
    )


def status_mismatch(
    tables: dict[str, DataFrame], events: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Rows whose stored status is not the derived one; NULL differs from pass."""
    out = []
    for lv in schema.levels:
        derived = derive_status(events, lv.name).select(
            F.col("entity_id").alias(lv.key), F.col("qc_status").alias("_d")
        )
        expected = F.coalesce("_d", F.lit("pass"))
        bad = (
            tables[lv.name]
            .select(lv.key, "qc_status")
            .join(derived, lv.key, "left")
            .filter(~F.col("qc_status").eqNullSafe(expected))
        )
        detail = F.concat_ws(" ", F.coalesce("qc_status", F.lit("NULL")), F.lit("expected"), expected)
        out.append(issue(bad, "status_mismatch", lv.table, F.col(lv.key), detail))
    return _all(out)


def lineage_orphans(assay_sources: DataFrame, assays: DataFrame, specimens: DataFrame) -> DataFrame:
    """Lineage edges whose source, merged assay or specimen is unknown."""
    out = []
    for column, frame, key in (
        ("source_assay_id", assays, "assay_id"),
        ("merged_assay_id", assays, "assay_id"),
        ("consumer_specimen_id", specimens, "specimen_id"),
    ):
        known = frame.select(F.col(key).alias(column))
        bad = (
            assay_sources.filter(F.col(column).isNotNull())
            .join(known, column, "left_anti")
        )
        out.append(issue(bad, "lineage_orphan", "assay_sources", F.col(column), column))
    return _all(out)


def batch_orphans(assays: DataFrame, batches: DataFrame) -> DataFrame:
    """Assays that point at an unregistered batch."""
    bad = assays.filter(F.col("batch_id").isNotNull()).join(
        batches.select("batch_id"), "batch_id", "left_anti"
    )
    return issue(bad, "batch_orphan", "assays", F.col("assay_id"), F.col("batch_id"))


def ref_orphans(usage: DataFrame, references: DataFrame) -> DataFrame:
    """Used reference keys that are not declared any more."""
    bad = usage.select("ref_key").distinct().join(
        references.select("ref_key"), "ref_key", "left_anti"
    )
    return issue(bad, "ref_orphan", "reference_usage", F.col("ref_key"))


def dangling_nodes(
    derivation: DataFrame,
    artifacts: DataFrame,
    references: DataFrame,
    tables: dict[str, DataFrame],
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Nodes of edges that are malformed or name nothing that exists."""
    nodes = (
        derivation.select(F.col("down_node").alias("node"))
        .unionByName(derivation.select(F.col("up_node").alias("node")))
        .distinct()
        .withColumn("_p", parse_node(F.col("node")))
    )
    malformed = nodes.filter(F.col("_p").isNull())
    parts = nodes.filter(F.col("_p").isNotNull()).select("node", "_p.*")
    cohort = parts.filter(F.col("scope") == "cohort").join(
        artifacts.select("analysis", "run_tag"), ["analysis", "run_tag"], "left_anti"
    )
    reference = parts.filter(F.col("scope") == "reference").join(
        references.select("ref_key"), "ref_key", "left_anti"
    )
    known = _all(
        [
            tables[lv.name].select(
                F.lit(lv.name).alias("entity_level"), F.col(lv.key).alias("entity_id")
            )
            for lv in schema.levels
        ]
    )
    analysis = parts.filter(F.col("scope") == "analysis").join(
        known, ["entity_level", "entity_id"], "left_anti"
    )
    return _all(
        [issue(malformed, "dangling_node", "artifact_derivation", F.col("node"), "malformed")]
        + [
            issue(x, "dangling_node", "artifact_derivation", F.col("node"), "no such entity")
            for x in (cohort, reference, analysis)
        ]
    )


def acyclic(derivation: DataFrame, usage: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Edges that lie on a cycle of the combined graph."""
    bad = graph.find_cycles(graph.combined_edges(derivation, usage, artifacts))
    return issue(bad, "cycle", "artifact_derivation", F.col("down_node"), F.col("up_node"))


def flat_keys(manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """Repeated keys, and the number of NULL keys."""
    repeats = (
        manifest.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    nulls = manifest.agg(F.count_if(F.col(key).isNull()).alias("n")).filter("n > 0")
    return _all(
        [
            issue(repeats, "duplicate_key", "manifest", F.col("key"), F.col("n").cast("string")),
            issue(nulls, "null_key", "manifest", key, F.col("n").cast("string")),
        ]
    )


def flat_empty_columns(manifest: DataFrame) -> DataFrame:
    """Columns without a single value."""
    names = manifest.columns
    counts = manifest.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n")) for i, c in enumerate(names)
    ]
    long = counts.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")
    return issue(long.filter("n = 0"), "empty_column", "manifest", F.col("column"))


def flat_schema(manifest: DataFrame, recorded: dict[str, list[str]], key: str = "sample_id") -> DataFrame:
    """Recorded columns that are missing, and done columns without data columns."""
    rows = [
        ("recorded_missing", "manifest", c, analysis)
        for analysis, columns in recorded.items()
        for c in columns
        if c not in manifest.columns
    ]
    for done in (c for c in manifest.columns if c.endswith(DONE_SUFFIX)):
        analysis = done[: -len(DONE_SUFFIX)]
        if analysis in recorded:
            data = [c for c in recorded[analysis] if c != done]
        else:
            data = [c for c in manifest.columns if c.startswith(analysis) and c not in (done, key)]
        if not data:
            rows.append(("done_without_data", "manifest", done, analysis))
    return _static(manifest, rows)


def id_format(tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Malformed identifiers per level with the broken rule and a suggestion.

    Columns ``check, table, key, detail, suggestion``.
    """
    out = []
    for lv in schema.levels:
        rule = id_rule(F.col(lv.key), lv.id_pattern, schema.allow_unicode_ids)
        bad = tables[lv.name].select(F.col(lv.key), rule.alias("_rule")).filter(
            F.col("_rule").isNotNull()
        )
        out.append(
            bad.select(
                F.lit("id_format").alias("check"),
                F.lit(lv.table).alias("table"),
                F.col(lv.key).cast("string").alias("key"),
                F.col("_rule").alias("detail"),
                suggest_id(F.col(lv.key)).alias("suggestion"),
            )
        )
    return _all(out)


def id_suggest(frame: DataFrame, column: str) -> DataFrame:
    """A clean identifier next to each value."""
    return frame.withColumn("suggestion", suggest_id(F.col(column)))


def case_variants(tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Identifiers equal after case folding, where the level does not allow them."""
    out = []
    for lv in schema.levels:
        if lv.allow_case_variants:
            continue
        folded = (
            tables[lv.name]
            .groupBy(F.lower(lv.key).alias("_f"))
            .agg(F.min(lv.key).alias("_a"), F.max(lv.key).alias("_z"))
            .filter(F.col("_a") != F.col("_z"))
        )
        out.append(issue(folded, "case_variant", lv.table, F.col("_f"), F.concat_ws(" ", "_a", "_z")))
    return _all(out) if out else _static(next(iter(tables.values())), [])


def schema_drift(
    tables: dict[str, DataFrame], columns: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """Declared columns that are missing, and columns nobody declared or logged."""
    extra = []
    for lv in schema.levels:
        allowed = set(lv.column_names()) | set(QC_MANAGED_COLUMNS[lv.name])
        extra += [
            (lv.table, c)
            for c in tables[lv.name].columns
            if c not in allowed and not c.endswith(DONE_SUFFIX)
        ]
    undeclared = columns.sparkSession.createDataFrame(extra, "table string, column string").join(
        columns.select("column").distinct(), "column", "left_anti"
    )
    return declared_missing(tables, schema).unionByName(
        issue(undeclared, "undeclared_column", F.col("table"), F.col("column"), "not declared or logged")
    )


def constraints(tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Declared NOT NULL, enum, UNIQUE and key constraints."""
    out = []
    for lv in schema.levels:
        frame = tables[lv.name]
        row_checks = [F.when(F.col(lv.key).isNull(), F.lit(f"not_null:{lv.key}"))]
        for c in lv.columns:
            if c.name not in frame.columns:
                continue
            if c.required:
                row_checks.append(F.when(F.col(c.name).isNull(), F.lit(f"not_null:{c.name}")))
            if c.enum:
                row_checks.append(
                    F.when(~F.col(c.name).isin(list(c.enum)), F.lit(f"enum:{c.name}"))
                )
        broken = frame.select(
            F.col(lv.key), F.explode(F.array_compact(F.array(*row_checks))).alias("_rule")
        )
        out.append(issue(broken, "constraint", lv.table, F.col(lv.key), F.col("_rule")))
        unique = [lv.key] + [c.name for c in lv.columns if c.unique and c.name in frame.columns]
        for name in unique:
            repeats = (
                frame.filter(F.col(name).isNotNull())
                .groupBy(name)
                .agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1")
            )
            out.append(issue(repeats, "constraint", lv.table, F.col(name), f"unique:{name}"))
    return _all(out)


def checksum_match(log: DataFrame, files: DataFrame) -> DataFrame:
    """Logged source files whose content is gone or changed.

    ``files`` is a ``binaryFile`` read with ``path`` and ``content``, or has
    ``path`` and ``digest`` from ``sources.file_digests`` over the log's own
    ``results_file``, for files of any size; the digest is computed where the
    file is read and only it is shuffled.
    """
    digest = F.col("digest") if "digest" in files.columns else F.md5("content")
    actual = files.select(F.col("path").alias("results_file"), digest.alias("_md5"))
    logged = log.filter(F.col("results_checksum").isNotNull()).select(
        "results_file", "results_checksum"
    ).distinct()
    checked = logged.join(actual, "results_file", "left")
    bad = checked.filter(~F.col("_md5").eqNullSafe(F.col("results_checksum")))
    return issue(
        bad, "checksum", "log", F.col("results_file"),
        F.when(F.col("_md5").isNull(), "missing").otherwise("changed"),
    )


def validate_all(
    tables: dict[str, DataFrame],
    events: DataFrame,
    batches: DataFrame,
    assay_sources: DataFrame,
    usage: DataFrame,
    references: DataFrame,
    artifacts: DataFrame,
    derivation: DataFrame,
    log: DataFrame | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Every check of a project in one issues table."""
    from cohort_ledger.operators.status import analysis_columns

    found = [
        declared_missing(tables, schema),
        fk_orphans(tables, schema),
        consent_invariants(tables["patient"], events),
        orphan_events(events, tables, schema),
        status_mismatch(tables, events, schema),
        lineage_orphans(assay_sources, tables["assay"], tables["specimen"]),
        batch_orphans(tables["assay"], batches),
        ref_orphans(usage, references),
        dangling_nodes(derivation, artifacts, references, tables, schema),
        acyclic(derivation, usage, artifacts),
    ]
    if log is not None:
        found.append(done_without_data(tables, analysis_columns(log), schema))
    return _all(found)

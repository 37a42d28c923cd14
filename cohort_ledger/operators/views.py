"""Views and joins over the model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import analysis_node, cohort_node
from cohort_ledger.functions.qc import consent_usable, qc_usable
from cohort_ledger.model import DEFAULT_SCHEMA, CohortSchema
from cohort_ledger.operators import artifacts as art
from cohort_ledger.operators import graph
from cohort_ledger.operators.ingest import aligned
from cohort_ledger.session import cut


def joined(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """One row per assay with its specimen and patient columns.

    A column found on more than one level is prefixed with its level name, so
    the result can be written and queried without ambiguous names.  ``by`` names
    columns that levels share besides their keys, as the place of a layout.
    """
    linking = {*schema.linking_columns(), *by}
    frames = {"patient": patients, "specimen": specimens, "assay": assays}
    seen: dict[str, int] = {}
    for frame in frames.values():
        for c in frame.columns:
            seen[c] = seen.get(c, 0) + 1
    named = {
        level: frame.select(
            *[
                F.col(c).alias(c if c in linking or seen[c] == 1 else f"{level}_{c}")
                for c in frame.columns
            ]
        )
        for level, frame in frames.items()
    }
    above = named["specimen"].join(named["patient"], [*by, schema.key("patient")])
    return named["assay"].join(above, [*by, schema.key("specimen")])


def active(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """The joined view with the usability cascade; filters reach each scan."""
    test = qc_usable(F.col("qc_status"), include_censored)
    return joined(
        patients.filter(
            test & consent_usable(F.col("consent_status"), include_consent_revoked)
        ),
        specimens.filter(test),
        assays.filter(test),
        schema,
    )


def cohort_artifacts_view(
    artifacts: DataFrame,
    inputs: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    usage: DataFrame,
    references: DataFrame,
    derivation: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
) -> DataFrame:
    """Artifacts with input, reference and derived staleness.

    The cascade runs once: each node's own causes are written, and both the
    counts and the seeds of the walk down the edges are read from them.
    """
    direct = cut(graph.direct_staleness(artifacts, inputs, patients, specimens, assays, usage, references))
    edges = graph.combined_edges(derivation, usage, artifacts)
    derived = graph.derived_stale_nodes(edges, direct.filter("directly_stale").select("node"))
    own = direct.select(F.col("node").alias("_node"), F.col("stale_inputs").alias("_n"), (F.col("stale_refs") > 0).alias("_ref"))
    if include_censored or include_consent_revoked:
        lenient = art.censored_inputs(inputs, patients, specimens, assays, include_censored, include_consent_revoked)
        counts = lenient.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("_n"))
        artifacts_with = artifacts.join(counts, "artifact_id", "left")
        own = own.drop("_n")
    else:
        artifacts_with = artifacts
    scopes = references.select(F.col("ref_key").alias("scope_ref_key"))
    out = (
        artifacts_with.withColumn("_node", cohort_node(F.col("analysis"), F.col("run_tag")))
        .join(own, "_node", "left")
        .join(scopes, F.col("region_scope") == F.col("scope_ref_key"), "left")
        .join(derived.select(F.col("node").alias("_node"), F.lit(True).alias("_derived")), "_node", "left")
    )
    n = F.coalesce(F.col("_n"), F.lit(0))
    return out.select(
        *artifacts.columns,
        "scope_ref_key",
        n.alias("n_censored_inputs"),
        (n > 0).alias("stale"),
        F.coalesce("_ref", F.lit(False)).alias("ref_stale"),
        F.coalesce("_derived", F.lit(False)).alias("derived_stale"),
    )


def with_input_staleness(
    artifacts: DataFrame, inputs: DataFrame, patients: DataFrame, specimens: DataFrame, assays: DataFrame, usable: DataFrame | None = None
) -> DataFrame:
    """Artifacts with the number of their inputs that are not usable, and whether there is one.

    ``usable`` are the ids of the usable assays, where they are worked out already.
    """
    counts = art.censored_inputs(inputs, patients, specimens, assays, usable=usable).groupBy("artifact_id").agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return artifacts.join(counts, "artifact_id", "left").select(*artifacts.columns, n.alias("n_censored_inputs"), (n > 0).alias("stale"))


def reference_usage_view(usage: DataFrame, references: DataFrame) -> DataFrame:
    """Usage rows with the current version and whether it differs."""
    return art.usage_with_current(usage, references)


def derivation_view(derivation: DataFrame, derived: DataFrame) -> DataFrame:
    """Each edge with the derived staleness of its downstream end."""
    flags = derived.select(F.col("node").alias("down_node"), F.lit(True).alias("_d"))
    return derivation.join(flags, "down_node", "left").select(
        *derivation.columns, F.coalesce("_d", F.lit(False)).alias("down_derived_stale")
    )


def assays_per_specimen(assays: DataFrame, done_columns: list[str], schema=DEFAULT_SCHEMA):
    """Assay and done counts per specimen, combined before any join."""
    return assays.groupBy(schema.level("assay").parent_key).agg(
        F.count(F.lit(1)).alias("n_assays"), *[F.count(c).alias(c) for c in done_columns]
    )


def rollup_join(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    level: str,
    done_columns: list[str] | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Child counts per specimen or patient, entities without children included.

    Assays are counted per specimen before joining, so a specimen or patient
    that owns most of the assays costs one partial row per task.
    """
    done = done_columns or []
    s_key, p_key = schema.level("assay").parent_key, schema.level("specimen").parent_key
    per_specimen = assays_per_specimen(assays, done, schema)
    counted = ["n_assays"] + done
    base = specimens.select(F.col(schema.key("specimen")).alias(s_key), p_key).join(
        per_specimen, s_key, "left"
    )
    if level == "specimen":
        return base.select(s_key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])
    per_patient = base.groupBy(p_key).agg(
        F.count(F.lit(1)).alias("n_specimens"),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counted],
    )
    key = schema.key("patient")
    return patients.select(F.col(key).alias(p_key)).join(per_patient, p_key, "left").select(
        F.col(p_key).alias(key),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ["n_specimens"] + counted],
    )


def batch_sizes(batches: DataFrame, assays: DataFrame) -> DataFrame:
    """Assays per registered batch, empty batches included."""
    counts = assays.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_assays"))
    return batches.join(counts, "batch_id", "left").select(
        *batches.columns, F.coalesce("n_assays", F.lit(0)).alias("n_assays")
    )


def lineage_listing(assay_sources: DataFrame) -> DataFrame:
    """Edges by target: specimens fed directly, and assays merged from others.

    Rows stay long; a target with very many sources is never gathered into one
    array.
    """
    to_specimen = F.col("consumer_specimen_id").isNotNull()
    return assay_sources.select(
        F.when(to_specimen, "specimen").otherwise("merged_assay").alias("target_kind"),
        F.coalesce("consumer_specimen_id", "merged_assay_id").alias("target_id"),
        "source_assay_id",
    ).orderBy("target_kind", "target_id", "source_assay_id")


def patient_drill(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    events: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Everything under every patient, one row per record.

    Columns ``patient_id, specimen_id, assay_id, record, record_id, qc_status``;
    ``record`` is patient, specimen, assay or event.  Kept long rather than
    nested: one patient may own a third of the cohort.
    """
    none = F.lit(None).cast("string")
    p = patients.select(F.col(schema.key("patient")).alias("patient_id"), "qc_status")
    s = specimens.select(
        F.col(schema.key("specimen")).alias("specimen_id"),
        F.col(schema.level("specimen").parent_key).alias("patient_id"),
        "qc_status",
    ).join(p.select("patient_id"), "patient_id", "left_semi")
    a = assays.select(
        F.col(schema.key("assay")).alias("assay_id"),
        F.col(schema.level("assay").parent_key).alias("specimen_id"),
        "qc_status",
    ).join(s.select("specimen_id", "patient_id"), "specimen_id")

    def record(frame, kind, entity, specimen, assay):
        return frame.select(
            "patient_id",
            specimen.alias("specimen_id"),
            assay.alias("assay_id"),
            F.lit(kind).alias("record"),
            F.col(entity).alias("record_id"),
            "qc_status",
        )

    entities = (
        record(p, "patient", "patient_id", none, none)
        .unionByName(record(s, "specimen", "specimen_id", F.col("specimen_id"), none))
        .unionByName(record(a, "assay", "assay_id", F.col("specimen_id"), F.col("assay_id")))
    )
    ev = events.select(F.col("level").alias("record"), F.col("entity_id").alias("record_id"), "id", "kind")
    attached = (
        entities.drop("qc_status")
        .join(ev, ["record", "record_id"])
        .select(
            "patient_id",
            "specimen_id",
            "assay_id",
            F.lit("event").alias("record"),
            F.col("id").alias("record_id"),
            F.col("kind").alias("qc_status"),
        )
    )
    return entities.unionByName(attached)


def _merged(manifest: DataFrame, results: DataFrame, key: str, how: str) -> DataFrame:
    if manifest.schema[key].dataType == results.schema[key].dataType:
        return manifest.join(results, key, how)
    left, right = aligned(manifest, results, key)
    kept, other = left.columns[:-1], [c for c in results.columns if c != key]
    both = left.join(right.withColumnRenamed(key, "_new_key"), "_key", how)
    if how == "left":
        return both.select(*kept, *other)
    return both.select(*[F.col("_key").alias(c) if c == key else F.col(c) for c in kept], *other)


def merge_left(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keyed merge that keeps the manifest's rows and its keys as they are."""
    return _merged(manifest, results, key, "left")


def merge_outer(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keyed merge that also adds result keys the manifest lacks.

    Keys of different types come in a type that holds both unchanged.
    """
    return _merged(manifest, results, key, "full")


def register_views(
    spark: SparkSession,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
    **others: DataFrame,
) -> list[str]:
    """Temporary views for ad-hoc SQL: the tables, ``_``, ``_active`` and any others.

    With the tables of the provenance graph among the others, named as
    ``cohort_artifacts_view`` takes them, its three views are there too.
    """
    graph_tables = ("artifacts", "inputs", "usage", "references", "derivation")
    if all(n in others for n in graph_tables):
        a, i, u, r, d = (others[n] for n in graph_tables)
        known = cohort_artifacts_view(a, i, patients, specimens, assays, u, r, d)
        stale = known.filter("derived_stale").select(cohort_node(F.col("analysis"), F.col("run_tag")).alias("node"))
        others = {n: f for n, f in others.items() if n not in graph_tables} | {
            "_cohort_artifacts": known,
            "_reference_usage": reference_usage_view(u, r),
            "_artifact_derivation": derivation_view(d, stale),
        }
    views = {
        "patients": patients,
        "specimens": specimens,
        "assays": assays,
        "_": joined(patients, specimens, assays, schema),
        "_active": active(patients, specimens, assays, schema=schema),
        **others,
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(f"`{name}`" if name == "_" else name)
    return list(views)

"""Cohort artifacts, their inputs, references and the lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.operators.active import active_assays
from cohort_ledger.session import cut

USAGE_KEY = ["scope", "entity_level", "entity_id", "analysis", "artifact_id", "ref_key"]


def null_safe_anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows without a partner; NULL keys match each other."""
    names = [f"_k{i}" for i in range(len(keys))]
    other = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    match = None
    for k, n in zip(keys, names):
        test = F.col(k).eqNullSafe(F.col(n))
        match = test if match is None else match & test
    return left.join(other, match, "left_anti")


def append_artifacts(artifacts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add artifacts; a repeated ``(analysis, run_tag)`` is rejected.

    ``rows`` may carry ``inputs`` (an array as given); ``n_inputs`` is its
    length, repeats included.
    """
    key = ["analysis", "run_tag"]
    if "inputs" in rows.columns:
        rows = rows.withColumn("n_inputs", F.size("inputs")).drop("inputs")
    taken = artifacts.select(*key).withColumn("_taken", F.lit(True))
    copies = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_copies"))
    checked = rows.join(taken, key, "left").join(copies, key, "left")
    reason = F.when(F.col("_taken").isNotNull(), "already_exists").when(
        F.col("_copies") > 1, "repeated_in_batch"
    )
    checked = checked.select(*rows.columns, reason.alias("reject"))
    good = checked.filter(F.col("reject").isNull()).drop("reject")
    return (
        artifacts.unionByName(good, allowMissingColumns=True),
        checked.filter(F.col("reject").isNotNull()),
    )


def link_inputs(
    inputs: DataFrame, pairs: DataFrame, artifacts: DataFrame, assays: DataFrame
) -> dict[str, DataFrame]:
    """Link assays to artifacts; a role once set is not changed.

    ``pairs`` is ``(artifact_id, assay_id, role)``; unknown ends are rejected
    and repeats collapse (the first role in text order is kept).
    """
    key = ["artifact_id", "assay_id"]
    base = inputs if "role" in inputs.columns else inputs.withColumn("role", F.lit(None).cast("string"))
    known_assay = pairs.join(assays.select("assay_id"), "assay_id", "left_anti")
    known_artifact = pairs.join(artifacts.select("artifact_id"), "artifact_id", "left_anti")
    rejects = (
        known_assay.withColumn("reject", F.lit("unknown_assay"))
        .unionByName(known_artifact.withColumn("reject", F.lit("unknown_artifact")))
    )
    added = (
        pairs.join(assays.select("assay_id"), "assay_id", "left_semi")
        .join(artifacts.select("artifact_id"), "artifact_id", "left_semi")
        .groupBy(*key)
        .agg(F.min("role").alias("_new"))
    )
    merged = base.join(added, key, "full").select(
        *key, F.coalesce("role", "_new").alias("role")
    )
    return {"inputs": merged, "rejects": rejects}


def artifact_inputs_listing(inputs: DataFrame) -> DataFrame:
    """Inputs and roles in assay order."""
    return inputs.orderBy("artifact_id", "assay_id")


def censored_inputs(
    inputs: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    usable: DataFrame | None = None,
) -> DataFrame:
    """Input links whose assay is not active (or no longer known).

    ``usable`` are the ids of the active assays, where they are worked out already.
    """
    if usable is None:
        usable = active_assays(
            patients, specimens, assays, include_censored, include_consent_revoked
        ).select("assay_id")
    return inputs.join(usable, "assay_id", "left_anti")


def input_staleness(
    artifacts: DataFrame,
    inputs: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
) -> DataFrame:
    """Per artifact: number of inactive inputs and the stale flag, fresh ones too."""
    counts = (
        censored_inputs(
            inputs, patients, specimens, assays, include_censored, include_consent_revoked
        )
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0))
    return artifacts.join(counts, "artifact_id", "left").select(
        *artifacts.columns, n.alias("n_censored_inputs"), (n > 0).alias("stale")
    )


def list_artifacts(
    staleness: DataFrame, scope: str | None = None, stale_only: bool = False
) -> DataFrame:
    """Listing of the staleness table by region scope."""
    if scope is not None:
        staleness = staleness.filter(F.col("region_scope") == scope)
    if stale_only:
        staleness = staleness.filter("stale")
    return staleness.orderBy("analysis", "run_tag")


def sync_references(
    references: DataFrame, declared: DataFrame, as_of
) -> tuple[DataFrame, DataFrame]:
    """Bring stored references up to the declared ones.

    Returns the new table and the version changes.  References that are no
    longer declared are kept.
    """
    columns = [c for c in declared.columns if c != "ref_key"]
    old = references
    for c in columns:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(declared.schema[c].dataType))
    if "updated_at" not in old.columns:
        old = old.withColumn("updated_at", F.lit(None).cast("timestamp"))
    new = declared.select("ref_key", *[F.col(c).alias(f"_n_{c}") for c in columns]).withColumn(
        "_declared", F.lit(True)
    )
    merged = old.withColumn("_stored", F.lit(True)).join(new, "ref_key", "full")
    hit, stored = F.col("_declared").isNotNull(), F.col("_stored").isNotNull()
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    changed = hit & (~stored | differs)
    values = {c: F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in columns}
    values["updated_at"] = (
        F.when(changed, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    ).alias("updated_at")
    table = merged.select(*[values.get(c, F.col(c)) for c in old.columns])
    version_changes = merged.filter(
        hit & stored & ~F.col("version").eqNullSafe(F.col("_n_version"))
    ).select(
        "ref_key", F.col("version").alias("old_version"), F.col("_n_version").alias("new_version")
    )
    return table, version_changes


def declared_reference_edges(declared: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """``derived_from`` node lists of references as edges; bad ones are warned of."""
    from cohort_ledger.functions.nodes import parse_node, reference_node

    rows = declared.select(
        reference_node(F.col("ref_key")).alias("down_node"),
        F.explode("derived_from").alias("up_node"),
    )
    ok = parse_node(F.col("up_node")).isNotNull() & (F.col("up_node") != F.col("down_node"))
    return {"edges": rows.filter(ok).distinct(), "warnings": rows.filter(~ok)}


def record_usage(usage: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert usage rows on their scope key; the new row replaces the old."""
    key = [c for c in USAGE_KEY if c in usage.columns and c in rows.columns]
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in rest])
    return null_safe_anti(usage, rows.select(*key).distinct(), key).unionByName(
        one, allowMissingColumns=True
    )


def usage_with_current(usage: DataFrame, references: DataFrame) -> DataFrame:
    """Usage rows with ``current_version`` and ``is_stale``.

    References are a small table; Spark broadcasts it when its measured size is
    under the broadcast threshold and shuffles (splitting hot keys) otherwise.
    """
    current = references.select("ref_key", F.col("version").alias("current_version"))
    stale = F.col("current_version").isNull() | (
        F.col("current_version") != F.col("version_used")
    )
    return usage.join(current, "ref_key", "left").select(
        *usage.columns, "current_version", F.coalesce(stale, F.lit(False)).alias("is_stale")
    )


def _output_key() -> list[str]:
    return ["scope", "entity_level", "entity_id", "analysis", "artifact_id"]


def usage_reason():
    """Text of one stale usage; NULL when the usage is current."""
    return (
        F.when(
            F.col("current_version").isNull(),
            F.concat(F.lit("reference removed: "), F.col("ref_key")),
        ).when(
            F.col("is_stale"),
            F.concat(
                F.col("ref_key"), F.lit(": "), F.col("version_used"), F.lit(" -> "),
                F.col("current_version"),
            ),
        )
    )


def all_stale_outputs(
    usage: DataFrame, references: DataFrame, stale_only: bool = False
) -> DataFrame:
    """Every output that used a reference, with its state and sorted reasons.

    A usage key is unique, so one output gathers at most one reason per
    reference key.
    """
    current = usage_with_current(usage, references).withColumn("_reason", usage_reason())
    out = current.groupBy(*_output_key()).agg(
        F.array_sort(F.collect_set("_reason")).alias("reasons"),
        F.count("_reason").alias("n_stale"),
    )
    out = out.withColumn("state", F.when(F.col("n_stale") > 0, "STALE").otherwise("fresh"))
    return out.filter(F.col("n_stale") > 0) if stale_only else out


def output_staleness(
    outputs: DataFrame, usage: DataFrame, references: DataFrame
) -> DataFrame:
    """State of the given outputs; one that never used a reference is untracked."""
    key = [c for c in _output_key() if c in outputs.columns]
    states = all_stale_outputs(usage, references)
    left = outputs.alias("o")
    right = states.alias("s")
    match = F.lit(True)
    for c in key:
        match = match & F.col(f"o.{c}").eqNullSafe(F.col(f"s.{c}"))
    return left.join(right, match, "left").select(
        *[F.col(f"o.{c}") for c in outputs.columns],
        F.coalesce("s.state", F.lit("untracked")).alias("state"),
        F.coalesce("s.reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def link_sources(
    assay_sources: DataFrame, rows: DataFrame, assays: DataFrame, specimens: DataFrame
) -> dict[str, DataFrame]:
    """Bulk lineage edges: exactly one target, known ends, repeats ignored."""
    key = ["source_assay_id", "merged_assay_id", "consumer_specimen_id"]
    merged, consumer = F.col("merged_assay_id"), F.col("consumer_specimen_id")
    shape = (
        F.when(F.col("source_assay_id").isNull(), "source_missing")
        .when(merged.isNotNull() & consumer.isNotNull(), "two_targets")
        .when(merged.isNull() & consumer.isNull(), "no_target")
        .when(merged == F.col("source_assay_id"), "self_edge")
    )
    shaped = rows.select(*key).withColumn("reject", shape)
    sound = shaped.filter(F.col("reject").isNull()).drop("reject")

    # A sound row has one target, so both kinds are looked up at once and no NULL key is shuffled.
    there = F.lit(True)
    assay_ids = assays.select("assay_id").distinct()
    sources = assay_ids.select(F.col("assay_id").alias("source_assay_id"), there.alias("_source"))
    targets = assay_ids.select(F.lit("assay").alias("_kind"), F.col("assay_id").alias("_target")).unionByName(
        specimens.select(F.lit("specimen").alias("_kind"), F.col("specimen_id").alias("_target")).distinct()
    ).withColumn("_there", there)
    reason = F.when(F.col("_source").isNull(), "unknown_source").when(
        F.col("_there").isNull(), F.when(merged.isNotNull(), "unknown_merged_assay").otherwise("unknown_specimen")
    )
    looked_up = (
        sound.withColumn("_kind", F.when(merged.isNotNull(), "assay").otherwise("specimen"))
        .withColumn("_target", F.coalesce(merged, consumer))
        .join(sources, "source_assay_id", "left")
        .join(targets, ["_kind", "_target"], "left")
        .select(*key, reason.alias("reject"))
    )
    # Written once, because the edges, their number and the rejects are all read from it.
    checked = cut(shaped.filter(F.col("reject").isNotNull()).unionByName(looked_up))
    good = checked.filter(F.col("reject").isNull()).select(*key)
    rejects = checked.filter(F.col("reject").isNotNull())
    fresh = null_safe_anti(good.distinct(), assay_sources, key)
    return {
        "assay_sources": assay_sources.unionByName(fresh, allowMissingColumns=True),
        "added": fresh,
        "n_valid": good.agg(F.count(F.lit(1)).alias("n_valid")),
        "rejects": rejects,
    }


def upsert_batches(batches: DataFrame, rows: DataFrame, order_col: str | None = None) -> DataFrame:
    """Replace whole batch rows; columns not given become NULL.

    With ``order_col`` the last row of a repeated key wins.
    """
    rest = [c for c in rows.columns if c not in ("batch_id", order_col)]
    order = F.col(order_col) if order_col else F.struct(*rest)
    last = (
        rows.groupBy("batch_id")
        .agg(F.max_by(F.struct(*rest), order).alias("_row"))
        .select("batch_id", *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
    return batches.join(last.select("batch_id"), "batch_id", "left_anti").unionByName(
        last, allowMissingColumns=True
    )

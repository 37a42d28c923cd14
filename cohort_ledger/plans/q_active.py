"""Cascade filters, views and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.operators import active, graph, views
from cohort_ledger.plans.dataset import Model
from cohort_ledger.plans.registry import query


@query("active_assays", "SELECT assay_id, specimen_id, qc_status FROM active_a")
def _(m: Model) -> DataFrame:
    return active.active_assays(*m.levels).select("assay_id", "specimen_id", "qc_status")


@query("active_specimens", "SELECT specimen_id, patient_id, qc_status FROM active_s")
def _(m: Model) -> DataFrame:
    return active.active_specimens(m.patients, m.specimens).select(
        "specimen_id", "patient_id", "qc_status"
    )


@query("active_patients", "SELECT patient_id, qc_status, consent_status FROM active_p")
def _(m: Model) -> DataFrame:
    return active.active_patients(m.patients).select("patient_id", "qc_status", "consent_status")


@query(
    "active_include_censored",
    """SELECT a.assay_id FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       WHERE a.qc_status <> 'consent_revoked' AND s.qc_status <> 'consent_revoked'
         AND p.qc_status <> 'consent_revoked' AND p.consent_status IN ('consented', 'consented_limited_use')""",
)
def _(m: Model) -> DataFrame:
    return active.active_assays(*m.levels, include_censored=True).select("assay_id")


@query(
    "active_include_consent_revoked",
    """SELECT a.assay_id FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       WHERE a.qc_status NOT IN ('fail', 'censored', 'consent_revoked')
         AND s.qc_status NOT IN ('fail', 'censored', 'consent_revoked')
         AND p.qc_status NOT IN ('fail', 'censored', 'consent_revoked')""",
)
def _(m: Model) -> DataFrame:
    return active.active_assays(*m.levels, include_consent_revoked=True).select("assay_id")


@query(
    "exclusion_breakdown",
    """SELECT CASE qc_status WHEN 'fail' THEN 'qc_failed_assay' ELSE 'censored_assay' END AS reason,
              'assay' AS level, assay_id AS id FROM assays WHERE qc_status IN ('fail', 'censored')
       UNION ALL SELECT 'consent_revoked_patient', 'patient', patient_id FROM patients
                 WHERE consent_status NOT IN ('consented', 'consented_limited_use')
       UNION ALL SELECT 'consent_revoked_assay', 'assay', a.assay_id
                 FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
                 WHERE p.consent_status NOT IN ('consented', 'consented_limited_use')""",
)
def _(m: Model) -> DataFrame:
    return active.exclusion_breakdown(*m.levels)


@query(
    "exclusion_reason",
    """SELECT a.assay_id,
              CASE WHEN a.qc_status IN ('fail', 'censored', 'consent_revoked') THEN 'assay_qc'
                   WHEN s.qc_status IN ('fail', 'censored', 'consent_revoked') THEN 'specimen_qc'
                   WHEN p.qc_status IN ('fail', 'censored', 'consent_revoked') THEN 'patient_qc'
                   ELSE 'consent' END AS reason
       FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       WHERE NOT EXISTS (SELECT 1 FROM active_a x WHERE x.assay_id = a.assay_id)""",
)
def _(m: Model) -> DataFrame:
    return active.exclusion_reason(*m.levels)


@query("rerun_missing", "SELECT assay_id FROM active_a WHERE flagstat_done IS NULL")
def _(m: Model) -> DataFrame:
    return active.rerun_missing("flagstat", "assay", *m.levels)


@query("rerun_missing_specimen", "SELECT specimen_id FROM specimens WHERE merge_done IS NULL")
def _(m: Model) -> DataFrame:
    return active.rerun_missing("merge", "specimen", *m.levels)


@query(
    "rerun_missing_flat",
    "SELECT doc_id FROM doc_rows WHERE quality IS NULL",
)
def _(m: Model) -> DataFrame:
    manifest = m.raw("documents").select("doc_id").join(
        m.raw("labels").select("doc_id", F.col("quality").alias("label_done")), "doc_id", "left"
    )
    return active.rerun_missing_flat(manifest, "label", "doc_id")


@query(
    "rerun_with_sources",
    """SELECT DISTINCT s.source_assay_id FROM sources s
       WHERE s.merged_assay_id IN (SELECT assay_id FROM active_a WHERE flagstat_done IS NULL)""",
)
def _(m: Model) -> DataFrame:
    missing = active.rerun_missing("flagstat", "assay", *m.levels)
    return active.rerun_with_sources(missing, "assay", m.assay_sources)


@query(
    "rerun_with_sources_specimen",
    """SELECT DISTINCT s.source_assay_id FROM sources s
       WHERE s.consumer_specimen_id IN (SELECT specimen_id FROM specimens WHERE merge_done IS NULL)""",
)
def _(m: Model) -> DataFrame:
    missing = active.rerun_missing("merge", "specimen", *m.levels)
    return active.rerun_with_sources(missing, "specimen", m.assay_sources)


@query(
    "pending_work",
    """SELECT a.assay_id, a.specimen_id, s.patient_id
       FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       WHERE a.qc_status = 'pass' AND a.modkit_done IS NULL""",
)
def _(m: Model) -> DataFrame:
    return active.pending_work("modkit", *m.levels).select("assay_id", "specimen_id", "patient_id")


@query(
    "log_filter",
    """SELECT CAST(seq AS BIGINT) AS seq, entity_id, kind FROM (
         SELECT 2 * seq AS seq, entity_id, kind, created_at AS stamp FROM qc_events WHERE level = 'specimen'
         UNION ALL SELECT 2 * (seq + 333) + 1, entity_id, kind, resolved_at FROM qc_events
                   WHERE level = 'specimen' AND resolved_at IS NOT NULL)
       ORDER BY strftime(stamp, '%Y-%m-%dT%H:%M:%S') DESC, seq DESC LIMIT 200""",
)
def _(m: Model) -> DataFrame:
    return active.log_filter(m.qc_log, level="specimen", last=200).select("seq", "entity_id", "kind")


@query(
    "project_filter",
    """SELECT n_name AS project FROM nation WHERE n_regionkey % 3 <> 1""",
)
def _(m: Model) -> DataFrame:
    return active.project_filter(m.projects, ("active", "complete")).select("project")


@query(
    "joined",
    """SELECT a.assay_id, a.specimen_id, s.patient_id, a.qc_status AS assay_qc_status,
              s.qc_status AS specimen_qc_status, p.qc_status AS patient_qc_status,
              a.assay_type, s.tissue_site, p.cohort
       FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)""",
)
def _(m: Model) -> DataFrame:
    return views.joined(*m.levels).select(
        "assay_id", "specimen_id", "patient_id", "assay_qc_status", "specimen_qc_status",
        "patient_qc_status", "assay_type", "tissue_site", "cohort",
    )


@query(
    "active",
    """SELECT a.assay_id, s.patient_id, a.assay_type, s.tissue_site, p.cohort
       FROM active_a a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)""",
)
def _(m: Model) -> DataFrame:
    return views.active(*m.levels).select(
        "assay_id", "patient_id", "assay_type", "tissue_site", "cohort"
    )


@query(
    "cohort_artifacts_view",
    """SELECT a.artifact_id, a.analysis, a.run_tag, a.region_scope,
              coalesce(r.ref_key, '') AS scope_ref_key,
              d.stale_inputs AS n_censored_inputs, d.stale_inputs > 0 AS stale,
              d.stale_refs > 0 AS ref_stale, n.node IS NOT NULL AS derived_stale
       FROM artifacts a JOIN direct d ON d.node = a.node
       LEFT JOIN stale_nodes n ON n.node = a.node
       LEFT JOIN refs r ON r.ref_key = a.region_scope""",
)
def _(m: Model) -> DataFrame:
    out = views.cohort_artifacts_view(
        m.cohort_artifacts, m.cohort_artifact_inputs, *m.levels, m.reference_usage,
        m.reference_artifacts, m.artifact_derivation,
    )
    return out.withColumn("scope_ref_key", F.coalesce("scope_ref_key", F.lit("")))


@query(
    "reference_usage_view",
    """SELECT artifact_id, ref_key, version_used, coalesce(current_version, '') AS current_version, is_stale
       FROM usage_now""",
)
def _(m: Model) -> DataFrame:
    return views.reference_usage_view(m.reference_usage, m.reference_artifacts).select(
        "artifact_id", "ref_key", "version_used",
        F.coalesce("current_version", F.lit("")).alias("current_version"), "is_stale",
    )


@query(
    "derivation_view",
    """SELECT d.down_node, d.up_node, n.node IS NOT NULL AS down_derived_stale
       FROM derivation d LEFT JOIN stale_nodes n ON n.node = d.down_node""",
)
def _(m: Model) -> DataFrame:
    direct = graph.direct_staleness(
        m.cohort_artifacts, m.cohort_artifact_inputs, *m.input_levels, m.reference_usage,
        m.reference_artifacts,
    )
    edges = graph.combined_edges(m.artifact_derivation, m.reference_usage, m.cohort_artifacts)
    derived = graph.derived_stale_nodes(edges, direct.filter("directly_stale"))
    return views.derivation_view(m.artifact_derivation, derived)


@query(
    "rollup_join",
    """SELECT p.patient_id, count(DISTINCT s.specimen_id) AS n_specimens, count(a.assay_id) AS n_assays
       FROM patients p LEFT JOIN specimens s ON s.patient_id = p.patient_id
       LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY p.patient_id""",
)
def _(m: Model) -> DataFrame:
    return views.rollup_join(*m.levels, "patient")


@query(
    "batch_sizes",
    """SELECT b.batch_id, b.operator, count(a.assay_id) AS n_assays
       FROM batches b LEFT JOIN assays a ON a.batch_id = b.batch_id GROUP BY b.batch_id, b.operator""",
)
def _(m: Model) -> DataFrame:
    return views.batch_sizes(m.batches, m.assays)


@query(
    "lineage_listing",
    """SELECT CASE WHEN consumer_specimen_id IS NOT NULL THEN 'specimen' ELSE 'merged_assay' END AS target_kind,
              coalesce(consumer_specimen_id, merged_assay_id) AS target_id, source_assay_id FROM sources""",
)
def _(m: Model) -> DataFrame:
    return views.lineage_listing(m.assay_sources)


@query(
    "patient_drill",
    """WITH nodes AS (
         SELECT patient_id, '' AS specimen_id, '' AS assay_id, 'patient' AS record, patient_id AS record_id, qc_status
         FROM patients
         UNION ALL SELECT patient_id, specimen_id, '', 'specimen', specimen_id, qc_status FROM specimens
         UNION ALL SELECT s.patient_id, s.specimen_id, a.assay_id, 'assay', a.assay_id, a.qc_status
                   FROM assays a JOIN specimens s USING (specimen_id))
       SELECT * FROM nodes
       UNION ALL SELECT n.patient_id, n.specimen_id, n.assay_id, 'event', e.id, e.kind
                 FROM nodes n JOIN qc_events e ON e.level = n.record AND e.entity_id = n.record_id""",
)
def _(m: Model) -> DataFrame:
    return views.patient_drill(*m.levels, m.qc_events).fillna("", ["specimen_id", "assay_id"])


@query(
    "merge_left",
    "SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM doc_rows",
)
def _(m: Model) -> DataFrame:
    out = views.merge_left(
        m.raw("documents").select("doc_id", "lang"), m.raw("labels").select("doc_id", "quality"), "doc_id"
    )
    return out.fillna(-1, ["quality"])


@query(
    "merge_outer",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.lang, '') AS lang,
              coalesce(l.toxic, -1) AS toxic
       FROM (SELECT CASE WHEN lang <> 'en' THEN doc_id ELSE -1 - doc_id END AS doc_id, lang FROM documents) d
       FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(m: Model) -> DataFrame:
    others = m.raw("documents").selectExpr("CASE WHEN lang <> 'en' THEN doc_id ELSE -1 - doc_id END AS doc_id", "lang")
    out = views.merge_outer(others, m.raw("labels").select("doc_id", "toxic"), "doc_id")
    return out.fillna("", ["lang"]).fillna(-1, ["toxic"])


@query(
    "sql_graph_views",
    """SELECT a.analysis, count(*) AS n, CAST(count(*) FILTER (WHERE d.stale_inputs > 0) AS BIGINT) AS stale,
              CAST(count(*) FILTER (WHERE n.node IS NOT NULL) AS BIGINT) AS derived,
              (SELECT count(*) FROM usage_now WHERE is_stale) AS stale_uses,
              (SELECT count(*) FROM derivation e JOIN stale_nodes x ON x.node = e.down_node) AS derived_edges
       FROM artifacts a JOIN direct d ON d.node = a.node LEFT JOIN stale_nodes n ON n.node = a.node GROUP BY a.analysis""",
)
def _(m: Model) -> DataFrame:
    views.register_views(
        m.spark, *m.levels, artifacts=m.cohort_artifacts, inputs=m.cohort_artifact_inputs, usage=m.reference_usage,
        references=m.reference_artifacts, derivation=m.artifact_derivation,
    )
    return m.spark.sql(
        """SELECT analysis, count(*) AS n, count_if(stale) AS stale, count_if(derived_stale) AS derived,
                  (SELECT count(*) FROM _reference_usage WHERE is_stale) AS stale_uses,
                  (SELECT count(*) FROM _artifact_derivation WHERE down_derived_stale) AS derived_edges
           FROM _cohort_artifacts GROUP BY analysis"""
    )


@query(
    "sql_views",
    """SELECT p.cohort, s.tissue_site, count(*) AS n_assays, sum(a.n_reads) AS reads
       FROM active_a a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       GROUP BY p.cohort, s.tissue_site""",
)
def _(m: Model) -> DataFrame:
    views.register_views(m.spark, *m.levels)
    return m.spark.sql(
        "SELECT cohort, tissue_site, count(*) AS n_assays, sum(n_reads) AS reads "
        "FROM _active GROUP BY cohort, tissue_site"
    )


@query(
    "sql_rollup",
    """SELECT coalesce(p.cohort, 'all') AS cohort, coalesce(s.tissue_site, 'all') AS tissue_site,
              count(*) AS n_assays
       FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
       GROUP BY ROLLUP (p.cohort, s.tissue_site)""",
)
def _(m: Model) -> DataFrame:
    views.register_views(m.spark, *m.levels)
    return m.spark.sql(
        "SELECT coalesce(cohort, 'all') AS cohort, coalesce(tissue_site, 'all') AS tissue_site, "
        "count(*) AS n_assays FROM `_` GROUP BY ROLLUP (cohort, tissue_site)"
    )

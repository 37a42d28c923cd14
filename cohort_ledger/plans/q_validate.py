"""Integrity check queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.model import DEFAULT_SCHEMA, ColumnSpec
from cohort_ledger.operators import validate
from cohort_ledger.plans.dataset import Model
from cohort_ledger.plans.q_graph import RING_SQL, _ringed
from cohort_ledger.plans.q_status import job_log
from cohort_ledger.plans.registry import query
from cohort_ledger.session import cut


def _with_columns(level: str, *columns: ColumnSpec):
    levels = [
        replace(lv, columns=lv.columns + columns) if lv.name == level else lv
        for lv in DEFAULT_SCHEMA.levels
    ]
    return replace(DEFAULT_SCHEMA, levels=tuple(levels))


@query(
    "fk_orphans",
    """SELECT 'specimens' AS "table", specimen_id AS "key", patient_id AS detail FROM specimens
       WHERE patient_id IN (SELECT patient_id FROM patients WHERE cohort = 'BUILDING')
       UNION ALL SELECT 'assays', assay_id, specimen_id FROM assay_rows
       WHERE specimen_id NOT IN (SELECT specimen_id FROM specimens)""",
)
def _(m: Model) -> DataFrame:
    tables = dict(m.tables)
    tables["patient"] = m.patients.filter("cohort <> 'BUILDING'")
    return validate.fk_orphans(tables).select("table", "key", "detail")


@query(
    "done_without_data",
    """SELECT 'assays' AS "table", 'flagstat_done' AS "key", CAST(count(flagstat_done) AS VARCHAR) AS detail FROM assays
       UNION ALL SELECT 'assays', 'modkit_done', CAST(count(modkit_done) AS VARCHAR) FROM assays""",
)
def _(m: Model) -> DataFrame:
    from cohort_ledger.operators.status import analysis_columns

    # The log adds a data column for ``merge`` only.
    columns = analysis_columns(job_log(m))
    out = validate.done_without_data(m.tables, columns)
    return out.select("table", "key", "detail")


@query(
    "consent_invariants",
    """SELECT patient_id AS "key", 'missing_consent_revoked_event' AS detail FROM patients p
       WHERE consent_status = 'revoked' AND NOT EXISTS (
         SELECT 1 FROM active_events a WHERE a.level = 'patient' AND a.kind = 'consent_revoked' AND a.entity_id = p.patient_id)
       UNION ALL SELECT patient_id, 'missing_withdrawal_date' FROM patients
       WHERE consent_status IN ('revoked', 'withdrawn', 'consent_expired') AND withdrawal_date IS NULL""",
)
def _(m: Model) -> DataFrame:
    return validate.consent_invariants(m.patients, m.qc_events).select("key", "detail")


@query(
    "orphan_events",
    """SELECT id AS "key", level || ' ' || entity_id AS detail FROM active_events
       WHERE (level = 'patient' AND entity_id NOT IN (SELECT patient_id FROM patients WHERE cohort <> 'BUILDING'))
          OR (level = 'specimen' AND entity_id NOT IN (SELECT specimen_id FROM specimens))
          OR (level = 'assay' AND entity_id NOT IN (SELECT assay_id FROM assay_rows))""",
)
def _(m: Model) -> DataFrame:
    tables = dict(m.tables)
    tables["patient"] = m.patients.filter("cohort <> 'BUILDING'")
    return validate.orphan_events(m.qc_events, tables).select("key", "detail")


@query(
    "status_mismatch",
    """SELECT 'patients' AS "table", patient_id AS "key" FROM patients WHERE qc_status <> 'pass'
       UNION ALL SELECT 'assays', assay_id FROM assays WHERE assay_type = 'N'""",
)
def _(m: Model) -> DataFrame:
    tables = dict(m.tables)
    tables["patient"] = m.patients.withColumn("qc_status", F.lit("pass"))
    tables["assay"] = m.assays.withColumn(
        "qc_status", F.when(F.col("assay_type") != "N", F.col("qc_status"))
    )
    return validate.status_mismatch(tables, m.qc_events).select("table", "key")


@query(
    "lineage_orphans",
    """SELECT source_assay_id AS "key", 'source_assay_id' AS detail FROM sources
       WHERE source_assay_id IN (SELECT assay_id FROM assay_rows WHERE n_reads < 3)
       UNION ALL SELECT merged_assay_id, 'merged_assay_id' FROM sources
       WHERE merged_assay_id IN (SELECT assay_id FROM assay_rows WHERE n_reads < 3)
       UNION ALL SELECT consumer_specimen_id, 'consumer_specimen_id' FROM sources
       WHERE consumer_specimen_id IN (SELECT specimen_id FROM specimens WHERE tissue_site = 'P')""",
)
def _(m: Model) -> DataFrame:
    known = m.specimen_rows.filter("tissue_site <> 'P'")
    return validate.lineage_orphans(m.assay_sources, m.assay_rows.filter("n_reads >= 3"), known).select(
        "key", "detail"
    )


@query(
    "batch_orphans",
    """SELECT assay_id AS "key", batch_id AS detail FROM assay_rows
       WHERE batch_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 1000)""",
)
def _(m: Model) -> DataFrame:
    known = m.raw("supplier").filter("s_acctbal >= 1000").select(
        F.col("s_suppkey").cast("string").alias("batch_id")
    )
    return validate.batch_orphans(m.assay_rows, known).select("key", "detail")


@query("ref_orphans", """SELECT DISTINCT ref_key AS "key" FROM usage_now WHERE current_version IS NULL""")
def _(m: Model) -> DataFrame:
    return validate.ref_orphans(m.reference_usage, m.reference_artifacts).select("key")


@query(
    "dangling_nodes",
    """SELECT DISTINCT node AS "key" FROM artifacts WHERE region_scope = 'PROMO'
         AND (node IN (SELECT down_node FROM derivation) OR node IN (SELECT up_node FROM derivation))
       UNION SELECT o_orderpriority FROM orders
       UNION SELECT 'reference:' || n_name FROM nation WHERE n_regionkey = 1
       UNION SELECT 'analysis:specimen/x' || o_orderkey || '/merge' FROM orders""",
)
def _(m: Model) -> DataFrame:
    orders = m.raw("orders")
    odd = orders.select(
        F.concat(F.lit("analysis:specimen/x"), F.col("o_orderkey").cast("string"), F.lit("/merge")).alias("down_node"),
        F.col("o_orderpriority").alias("up_node"),
    )
    fine = orders.select(
        F.concat(F.lit("analysis:specimen/"), F.col("o_orderkey").cast("string"), F.lit("/merge")).alias("down_node"),
        F.concat(F.lit("reference:NATION_"), (F.col("o_orderkey") % 25).cast("string")).alias("up_node"),
    )
    refs = m.raw("nation").select(
        F.concat(F.lit("reference:"), "n_name").alias("down_node"),
        F.concat(F.lit("reference:"), "n_name").alias("up_node"),
    )
    edges = m.artifact_derivation.unionByName(odd).unionByName(fine).unionByName(refs)
    known_refs = m.raw("nation").filter("n_regionkey <> 1").select(F.col("n_name").alias("ref_key"))
    artifacts = m.cohort_artifacts.filter("region_scope <> 'PROMO'")
    return validate.dangling_nodes(edges, artifacts, known_refs, m.tables).select("key")


@query("acyclic", "WITH " + RING_SQL + """
    SELECT down_node AS "key", up_node AS detail FROM ring WHERE grp % 2 = 0""")
def _(m: Model) -> DataFrame:
    return validate.acyclic(_ringed(m), m.reference_usage, m.cohort_artifacts).select("key", "detail")


@query(
    "flat_keys",
    """SELECT 'duplicate_key' AS "check", CAST(user_id AS VARCHAR) AS "key", CAST(count(*) AS VARCHAR) AS detail
       FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING count(*) > 1
       UNION ALL SELECT 'null_key', 'user_id', CAST(count(*) AS VARCHAR) FROM events WHERE event_type = 'view'""",
)
def _(m: Model) -> DataFrame:
    manifest = m.raw("events").select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"), "value"
    )
    return validate.flat_keys(manifest, "user_id").select("check", "key", "detail")


@query(
    "flat_empty_columns",
    """SELECT * FROM (VALUES ('nothing'), ('never')) t("key") WHERE (SELECT count(*) FROM documents) > 0""",
)
def _(m: Model) -> DataFrame:
    manifest = m.raw("documents").select(
        "doc_id", "lang",
        F.when(F.col("n_chars") < 0, "x").alias("nothing"),
        F.when(F.col("doc_id") < 0, "x").alias("never"),
    )
    return validate.flat_empty_columns(manifest).select("key")


ODD_IDS_SQL = """
    odd AS (
      SELECT p_partkey,
             CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN '..' WHEN 2 THEN '   ' WHEN 3 THEN '-' || p_brand
                  WHEN 4 THEN 'P' || p_partkey WHEN 5 THEN repeat('x', 70) || p_partkey WHEN 6 THEN '##'
                  END AS id
      FROM part)
"""


def _odd_ids(m: Model) -> DataFrame:
    turn = F.col("p_partkey") % 8
    key = F.col("p_partkey").cast("string")
    return m.raw("part").select(
        "p_partkey",
        F.when(turn == 0, F.col("p_name")).when(turn == 1, "..").when(turn == 2, "   ")
        .when(turn == 3, F.concat(F.lit("-"), "p_brand")).when(turn == 4, F.concat(F.lit("P"), key))
        .when(turn == 5, F.concat(F.lit("x" * 70), key)).when(turn == 6, "##")
        .alias("patient_id"),
    )


@query(
    "id_format",
    "WITH " + ODD_IDS_SQL + """
       SELECT coalesce(id, '~') AS "key",
              CASE WHEN id IS NULL THEN 'null' WHEN trim(id) = '' THEN 'blank' WHEN id = '..' THEN 'reserved_literal'
                   ELSE 'default_pattern' END AS detail,
              CASE WHEN p_partkey % 8 = 0 THEN replace(id, ' ', '_') WHEN p_partkey % 8 = 3 THEN replace(substr(id, 2), '#', '_')
                   WHEN p_partkey % 8 = 5 THEN substr(id, 1, 64) ELSE '~' END AS suggestion
       FROM odd WHERE id IS NULL OR NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9_.-]{0,63}')""",
)
def _(m: Model) -> DataFrame:
    tables = dict(m.tables)
    tables["patient"] = _odd_ids(m)
    return validate.id_format(tables).select("key", "detail", "suggestion").fillna("~")


@query(
    "id_suggest",
    "WITH " + ODD_IDS_SQL + """
       SELECT p_partkey,
              CASE p_partkey % 8 WHEN 0 THEN replace(id, ' ', '_') WHEN 3 THEN replace(substr(id, 2), '#', '_')
                   WHEN 4 THEN id WHEN 5 THEN substr(id, 1, 64) ELSE '~' END AS suggestion FROM odd""",
)
def _(m: Model) -> DataFrame:
    return validate.id_suggest(_odd_ids(m), "patient_id").select("p_partkey", "suggestion").fillna("~")


@query(
    "case_variants",
    """SELECT lower(c_name) AS "key" FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(m: Model) -> DataFrame:
    tables = dict(m.tables)
    names = m.raw("customer").select(F.col("c_name").alias("patient_id"), "c_mktsegment")
    shouted = names.filter("c_mktsegment = 'BUILDING'").withColumn("patient_id", F.upper("patient_id"))
    tables["patient"] = names.unionByName(shouted)
    return validate.case_variants(tables).select("key")


@query(
    "constraints",
    """SELECT 'patients' AS "table", c_mktsegment AS "key", 'unique:cohort' AS detail FROM customer GROUP BY 2 HAVING count(*) > 1
       UNION ALL SELECT 'patients', CAST(c_custkey AS VARCHAR), 'not_null:site' FROM customer WHERE c_nationkey % 5 = 0
       UNION ALL SELECT 'patients', CAST(c_custkey AS VARCHAR), 'enum:cohort' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')""",
)
def _(m: Model) -> DataFrame:
    levels = list(DEFAULT_SCHEMA.levels)
    levels[0] = replace(
        levels[0],
        columns=(
            ColumnSpec("cohort", unique=True, enum=("BUILDING", "MACHINERY")),
            ColumnSpec("site", required=True),
        ),
    )
    tables = m.level_rows
    tables["patient"] = m.patient_rows.withColumn(
        "site", F.when(F.col("site").cast("int") % 5 != 0, F.col("site"))
    )
    out = validate.constraints(tables, replace(DEFAULT_SCHEMA, levels=tuple(levels)))
    return out.select("table", "key", "detail")


@query(
    "validate_all",
    """SELECT 'consent_invariant' AS "check", (SELECT count(*) FROM patients p WHERE consent_status = 'revoked' AND NOT EXISTS (
                SELECT 1 FROM active_events a WHERE a.level = 'patient' AND a.kind = 'consent_revoked' AND a.entity_id = p.patient_id))
              + (SELECT count(*) FROM patients WHERE consent_status IN ('revoked', 'withdrawn', 'consent_expired')
                 AND withdrawal_date IS NULL) AS n
       UNION ALL SELECT 'ref_orphan', count(DISTINCT ref_key) FROM usage_now WHERE current_version IS NULL""",
)
def _(m: Model) -> DataFrame:
    if not m.mapped_folder:  # nearly every check reads a level or the events
        m.qc_events = cut(m.qc_events)
        m.patients, m.specimens, m.assays = (cut(t) for t in m.levels)
        m.assay_rows = m.assays.drop("qc_status")
    issues = validate.validate_all(
        m.tables, m.qc_events, m.batches, m.assay_sources, m.reference_usage,
        m.reference_artifacts, m.cohort_artifacts, m.artifact_derivation,
    )
    return issues.groupBy("check").agg(F.count(F.lit(1)).alias("n"))

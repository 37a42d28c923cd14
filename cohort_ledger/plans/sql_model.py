"""The cohort model as SQL, one named subquery per table.

``with_model`` puts the subqueries a statement mentions, and those they need in
turn, in front of it.
"""

from __future__ import annotations

import re

OK = "('fail', 'censored', 'consent_revoked')"
CONSENT = "('consented', 'consented_limited_use')"

TABLES = {
    "assay_rows": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS assay_id,
               CAST(l_orderkey AS VARCHAR) AS specimen_id,
               min(l_returnflag) AS assay_type,
               CAST(l_suppkey AS VARCHAR) AS batch_id,
               min(l_quantity) AS n_reads,
               CASE WHEN min(l_linestatus) = 'F' THEN min(l_shipdate) END AS flagstat_done,
               CASE WHEN min(l_quantity) > 10 THEN min(l_shipdate) END AS modkit_done,
               CAST(l_partkey AS VARCHAR) AS part_id, l_linenumber AS line
        FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey""",
    "event_rows": """
        SELECT event_id,
               CASE event_id % 3 WHEN 0 THEN 'patient' WHEN 1 THEN 'specimen' ELSE 'assay' END AS level,
               user_id, event_type, ts
        FROM events""",
    "qc_events": """
        SELECT CAST(e.event_id AS VARCHAR) AS id, e.level AS level,
               CASE e.level WHEN 'patient' THEN CAST(e.user_id AS VARCHAR)
                            WHEN 'specimen' THEN CAST(e.event_id AS VARCHAR)
                            ELSE f.first_assay END AS entity_id,
               CASE e.event_type
                    WHEN 'error' THEN CASE WHEN e.level = 'patient' THEN 'consent_revoked' ELSE 'qc_fail' END
                    WHEN 'purchase' THEN 'qc_warn'
                    WHEN 'signup' THEN 'other'
                    WHEN 'click' THEN CASE WHEN e.level = 'patient' THEN 'qc_fail' ELSE 'protocol_deviation' END
                    WHEN 'view' THEN 'batch_effect_flagged' END AS kind,
               'reported as ' || e.event_type AS reason,
               e.ts AS created_at,
               CASE WHEN e.event_id % 10 <> 0 THEN e.ts + INTERVAL 1 DAY END AS resolved_at,
               e.event_id AS seq
        FROM event_rows e
        LEFT JOIN (SELECT specimen_id, min(assay_id) AS first_assay FROM assay_rows GROUP BY specimen_id) f
          ON e.level = 'assay' AND f.specimen_id = CAST(e.event_id AS VARCHAR)
        WHERE e.level <> 'assay' OR f.first_assay IS NOT NULL""",
    "active_events": "SELECT * FROM qc_events WHERE resolved_at IS NULL",
    "statuses": """
        SELECT level, entity_id,
               CASE max(CASE WHEN kind IN ('qc_fail', 'library_prep_failed', 'basecall_accuracy_low',
                                           'sequencing_run_failed', 'contamination', 'protocol_deviation') THEN 3
                             WHEN kind IN ('qc_warn', 'batch_effect_flagged') THEN 1
                             WHEN kind = 'consent_revoked' AND level = 'patient' THEN 4
                             ELSE 2 END)
                    WHEN 1 THEN 'warn' WHEN 2 THEN 'censored' WHEN 3 THEN 'fail'
                    ELSE 'consent_revoked' END AS qc_status
        FROM active_events GROUP BY level, entity_id""",
    "patients": """
        SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment AS cohort,
               CAST(c_nationkey AS VARCHAR) AS site,
               CASE c_custkey % 20 WHEN 0 THEN 'revoked' WHEN 1 THEN 'pending'
                    WHEN 2 THEN 'consented_limited_use' WHEN 3 THEN 'withdrawn' ELSE 'consented' END AS consent_status,
               CASE WHEN c_custkey % 20 IN (0, 3) AND c_custkey % 60 <> 0 THEN DATE '2024-05-01' END AS withdrawal_date,
               coalesce(s.qc_status, 'pass') AS qc_status
        FROM customer LEFT JOIN statuses s ON s.level = 'patient' AND s.entity_id = CAST(c_custkey AS VARCHAR)""",
    "specimens": """
        SELECT CAST(o_orderkey AS VARCHAR) AS specimen_id, CAST(o_custkey AS VARCHAR) AS patient_id,
               o_orderstatus AS tissue_site, o_orderpriority AS timepoint, o_orderdate AS collection_date,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS merge_done,
               coalesce(s.qc_status, 'pass') AS qc_status
        FROM orders LEFT JOIN statuses s ON s.level = 'specimen' AND s.entity_id = CAST(o_orderkey AS VARCHAR)""",
    "assays": """
        SELECT a.*, coalesce(s.qc_status, 'pass') AS qc_status
        FROM assay_rows a LEFT JOIN statuses s ON s.level = 'assay' AND s.entity_id = a.assay_id""",
    "batches": "SELECT CAST(s_suppkey AS VARCHAR) AS batch_id, s_name AS operator FROM supplier",
    "artifacts": """
        SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, p_brand AS analysis,
               'r' || CAST(p_partkey AS VARCHAR) AS run_tag, p_type AS region_scope,
               'cohort:' || p_brand || '@r' || CAST(p_partkey AS VARCHAR) AS node
        FROM part""",
    "artifact_inputs": """
        SELECT part_id AS artifact_id, assay_id FROM assay_rows WHERE line = 1 AND n_reads > 25""",
    "refs": "SELECT n_name AS ref_key, 'v' || CAST(n_regionkey AS VARCHAR) AS version FROM nation",
    "usage": """
        SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, p_brand AS analysis,
               coalesce(n_name, 'REMOVED') AS ref_key,
               CASE WHEN p_partkey % 10 = 0 THEN 'v_old'
                    ELSE 'v' || CAST(coalesce(n_regionkey, 0) AS VARCHAR) END AS version_used
        FROM part LEFT JOIN nation ON n_nationkey = p_size % 27""",
    "usage_now": """
        SELECT u.*, r.version AS current_version,
               (r.version IS NULL OR r.version <> u.version_used) AS is_stale
        FROM usage u LEFT JOIN refs r ON r.ref_key = u.ref_key""",
    "derivation": """
        SELECT d.node AS down_node, u.node AS up_node
        FROM artifacts d JOIN artifacts u
          ON CAST(u.artifact_id AS BIGINT) = CAST(d.artifact_id AS BIGINT) // 2
        WHERE CAST(d.artifact_id AS BIGINT) > 0 AND CAST(d.artifact_id AS BIGINT) % 4 <> 0""",
    "sources": """
        SELECT a.assay_id AS source_assay_id, f.merged AS merged_assay_id,
               CAST(NULL AS VARCHAR) AS consumer_specimen_id
        FROM assay_rows a
        JOIN (SELECT specimen_id, line, min(assay_id) AS merged FROM assay_rows GROUP BY specimen_id, line) f
          ON f.specimen_id = a.specimen_id AND f.line = a.line - 1
        UNION ALL
        SELECT assay_id, NULL, specimen_id FROM assay_rows WHERE line = 1""",
    "active_p": f"SELECT * FROM patients WHERE qc_status NOT IN {OK} AND consent_status IN {CONSENT}",
    "active_s": f"""
        SELECT s.* FROM specimens s JOIN active_p p ON p.patient_id = s.patient_id
        WHERE s.qc_status NOT IN {OK}""",
    "active_a": f"""
        SELECT a.* FROM assays a JOIN active_s s ON s.specimen_id = a.specimen_id
        WHERE a.qc_status NOT IN {OK}""",
    "bad_inputs": """
        SELECT i.* FROM artifact_inputs i
        WHERE NOT EXISTS (SELECT 1 FROM active_a a WHERE a.assay_id = i.assay_id)""",
    "edges": """
        SELECT down_node, up_node FROM derivation
        UNION SELECT a.node, 'reference:' || u.ref_key FROM usage u JOIN artifacts a ON a.artifact_id = u.artifact_id""",
    "direct": """
        SELECT a.node AS node, coalesce(i.n, 0) AS stale_inputs, coalesce(r.n, 0) AS stale_refs
        FROM artifacts a
        LEFT JOIN (SELECT artifact_id, count(*) AS n FROM bad_inputs GROUP BY artifact_id) i
               ON i.artifact_id = a.artifact_id
        LEFT JOIN (SELECT artifact_id, count(*) AS n FROM usage_now WHERE is_stale GROUP BY artifact_id) r
               ON r.artifact_id = a.artifact_id
        UNION ALL SELECT 'reference:' || ref_key, 0, 0 FROM refs""",
    "reach": """
        SELECT down_node AS node, up_node AS upstream FROM edges
        UNION
        SELECT r.node, e.up_node FROM reach r JOIN edges e ON e.down_node = r.upstream""",
    "stale_nodes": """
        SELECT DISTINCT r.node FROM reach r JOIN direct d ON d.node = r.upstream
        WHERE d.stale_inputs > 0 OR d.stale_refs > 0""",
    "done_pivot": """
        SELECT assay_id, 'flagstat' AS analysis, flagstat_done AS done FROM assays
        UNION ALL SELECT assay_id, 'modkit', modkit_done FROM assays""",
    "doc_rows": """
        SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "sheet": """
        SELECT CAST(c_custkey AS VARCHAR) AS patient_id, c_mktsegment AS cohort,
               CAST(c_nationkey AS VARCHAR) AS site, a.specimen_id, o_orderstatus AS tissue_site,
               o_orderpriority AS timepoint, a.assay_id, a.assay_type, a.batch_id
        FROM assay_rows a JOIN orders ON CAST(o_orderkey AS VARCHAR) = a.specimen_id
        JOIN customer ON c_custkey = o_custkey""",
}


def with_model(sql: str) -> str:
    """``sql`` with the named subqueries it needs in front."""
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in TABLES:
            if name == inside or name in needed:
                continue
            if re.search(rf"\b{name}\b", text):
                visit(TABLES[name], name)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in needed)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH RECURSIVE {parts},\n{body[5:]}"
    return f"WITH RECURSIVE {parts}\n{body}"

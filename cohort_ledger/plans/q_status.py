"""Completion, cohort and dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.operators import status
from cohort_ledger.plans.dataset import Model
from cohort_ledger.plans.registry import query

PAIR_SQL = """
    WITH latest AS (
      SELECT patient_id, tissue_site, arg_max({label}, specimen_id) AS label
      FROM ({specimens}) GROUP BY patient_id, tissue_site),
    wide AS (
      SELECT patient_id,
             coalesce(max(CASE WHEN tissue_site = 'F' THEN label END), '(none)') AS f,
             coalesce(max(CASE WHEN tissue_site = 'O' THEN label END), '(none)') AS o,
             coalesce(max(CASE WHEN tissue_site = 'P' THEN label END), '(none)') AS p,
             CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) FILTER (WHERE label NOT IN ('FAIL', 'CENSORED', 'CONSENT_REVOKED', '(none)')) AS BIGINT) AS passing
      FROM latest GROUP BY patient_id),
    paired AS (
      SELECT *, CASE WHEN n = 1 THEN 'singleton' WHEN n < 3 THEN 'incomplete'
                     WHEN passing < 3 THEN 'broken' ELSE 'complete' END AS status FROM wide)
"""
SHOUT = "CASE WHEN eff IN ('fail', 'censored', 'consent_revoked') THEN upper(eff) ELSE eff END"
PAIR_PLAIN = PAIR_SQL.format(
    label=SHOUT, specimens="SELECT patient_id, specimen_id, tissue_site, qc_status AS eff FROM specimens"
)
RANK = "CASE {} WHEN 'warn' THEN 1 WHEN 'censored' THEN 2 WHEN 'fail' THEN 3 WHEN 'consent_revoked' THEN 4 ELSE 0 END"
PAIR_TYPED = PAIR_SQL.format(
    label=SHOUT,
    specimens=f"""
      SELECT s.patient_id, s.specimen_id, s.tissue_site,
             CASE WHEN w.sev IS NULL THEN '(none)' WHEN p.patient_id IS NULL THEN 'consent_revoked'
                  WHEN w.sev > {RANK.format('s.qc_status')}
                  THEN ['pass', 'warn', 'censored', 'fail', 'consent_revoked'][w.sev + 1]
                  ELSE s.qc_status END AS eff
      FROM specimens s
      LEFT JOIN (SELECT specimen_id, max({RANK.format('qc_status')}) AS sev FROM assays
                 WHERE assay_type = 'A' GROUP BY specimen_id) w ON w.specimen_id = s.specimen_id
      LEFT JOIN active_p p ON p.patient_id = s.patient_id""",
)


def _pairs(m: Model, **options) -> DataFrame:
    table = status.pair_by(*m.levels, "tissue_site", partitions=["F", "O", "P"], **options)
    return table.select(
        "patient_id",
        F.col("F").alias("f"),
        F.col("O").alias("o"),
        F.col("P").alias("p"),
        F.size("present").cast("bigint").alias("n"),
        F.col("passing").cast("bigint").alias("passing"),
        "status",
    )


@query(
    "status_by_analysis",
    """SELECT 'specimen' AS level, 'merge' AS analysis, count(merge_done) AS done, count(*) AS total,
              100.0 * count(merge_done) / CAST(count(*) AS DOUBLE) AS pct FROM active_s
       UNION ALL SELECT 'assay', 'flagstat', count(flagstat_done), count(*),
              100.0 * count(flagstat_done) / CAST(count(*) AS DOUBLE) FROM active_a
       UNION ALL SELECT 'assay', 'modkit', count(modkit_done), count(*),
              100.0 * count(modkit_done) / CAST(count(*) AS DOUBLE) FROM active_a""",
)
def _(m: Model) -> DataFrame:
    return status.status_by_analysis(*m.levels)


@query(
    "status_counts",
    """SELECT 'patient' AS level, CAST((SELECT count(*) FROM active_p) AS BIGINT) AS active,
              CAST((SELECT count(*) FROM patients) AS BIGINT) AS total
       UNION ALL SELECT 'specimen', (SELECT count(*) FROM active_s), (SELECT count(*) FROM specimens)
       UNION ALL SELECT 'assay', (SELECT count(*) FROM active_a), (SELECT count(*) FROM assays)""",
)
def _(m: Model) -> DataFrame:
    return status.status_counts(*m.levels)


@query(
    "status_by_row",
    """SELECT assay_id, concat_ws(',', CASE WHEN flagstat_done IS NOT NULL THEN 'flagstat' END,
                                  CASE WHEN modkit_done IS NOT NULL THEN 'modkit' END) AS analyses_done,
              CAST((flagstat_done IS NOT NULL)::INT + (modkit_done IS NOT NULL)::INT AS BIGINT) AS n_done,
              CAST(2 AS BIGINT) AS n_total
       FROM assays""",
)
def _(m: Model) -> DataFrame:
    return status.status_by_row(m.assays, "assay").select(
        "assay_id",
        F.array_join("analyses_done", ",").alias("analyses_done"),
        F.col("n_done").cast("bigint").alias("n_done"),
        F.col("n_total").cast("bigint").alias("n_total"),
    )


@query(
    "status_by_specimen",
    """SELECT s.specimen_id, count(a.assay_id) AS n_assays, count(a.flagstat_done) AS flagstat_done,
              count(a.modkit_done) AS modkit_done
       FROM specimens s LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    return status.status_by_specimen(*m.levels)


@query(
    "status_by_patient",
    """SELECT p.patient_id, count(DISTINCT s.specimen_id) AS n_specimens, count(a.assay_id) AS n_assays,
              count(a.flagstat_done) AS flagstat_done, count(a.modkit_done) AS modkit_done
       FROM patients p LEFT JOIN specimens s ON s.patient_id = p.patient_id
       LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY p.patient_id""",
)
def _(m: Model) -> DataFrame:
    return status.status_by_patient(*m.levels)


@query(
    "status_usable",
    """SELECT 'usable' AS metric, CAST(count(*) AS BIGINT) AS value FROM active_a
       UNION ALL SELECT 'complete', count(modkit_done) FROM active_a
       UNION ALL SELECT 'pending', count(*) - count(modkit_done) FROM active_a
       UNION ALL SELECT 'total', count(*) FROM assays
       UNION ALL SELECT 'excluded', (SELECT count(*) FROM assays) - (SELECT count(*) FROM active_a)
       UNION ALL SELECT 'qc_failed_assay', count(*) FROM assays WHERE qc_status = 'fail'
       UNION ALL SELECT 'censored_assay', count(*) FROM assays WHERE qc_status = 'censored'
       UNION ALL SELECT 'consent_revoked_patient', count(*) FROM patients
                 WHERE consent_status NOT IN ('consented', 'consented_limited_use')
       UNION ALL SELECT 'consent_revoked_assay', count(*)
                 FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
                 WHERE p.consent_status NOT IN ('consented', 'consented_limited_use')""",
)
def _(m: Model) -> DataFrame:
    return status.status_usable(*m.levels, analysis="modkit")


def _manifest(m: Model) -> DataFrame:
    labels = m.raw("labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, "x").alias("quality_done"),
        F.when(F.col("toxic") == 0, "x").alias("toxic_done"),
    )
    return m.raw("documents").select("doc_id", "source").join(labels, "doc_id", "left")


@query(
    "status_flat",
    """SELECT 'quality' AS analysis, count(*) FILTER (WHERE quality = 1) AS completed, count(*) AS total,
              100.0 * count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE) AS pct FROM doc_rows
       UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic = 0), count(*),
              100.0 * count(*) FILTER (WHERE toxic = 0) / CAST(count(*) AS DOUBLE) FROM doc_rows""",
)
def _(m: Model) -> DataFrame:
    return status.status_flat(_manifest(m))


@query(
    "status_flat_missing",
    """SELECT 'quality' AS analysis, doc_id FROM doc_rows WHERE quality IS DISTINCT FROM 1
       UNION ALL SELECT 'toxic', doc_id FROM doc_rows WHERE toxic IS DISTINCT FROM 0""",
)
def _(m: Model) -> DataFrame:
    return status.status_flat_missing(_manifest(m), "doc_id")


@query(
    "project_summary",
    """SELECT source AS project, n_samples, n_analyses, completed_cells,
              n_samples * n_analyses AS total_cells,
              CASE WHEN n_samples * n_analyses > 0
                   THEN 100.0 * completed_cells / CAST(n_samples * n_analyses AS DOUBLE) ELSE 0.0 END AS pct
       FROM (SELECT source, count(*) AS n_samples,
                    CAST((count(*) FILTER (WHERE quality = 1) > 0)::INT + (count(*) FILTER (WHERE toxic = 0) > 0)::INT AS BIGINT) AS n_analyses,
                    CAST(count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS completed_cells
             FROM doc_rows GROUP BY source)""",
)
def _(m: Model) -> DataFrame:
    return status.project_summary(_manifest(m).withColumnRenamed("source", "project"))


@query(
    "project_level_summary",
    """SELECT p.cohort AS project, count(DISTINCT p.patient_id) AS n_patients,
              count(DISTINCT s.specimen_id) AS n_specimens, count(a.assay_id) AS n_assays
       FROM patients p LEFT JOIN specimens s ON s.patient_id = p.patient_id
       LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY p.cohort""",
)
def _(m: Model) -> DataFrame:
    p = m.patients.select("patient_id", F.col("cohort").alias("project"))
    s = m.specimens.select("specimen_id", "patient_id").join(p, "patient_id")
    a = m.assays.select("assay_id", "specimen_id").join(s.select("specimen_id", "project"), "specimen_id")
    return status.project_level_summary(p, s, a)


@query(
    "cohort_summary",
    """SELECT 'patients_by_consent' AS section, coalesce(consent_status, 'consented') AS item, count(*) AS value
       FROM patients GROUP BY 2
       UNION ALL SELECT 'specimens_by_qc', coalesce(qc_status, 'pass'), count(*) FROM specimens GROUP BY 2
       UNION ALL SELECT 'assays_by_qc', coalesce(qc_status, 'pass'), count(*) FROM assays GROUP BY 2
       UNION ALL SELECT 'patients', 'total', count(*) FROM patients
       UNION ALL SELECT 'specimens', 'total', count(*) FROM specimens
       UNION ALL SELECT 'assays', 'total', count(*) FROM assays
       UNION ALL SELECT 'assays', 'usable', count(*) FROM active_a
       UNION ALL SELECT 'assays', 'excluded', (SELECT count(*) FROM assays) - (SELECT count(*) FROM active_a)""",
)
def _(m: Model) -> DataFrame:
    return status.cohort_summary(*m.levels)


@query(
    "completion",
    """SELECT 'flagstat' AS analysis, count(flagstat_done) AS done, count(*) - count(flagstat_done) AS pending,
              count(*) AS total_usable FROM active_a
       UNION ALL SELECT 'modkit', count(modkit_done), count(*) - count(modkit_done), count(*) FROM active_a""",
)
def _(m: Model) -> DataFrame:
    return status.completion(*m.levels)


@query("pair_by", PAIR_PLAIN + "SELECT patient_id, f, o, p, n, passing, status FROM paired")
def _(m: Model) -> DataFrame:
    return _pairs(m)


@query("pair_by_assay_type", PAIR_TYPED + "SELECT patient_id, f, o, p, n, passing, status FROM paired")
def _(m: Model) -> DataFrame:
    return _pairs(m, assay_type="A")


LONG_SQL = """
    WITH label AS (
      SELECT patient_id, CAST({part} AS VARCHAR) AS part, specimen_id,
             CASE WHEN qc_status IN ('fail', 'censored', 'consent_revoked') THEN upper(qc_status) ELSE coalesce(qc_status, 'pass') END AS label
      FROM specimens WHERE {part} IS NOT NULL AND CAST({part} AS VARCHAR) <> ''),
    cell AS (SELECT patient_id, part, arg_max(label, specimen_id) AS label FROM label GROUP BY patient_id, part),
    total AS (SELECT count(DISTINCT part) AS n_parts FROM label),
    patient AS (
      SELECT patient_id, count(*) AS n, string_agg(part, ',' ORDER BY part) AS present,
             string_agg(part || '=' || label, ',' ORDER BY part) AS labels,
             count(*) FILTER (WHERE label NOT IN ('FAIL', 'CENSORED', 'CONSENT_REVOKED', '(none)')) AS passing
      FROM cell GROUP BY patient_id)
    SELECT patient_id, labels, present, n_parts - n AS n_missing, passing,
           CASE WHEN n = 1 AND n_parts > 1 THEN 'singleton' WHEN n < n_parts THEN 'incomplete'
                WHEN passing < n_parts THEN 'broken' ELSE 'complete' END AS status
    FROM patient, total"""


def _long(m: Model, part: str) -> DataFrame:
    table = status.pair_by(*m.levels, part)
    labels = F.transform("present", lambda p: F.concat_ws("=", p, F.element_at("labels", p)))
    return table.select("patient_id", F.array_join(labels, ",").alias("labels"), F.array_join("present", ",").alias("present"), "n_missing", "passing", "status")


@query("pair_by_timepoint", LONG_SQL.format(part="timepoint"))
def _(m: Model) -> DataFrame:
    return _long(m, "timepoint")


@query("pair_by_many_partitions", LONG_SQL.format(part="specimen_id"))
def _(m: Model) -> DataFrame:
    return _long(m, "specimen_id")


@query("pair_by_require", PAIR_PLAIN + "SELECT count(*) FILTER (WHERE passing >= 2) AS require_satisfied FROM paired")
def _(m: Model) -> DataFrame:
    return status.pair_by_require(status.pair_by(*m.levels, "tissue_site"), 2)


@query("pair_by_filter", PAIR_PLAIN + "SELECT patient_id, status FROM paired WHERE status = 'broken'")
def _(m: Model) -> DataFrame:
    table = status.pair_by_filter(status.pair_by(*m.levels, "tissue_site"), "broken")
    return table.select("patient_id", "status")


@query(
    "pair_by_summary",
    PAIR_PLAIN
    + """SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE status = 'broken') AS broken,
                count(*) FILTER (WHERE status = 'incomplete') AS incomplete, count(*) FILTER (WHERE status = 'singleton') AS singleton
         FROM paired""",
)
def _(m: Model) -> DataFrame:
    return status.pair_by_summary(status.pair_by(*m.levels, "tissue_site"))


@query(
    "completion_matrix",
    """WITH own AS (
         SELECT specimen_id AS row_id, 'merge' AS analysis,
                CASE WHEN qc_status = 'fail' THEN 'failed' WHEN merge_done IS NOT NULL THEN 'done'
                     ELSE 'pending' END AS state FROM specimens),
       child AS (
         SELECT a.specimen_id, d.analysis,
                CASE WHEN a.qc_status = 'fail' THEN 'failed' WHEN d.done IS NOT NULL THEN 'done'
                     ELSE 'pending' END AS state
         FROM done_pivot d JOIN assays a ON a.assay_id = d.assay_id),
       grid AS (SELECT specimen_id, x.analysis FROM specimens, (SELECT DISTINCT analysis FROM done_pivot) x),
       counted AS (
         SELECT g.specimen_id AS row_id, g.analysis, count(*) FILTER (WHERE c.state = 'failed') AS n_failed,
                count(*) FILTER (WHERE c.state = 'done') AS n_done, count(*) FILTER (WHERE c.state = 'pending') AS n_pending
         FROM grid g LEFT JOIN child c ON c.specimen_id = g.specimen_id AND c.analysis = g.analysis
         GROUP BY g.specimen_id, g.analysis)
       SELECT row_id, analysis, state, CAST((state = 'failed')::INT AS BIGINT) AS n_failed,
              CAST((state = 'done')::INT AS BIGINT) AS n_done, CAST((state = 'pending')::INT AS BIGINT) AS n_pending
       FROM own
       UNION ALL
       SELECT row_id, analysis,
              CASE WHEN n_failed + n_done + n_pending = 0 THEN 'na' WHEN n_failed > 0 THEN 'failed'
                   WHEN n_pending > 0 THEN 'pending' ELSE 'done' END,
              CAST(n_failed AS BIGINT), CAST(n_done AS BIGINT), CAST(n_pending AS BIGINT) FROM counted""",
)
def _(m: Model) -> DataFrame:
    return status.completion_matrix(m.specimens, "specimen", m.assays)


@query(
    "next_up",
    """WITH ready AS (
         SELECT 'flagstat' AS analysis, assay_id FROM assays WHERE flagstat_done IS NULL
         UNION ALL SELECT 'modkit', assay_id FROM assays WHERE modkit_done IS NULL AND flagstat_done IS NOT NULL),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY analysis ORDER BY assay_id) AS r FROM ready)
       SELECT analysis, count(*) AS "count", string_agg(CASE WHEN r <= 6 THEN assay_id END, ',' ORDER BY assay_id) AS ids,
              CAST(greatest(count(*) - 6, 0) AS BIGINT) AS more
       FROM ranked GROUP BY analysis""",
)
def _(m: Model) -> DataFrame:
    return status.next_up(m.assays, "assay").withColumn("ids", F.array_join("ids", ","))


@query(
    "dashboard_specimen_pct",
    """SELECT specimen_id, n_assays, done_cells, 2 * n_assays AS total_cells,
              CASE WHEN n_assays > 0 THEN 100.0 * done_cells / CAST(2 * n_assays AS DOUBLE) ELSE 0.0 END AS pct
       FROM (SELECT s.specimen_id, count(a.assay_id) AS n_assays,
                    CAST(count(a.flagstat_done) + count(a.modkit_done) AS BIGINT) AS done_cells
             FROM specimens s LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY s.specimen_id)""",
)
def _(m: Model) -> DataFrame:
    return status.dashboard_specimen_pct(*m.levels)


@query(
    "dashboard_analysis_pct",
    """SELECT analysis, count(done) AS done, count(*) AS total,
              100.0 * count(done) / CAST(count(*) AS DOUBLE) AS pct FROM done_pivot GROUP BY analysis""",
)
def _(m: Model) -> DataFrame:
    return status.dashboard_analysis_pct(m.assays)


@query(
    "overall_pct",
    """SELECT count(done) AS completed_cells, count(*) AS total_cells,
              100.0 * count(done) / CAST(count(*) AS DOUBLE) AS pct FROM done_pivot""",
)
def _(m: Model) -> DataFrame:
    return status.overall_pct(m.assays)


@query(
    "extract_table",
    """SELECT p.patient_id, count(DISTINCT s.specimen_id) AS n_specimens,
              count(DISTINCT a.assay_type) AS n_assay_types
       FROM patients p LEFT JOIN specimens s ON s.patient_id = p.patient_id
       LEFT JOIN assays a ON a.specimen_id = s.specimen_id GROUP BY p.patient_id""",
)
def _(m: Model) -> DataFrame:
    return status.extract_table(*m.levels)


def job_log(m: Model) -> DataFrame:
    """Append and censor entries of compute jobs, one per event."""
    kind = F.col("event_type")
    analysis = (
        F.when(kind == "view", "premerge_flagstat")
        .when(kind == "click", "merge")
        .when(kind == "purchase", F.concat(F.lit("modkit_"), (F.col("event_id") % 3).cast("string")))
        .when(kind == "signup", "custom")
    )
    return m.raw("events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "error", "censor").otherwise("append").alias("action"),
        analysis.alias("analysis"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_id").cast("string")).alias("slurm_job_id"),
        F.array(analysis, F.concat(analysis, F.lit("_done"))).alias("columns_added"),
    )


@query(
    "phase_timing",
    """WITH jobs AS (
         SELECT CASE event_type WHEN 'view' THEN 'premerge_flagstat' WHEN 'click' THEN 'merge_ont'
                     WHEN 'purchase' THEN 'modkit_merged' WHEN 'signup' THEN 'other:custom' ELSE 'censor' END AS phase,
                CASE WHEN value >= 2 THEN CAST(floor(value * 10) AS BIGINT) END AS elapsed,
                1 + event_id % 8 AS cpus
         FROM events WHERE event_id % 11 <> 0),
       ranked AS (
         SELECT *, row_number() OVER (PARTITION BY phase ORDER BY elapsed) - 1 AS r,
                count(*) OVER (PARTITION BY phase) AS n FROM jobs WHERE elapsed IS NOT NULL)
       SELECT j.phase, count(*) AS n_jobs, min(elapsed) AS min_s,
              (SELECT r.elapsed FROM ranked r WHERE r.phase = j.phase AND r.r = r.n // 2) AS median_s,
              max(elapsed) AS max_s, sum(CASE WHEN elapsed > 0 THEN elapsed * cpus ELSE 0 END) / 3600.0 AS cpu_hours
       FROM jobs j GROUP BY j.phase""",
)
def _(m: Model) -> DataFrame:
    accounting = m.raw("events").filter("value >= 2").select(
        F.col("event_id").cast("string").alias("slurm_job_id"),
        F.floor(F.col("value") * 10).cast("bigint").alias("elapsed_s"),
        (1 + F.col("event_id") % 8).alias("req_cpus"),
    )
    return status.phase_timing(job_log(m), accounting)


@query(
    "last_status_change",
    """SELECT CAST(user_id AS VARCHAR) AS project_id, arg_max(event_type, event_id) AS to_status
       FROM events WHERE event_type <> 'view' GROUP BY user_id""",
)
def _(m: Model) -> DataFrame:
    kind = F.col("event_type")
    log = m.raw("events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "view", "append").otherwise("project_status_change").alias("action"),
        F.col("user_id").cast("string").alias("project_id"),
        F.lit("active").alias("from_status"),
        kind.alias("to_status"),
        F.col("ts").cast("string").alias("timestamp"),
        F.lit("").alias("reason"),
    )
    return status.last_status_change(log).select("project_id", "to_status")


@query(
    "analysis_columns",
    """WITH a AS (
         SELECT DISTINCT CASE event_type WHEN 'view' THEN 'premerge_flagstat' WHEN 'click' THEN 'merge'
                     WHEN 'purchase' THEN 'modkit_' || CAST(event_id % 3 AS VARCHAR) ELSE 'custom' END AS analysis
         FROM events WHERE event_type <> 'error')
       SELECT analysis, analysis AS "column" FROM a UNION ALL SELECT analysis, analysis || '_done' FROM a""",
)
def _(m: Model) -> DataFrame:
    return status.analysis_columns(job_log(m))

"""QC events, consent and replay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.operators import qc, replay
from cohort_ledger.plans.dataset import AS_OF, Model
from cohort_ledger.plans.registry import query

STATUS_OF = """CASE max(CASE WHEN kind IN ('qc_fail', 'library_prep_failed', 'basecall_accuracy_low',
                                 'sequencing_run_failed', 'contamination', 'protocol_deviation') THEN 3
                   WHEN kind IN ('qc_warn', 'batch_effect_flagged') THEN 1
                   WHEN kind = 'consent_revoked' AND level = 'patient' THEN 4 ELSE 2 END)
               WHEN 1 THEN 'warn' WHEN 2 THEN 'censored' WHEN 3 THEN 'fail' ELSE 'consent_revoked' END"""


@query("derive_status", "SELECT level, entity_id, qc_status FROM statuses")
def _(m: Model) -> DataFrame:
    return qc.derive_status(m.qc_events)


@query("recompute_status", "SELECT specimen_id, patient_id, qc_status FROM specimens")
def _(m: Model) -> DataFrame:
    rows = m.specimens.withColumn("qc_status", F.lit("stale value"))
    return qc.recompute_status(rows, m.qc_events, "specimen").select(
        "specimen_id", "patient_id", "qc_status"
    )


REQUESTS_SQL = """
    requests AS (
      SELECT event_id,
             CASE event_id % 4 WHEN 0 THEN 'patient' WHEN 1 THEN 'specimen' WHEN 2 THEN 'assay' ELSE 'plate' END AS level,
             CAST(user_id AS VARCHAR) AS entity_id,
             CASE event_type WHEN 'error' THEN 'qc_fail' WHEN 'click' THEN 'contamination'
                  WHEN 'view' THEN 'consent_revoked' WHEN 'purchase' THEN 'library_prep_failed'
                  ELSE 'smudged' END AS kind
      FROM events)
"""


def _requests(m: Model) -> DataFrame:
    turn, kind = F.col("event_id") % 4, F.col("event_type")
    return m.raw("events").select(
        "event_id",
        F.when(turn == 0, "patient").when(turn == 1, "specimen").when(turn == 2, "assay").otherwise("plate").alias("level"),
        F.col("user_id").cast("string").alias("entity_id"),
        F.when(kind == "error", "qc_fail").when(kind == "click", "contamination")
        .when(kind == "view", "consent_revoked").when(kind == "purchase", "library_prep_failed")
        .otherwise("smudged").alias("kind"),
        F.concat(F.lit("request "), kind).alias("reason"),
    )


@query(
    "validate_kinds",
    "WITH " + REQUESTS_SQL
    + """SELECT event_id,
                CASE WHEN kind = 'smudged' THEN 'unknown_kind'
                     WHEN kind = 'consent_revoked' AND level <> 'patient' THEN 'kind_not_allowed_at_level'
                     WHEN kind = 'library_prep_failed' AND level <> 'assay' THEN 'kind_not_allowed_at_level'
                     WHEN kind = 'contamination' AND level NOT IN ('specimen', 'assay') THEN 'kind_not_allowed_at_level'
                     WHEN level = 'plate' THEN 'unknown_level' ELSE 'ok' END AS outcome
         FROM requests""",
)
def _(m: Model) -> DataFrame:
    return qc.validate_kinds(_requests(m)).select(
        "event_id", F.coalesce("reject", F.lit("ok")).alias("outcome")
    )


@query(
    "censor_rejects",
    "WITH " + REQUESTS_SQL
    + """SELECT event_id,
                CASE WHEN kind = 'smudged' THEN 'unknown_kind'
                     WHEN kind = 'consent_revoked' AND level <> 'patient' THEN 'kind_not_allowed_at_level'
                     WHEN kind = 'library_prep_failed' AND level <> 'assay' THEN 'kind_not_allowed_at_level'
                     WHEN kind = 'contamination' AND level NOT IN ('specimen', 'assay') THEN 'kind_not_allowed_at_level'
                     WHEN level = 'plate' THEN 'unknown_level'
                     WHEN level = 'assay' THEN 'unknown_entity'
                     WHEN level = 'patient' AND entity_id NOT IN (SELECT patient_id FROM patients) THEN 'unknown_entity'
                     WHEN level = 'specimen' AND entity_id NOT IN (SELECT specimen_id FROM specimens) THEN 'unknown_entity'
                     WHEN EXISTS (SELECT 1 FROM active_events a WHERE a.level = r.level AND a.entity_id = r.entity_id
                                  AND a.kind = r.kind) THEN 'already_active'
                     WHEN count(*) OVER (PARTITION BY level, entity_id, kind) > 1 THEN 'repeated_in_batch'
                     ELSE 'ok' END AS outcome
         FROM requests r""",
)
def _(m: Model) -> DataFrame:
    checked = qc.censor_rejects(_requests(m), m.qc_events, *m.levels)
    return checked.select("event_id", F.coalesce("reject", F.lit("ok")).alias("outcome"))


@query(
    "bulk_censor",
    """WITH added AS (
         SELECT 'patient' AS level, patient_id AS entity_id, 'consent_revoked' AS kind FROM patients p
         WHERE consent_status = 'withdrawn' AND NOT EXISTS (
           SELECT 1 FROM active_events a WHERE a.level = 'patient' AND a.entity_id = p.patient_id
                  AND a.kind = 'consent_revoked'))
       SELECT p.patient_id,
              CASE WHEN n.entity_id IS NOT NULL THEN 'revoked' ELSE p.consent_status END AS consent_status,
              CASE WHEN n.entity_id IS NOT NULL THEN '2024-06-01'
                   ELSE coalesce(CAST(p.withdrawal_date AS VARCHAR), '') END AS withdrawal_date,
              CASE WHEN n.entity_id IS NOT NULL THEN 'consent_revoked' ELSE p.qc_status END AS qc_status
       FROM patients p LEFT JOIN added n ON n.entity_id = p.patient_id""",
)
def _(m: Model) -> DataFrame:
    taken = qc.active_events(m.qc_events).filter(
        (F.col("level") == "patient") & (F.col("kind") == "consent_revoked")
    )
    rows = (
        m.patients.filter(F.col("consent_status") == "withdrawn")
        .join(taken.select(F.col("entity_id").alias("patient_id")), "patient_id", "left_anti")
        .select(
            F.lit("patient").alias("level"),
            F.col("patient_id").alias("entity_id"),
            F.lit("consent_revoked").alias("kind"),
            F.lit("withdrew").alias("reason"),
        )
    )
    out = qc.bulk_censor(rows, m.qc_events, *m.levels, AS_OF, "txn-bulk")
    return out["patients"].select(
        "patient_id",
        "consent_status",
        F.coalesce(F.col("withdrawal_date").cast("string"), F.lit("")).alias("withdrawal_date"),
        "qc_status",
    )


@query(
    "dedupe_active",
    """SELECT DISTINCT 'specimen' AS level, specimen_id AS entity_id, 'qc_warn' AS kind FROM assay_rows r
       WHERE n_reads < 5 AND NOT EXISTS (SELECT 1 FROM active_events a WHERE a.level = 'specimen'
             AND a.entity_id = r.specimen_id AND a.kind = 'qc_warn')""",
)
def _(m: Model) -> DataFrame:
    candidates = m.assay_rows.filter("n_reads < 5").select(
        F.lit("specimen").alias("level"),
        F.col("specimen_id").alias("entity_id"),
        F.lit("qc_warn").alias("kind"),
        F.concat(F.lit("few reads in "), F.col("assay_id")).alias("reason"),
    )
    return qc.dedupe_active(candidates, m.qc_events).select("level", "entity_id", "kind")


@query(
    "resolve_events",
    """WITH one AS (
         SELECT level, entity_id, min(id) AS id FROM active_events GROUP BY level, entity_id HAVING count(*) = 1),
       named AS (
         SELECT id FROM active_events WHERE kind = 'other'
         UNION SELECT id FROM one WHERE level = 'patient')
       SELECT e.id, e.level, e.entity_id, n.id IS NOT NULL AS closed_now,
              e.resolved_at IS NULL AND n.id IS NULL AS still_active
       FROM qc_events e LEFT JOIN named n ON n.id = e.id""",
)
def _(m: Model) -> DataFrame:
    current = qc.active_events(m.qc_events)
    by_id = current.filter(F.col("kind") == "other").select(
        "id", "level", "entity_id", F.lit("reviewed").alias("reason")
    )
    by_entity = (
        current.filter(F.col("level") == "patient")
        .select(F.lit(None).cast("string").alias("id"), "level", "entity_id", F.lit("reviewed").alias("reason"))
        .distinct()
    )
    out = qc.resolve_events(m.qc_events, by_id.unionByName(by_entity), AS_OF, "board")["events"]
    return out.select(
        "id", "level", "entity_id",
        F.coalesce(F.col("resolved_by") == "board", F.lit(False)).alias("closed_now"),
        F.col("resolved_at").isNull().alias("still_active"),
    )


@query(
    "append_resolved",
    """SELECT level, kind, count(*) AS n, count(resolved_at) AS n_resolved FROM (
         SELECT level, kind, resolved_at FROM qc_events
         UNION ALL SELECT level, kind, resolved_at FROM qc_events WHERE resolved_at IS NOT NULL AND kind = 'qc_warn')
       GROUP BY level, kind""",
)
def _(m: Model) -> DataFrame:
    again = m.qc_events.filter(F.col("kind") == "qc_warn").withColumn("id", F.concat(F.lit("again-"), "id"))
    out = qc.append_resolved(m.qc_events, again)
    return out.groupBy("level", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("resolved_at").alias("n_resolved")
    )


@query(
    "apply_consent",
    """SELECT patient_id,
              CASE WHEN CAST(patient_id AS BIGINT) % 7 = 0 THEN 'withdrawn'
                   WHEN CAST(patient_id AS BIGINT) % 7 = 1 THEN 'consented' ELSE consent_status END AS consent_status,
              CASE WHEN CAST(patient_id AS BIGINT) % 7 = 0 THEN '2024-06-01'
                   WHEN CAST(patient_id AS BIGINT) % 7 = 1 THEN ''
                   ELSE coalesce(CAST(withdrawal_date AS VARCHAR), '') END AS withdrawal_date
       FROM patients""",
)
def _(m: Model) -> DataFrame:
    turn = F.col("patient_id").cast("bigint") % 7
    updates = m.patients.select(
        "patient_id",
        F.when(turn == 0, "withdrawn").when(turn == 1, "consented").when(turn == 2, "withdrawn")
        .otherwise("unheard_of").alias("consent_status"),
        F.when(turn == 0, F.lit("2024-06-01")).cast("date").alias("withdrawal_date"),
    )
    out, _rejects = qc.apply_consent(m.patients, updates)
    return out.select(
        "patient_id", "consent_status",
        F.coalesce(F.col("withdrawal_date").cast("string"), F.lit("")).alias("withdrawal_date"),
    )


@query(
    "consent_violations",
    """SELECT 'missing_consent_revoked_event' AS violation, patient_id FROM patients p
       WHERE consent_status = 'revoked' AND NOT EXISTS (
         SELECT 1 FROM active_events a WHERE a.level = 'patient' AND a.kind = 'consent_revoked'
                AND a.entity_id = p.patient_id)
       UNION ALL SELECT 'missing_withdrawal_date', patient_id FROM patients
       WHERE consent_status IN ('revoked', 'withdrawn', 'consent_expired') AND withdrawal_date IS NULL
       UNION ALL SELECT 'spurious_withdrawal_date', patient_id FROM patients
       WHERE consent_status NOT IN ('revoked', 'withdrawn', 'consent_expired') AND withdrawal_date IS NOT NULL""",
)
def _(m: Model) -> DataFrame:
    return qc.consent_violations(m.patients, m.qc_events)


@query(
    "ethics_gate",
    """SELECT event_id, event_id % 6 IN (0, 1, 2, 3) AS allowed FROM events""",
)
def _(m: Model) -> DataFrame:
    turn = F.col("event_id") % 6
    reason = (
        F.when(turn == 0, F.concat(F.lit("irb approval "), "event_type"))
        .when(turn == 1, F.concat(F.lit("patient Re-consented after "), "event_type"))
        .when(turn == 2, F.concat(F.lit("form signed "), F.date_format("ts", "yyyy-MM-dd")))
        .when(turn == 3, F.concat("event_type", F.lit(" seen by Ethics  Committee")))
        .when(turn == 4, F.concat(F.lit("mirb "), "event_type"))
    )
    rows = m.raw("events").select("event_id", reason.alias("reason"))
    return qc.ethics_gate(rows).select("event_id", "allowed")


@query("qc_history", "SELECT id, level, entity_id, kind FROM active_events")
def _(m: Model) -> DataFrame:
    return qc.qc_history(m.qc_events).select("id", "level", "entity_id", "kind")


@query(
    "qc_history_entity",
    "SELECT id, kind, resolved_at IS NULL AS active FROM qc_events WHERE level = 'patient' AND entity_id = '8'",
)
def _(m: Model) -> DataFrame:
    return qc.qc_history(m.qc_events, "patient", "8").select(
        "id", "kind", F.col("resolved_at").isNull().alias("active")
    )


@query(
    "qc_event_summary",
    """SELECT count(*) FILTER (WHERE kind = 'qc_fail') AS fail, count(*) FILTER (WHERE kind = 'qc_warn') AS warn,
              count(*) FILTER (WHERE kind NOT IN ('qc_fail', 'qc_warn')) AS censored, count(*) AS total
       FROM active_events""",
)
def _(m: Model) -> DataFrame:
    return qc.qc_event_summary(m.qc_events)


HITS_SQL = """
    chosen AS (SELECT CAST(s_suppkey AS VARCHAR) AS batch_id FROM supplier WHERE s_acctbal < 1000),
    own AS (SELECT assay_id FROM assays WHERE batch_id IN (SELECT batch_id FROM chosen)),
    downstream AS (SELECT * FROM sources WHERE source_assay_id IN (SELECT assay_id FROM own)),
    targets AS (
      SELECT 'assay' AS level, assay_id AS entity_id, 'qc_fail' AS kind, 0 AS origin FROM own
      UNION ALL SELECT 'assay', merged_assay_id, 'qc_fail', 1 FROM downstream WHERE merged_assay_id IS NOT NULL
      UNION ALL SELECT 'specimen', consumer_specimen_id, 'qc_warn', 2 FROM downstream WHERE consumer_specimen_id IS NOT NULL)
"""


def _chosen(m: Model) -> DataFrame:
    poor = m.raw("supplier").filter("s_acctbal < 1000")
    return poor.select(F.col("s_suppkey").cast("string").alias("batch_id"))


@query(
    "censor_batch",
    "WITH " + HITS_SQL + """,
       first AS (SELECT level, entity_id, kind, min(origin) AS origin FROM targets GROUP BY level, entity_id, kind)
       SELECT count(*) FILTER (WHERE origin = 0) AS censored_assays,
              count(*) FILTER (WHERE origin = 2) AS warned_specimens,
              count(*) FILTER (WHERE origin = 1) AS censored_derived_assays
       FROM first f WHERE NOT EXISTS (SELECT 1 FROM active_events a WHERE a.level = f.level
            AND a.entity_id = f.entity_id AND a.kind = f.kind)""",
)
def _(m: Model) -> DataFrame:
    return qc.censor_batch(
        _chosen(m), m.assays, m.specimens, m.assay_sources, m.qc_events, AS_OF, "txn-batch"
    )["counts"]


@query(
    "censor_batch_status",
    "WITH " + HITS_SQL + f""",
       after AS (SELECT level, entity_id, kind FROM active_events UNION ALL SELECT level, entity_id, kind FROM targets)
       SELECT a.assay_id, coalesce(s.qc_status, 'pass') AS qc_status FROM assays a
       LEFT JOIN (SELECT entity_id, {STATUS_OF} AS qc_status FROM after WHERE level = 'assay' GROUP BY entity_id) s
         ON s.entity_id = a.assay_id""",
)
def _(m: Model) -> DataFrame:
    return qc.censor_batch(
        _chosen(m), m.assays, m.specimens, m.assay_sources, m.qc_events, AS_OF, "txn-batch"
    )["assays"].select("assay_id", "qc_status")


@query(
    "uncensor_batch",
    "WITH " + HITS_SQL + """
       SELECT id, level, entity_id FROM active_events e
       WHERE EXISTS (SELECT 1 FROM targets t WHERE t.level = e.level AND t.entity_id = e.entity_id)""",
)
def _(m: Model) -> DataFrame:
    return qc.uncensor_batch(
        _chosen(m), m.assays, m.specimens, m.assay_sources, m.qc_events, AS_OF
    )["resolved"]


@query(
    "uncensor",
    f"""WITH chosen AS (
         SELECT * FROM active_events WHERE level = 'patient'
           AND (kind <> 'consent_revoked' OR CAST(id AS BIGINT) % 4 <> 0)),
       rest AS (SELECT * FROM active_events WHERE id NOT IN (SELECT id FROM chosen))
       SELECT p.patient_id,
              CASE WHEN r.entity_id IS NOT NULL THEN 'consented' ELSE p.consent_status END AS consent_status,
              coalesce(s.qc_status, 'pass') AS qc_status
       FROM patients p
       LEFT JOIN (SELECT DISTINCT entity_id FROM chosen WHERE kind = 'consent_revoked') r ON r.entity_id = p.patient_id
       LEFT JOIN (SELECT entity_id, {STATUS_OF} AS qc_status FROM rest WHERE level = 'patient' GROUP BY entity_id) s
         ON s.entity_id = p.patient_id""",
)
def _(m: Model) -> DataFrame:
    number = F.col("id").cast("bigint")
    rows = qc.active_events(m.qc_events).filter(F.col("level") == "patient").select(
        "id", "level", "entity_id",
        F.when(number % 4 == 0, "looked fine").otherwise("IRB 2024-17").alias("reason"),
    )
    out = qc.uncensor(m.qc_events, rows, *m.levels, AS_OF)
    return out["patients"].select("patient_id", "consent_status", "qc_status")


REPLAY_SQL = """
    steps AS (
      SELECT level, entity_id, kind, id, 2 * seq AS step, 'open' AS op FROM qc_events
      UNION ALL SELECT level, entity_id, kind, id, 2 * (seq + 333) + 1, 'close' FROM qc_events WHERE resolved_at IS NOT NULL),
    marked AS (
      SELECT *, coalesce(lag(op) OVER (PARTITION BY level, entity_id, kind ORDER BY step), 'close') AS before FROM steps),
    turns AS (SELECT * FROM marked WHERE op <> before),
    paired AS (SELECT *, lead(op) OVER (PARTITION BY level, entity_id, kind ORDER BY step) AS after FROM turns),
    known AS (SELECT 'patient' AS level, patient_id AS entity_id FROM patients
              UNION ALL SELECT 'specimen', specimen_id FROM specimens
              UNION ALL SELECT 'assay', assay_id FROM assays)
"""


@query(
    "replay_qc_log",
    "WITH " + REPLAY_SQL + """
       SELECT id, p.level, p.entity_id, kind, after IS NULL AS active FROM paired p
       JOIN known k ON k.level = p.level AND k.entity_id = p.entity_id WHERE op = 'open'""",
)
def _(m: Model) -> DataFrame:
    events = replay.replay_qc_log(m.qc_log, *m.levels)["events"]
    return events.select(
        "id", "level", "entity_id", "kind", F.col("resolved_at").isNull().alias("active")
    )


@query(
    "replay_warnings",
    "WITH " + REPLAY_SQL + """
       SELECT step AS seq, 'entity_missing' AS warning FROM steps s WHERE op = 'open'
         AND NOT EXISTS (SELECT 1 FROM known k WHERE k.level = s.level AND k.entity_id = s.entity_id)
       UNION ALL
       SELECT s.step, 'event_not_found' FROM (
         SELECT *, coalesce(lag(op) OVER (PARTITION BY level, entity_id, kind ORDER BY step), 'close') AS before
         FROM (SELECT s.* FROM steps s LEFT JOIN known k ON k.level = s.level AND k.entity_id = s.entity_id
               WHERE s.op = 'close' OR k.entity_id IS NOT NULL)) s
       WHERE s.op = 'close' AND s.before = 'close'""",
)
def _(m: Model) -> DataFrame:
    return replay.replay_qc_log(m.qc_log, *m.level_rows.values())["warnings"].select("seq", "warning")


@query(
    "replay_entities",
    """SELECT CAST(doc_id AS VARCHAR) AS patient_id,
              CASE WHEN quality IS NOT NULL THEN 'q' || CAST(quality AS VARCHAR) ELSE lang END AS cohort,
              source AS site
       FROM doc_rows""",
)
def _(m: Model) -> DataFrame:
    docs = m.raw("documents").join(m.raw("labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string").alias("patient_id")
    first = docs.filter(F.col("quality").isNotNull()).select(
        F.lit("first.tsv").alias("results_file"), key,
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("cohort"),
        F.lit(None).cast("string").alias("site"),
    )
    second = docs.select(
        F.lit("second.tsv").alias("results_file"), key, F.col("lang").alias("cohort"), F.col("source").alias("site")
    )
    log = m.raw("region").select(
        F.col("r_regionkey").cast("bigint").alias("seq"),
        F.lit("add_metadata").alias("action"),
        F.lit("patient").alias("level"),
        F.lit(None).cast("string").alias("analysis"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        F.when(F.col("r_regionkey") == 0, "first.tsv").otherwise("second.tsv").alias("results_file"),
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("map<string,string>").alias("meta"),
    )
    out = replay.replay_entities(log, first.unionByName(second), "patient", ["cohort", "site"])
    return out["rows"]


@query(
    "resolve_rejects",
    """WITH per AS (SELECT level, entity_id, count(*) AS n FROM active_events GROUP BY level, entity_id),
            asked AS (SELECT DISTINCT level, entity_id FROM qc_events)
       SELECT 'by entity' AS way, a.level, a.entity_id, CASE WHEN p.n IS NULL THEN 'no_active_event' ELSE 'ambiguous' END AS reject
       FROM asked a LEFT JOIN per p ON p.level = a.level AND p.entity_id = a.entity_id WHERE coalesce(p.n, 0) <> 1
       UNION ALL SELECT 'by id', level, entity_id, 'not_active' FROM qc_events WHERE resolved_at IS NOT NULL""",
)
def _(m: Model) -> DataFrame:
    """Every entity with an event resolved by name, and every event by id: what is refused."""
    events = m.qc_events
    why = F.lit("reviewed").alias("reason")
    by_entity = events.select("level", "entity_id").distinct().select(F.lit(None).cast("string").alias("id"), "level", "entity_id", why)
    by_id = events.select("id", "level", "entity_id", why)
    refused = qc.resolve_events(events, by_entity.unionByName(by_id), AS_OF)["rejects"]
    return refused.select(F.when(F.col("id").isNull(), "by entity").otherwise("by id").alias("way"), "level", "entity_id", "reject")


@query(
    "consent_rejects",
    """SELECT patient_id, CASE CAST(patient_id AS BIGINT) % 5 WHEN 0 THEN 'withdrawal_date_required' WHEN 1 THEN 'withdrawal_date_not_allowed'
                          ELSE 'unknown_consent_status' END AS reject
       FROM patients WHERE CAST(patient_id AS BIGINT) % 5 < 4""",
)
def _(m: Model) -> DataFrame:
    turn = F.col("patient_id").cast("bigint") % 5
    status = F.when(turn == 0, "revoked").when(turn == 1, "consented").when(turn == 2, "unheard_of").when(turn == 4, "withdrawn")
    updates = m.patients.select("patient_id", status.alias("consent_status"), F.when(turn.isin(1, 4), F.lit("2024-06-01")).cast("date").alias("withdrawal_date"))
    return qc.apply_consent(m.patients, updates)[1].select("patient_id", "reject")


@query(
    "replay_entities_actions",
    """SELECT p.patient_id AS patient_id, coalesce(CASE WHEN CAST(p.patient_id AS BIGINT) % 4 = 1 THEN 'own' END, p.cohort) AS cohort,
              CASE WHEN CAST(p.patient_id AS BIGINT) % 4 <> 3 THEN p.site END AS site,
              CASE WHEN CAST(p.patient_id AS BIGINT) % 6 = 0 THEN '2024-03-01T00:00:00' END AS scan_done
       FROM patients p""",
)
def _(m: Model) -> DataFrame:
    """Rows registered one by one, by a whole sheet, by a migration and by metadata; results fill them and add none."""
    number = F.col("patient_id").cast("bigint")
    none = F.lit(None).cast("string")
    people = m.patients.select("patient_id", "cohort", "site")
    registered = people.filter(number % 4 == 1)
    strangers = people.filter(number % 6 == 0).select(F.concat(F.lit("absent-"), "patient_id").alias("patient_id"), none.alias("cohort"), none.alias("site"))
    files = {
        "sheet.tsv": people.filter(number % 4 == 0),
        "flat.tsv": people.filter(number % 4 == 2),
        "more.tsv": people.select("patient_id", "cohort", F.when(number % 4 == 1, F.col("site")).alias("site")),
        "scan.tsv": people.filter(number % 6 == 0).select("patient_id", none.alias("cohort"), none.alias("site")).unionByName(strangers),
    }
    sources = [rows.withColumn("results_file", F.lit(name)) for name, rows in files.items()]
    kinds = {"sheet.tsv": "register_cohort", "flat.tsv": "migrate", "more.tsv": "add_metadata", "scan.tsv": "append"}

    def line(seq, action, when="2024-01-01T00:00:00", analysis=none, file=none, key=none, meta=None):
        meta = F.lit(None).cast("map<string,string>") if meta is None else meta
        return [F.lit(seq).cast("bigint") if isinstance(seq, int) else seq, F.lit(action), F.lit("patient"), analysis, F.lit(when), file, key, none, meta]

    names = ["seq", "action", "level", "analysis", "timestamp", "results_file", "id", "parent", "meta"]
    one_by_one = registered.select(*line(number, "register", key=F.col("patient_id"), meta=F.create_map(F.lit("cohort"), F.lit("own")))).toDF(*names)
    later = [
        # Above every registration's place.
        m.raw("region").filter("r_regionkey = 0").select(
            *line(2**40 + i, kinds[name], "2024-03-01T00:00:00", F.lit("scan") if name == "scan.tsv" else none, F.lit(name))
        ).toDF(*names)
        for i, name in enumerate(files)
    ]
    log, rows = one_by_one, sources[0]
    for more in later:
        log = log.unionByName(more)
    for more in sources[1:]:
        rows = rows.unionByName(more)
    out = replay.replay_entities(log, rows, "patient", ["cohort", "site", "scan_done"])
    return out["rows"].select("patient_id", "cohort", "site", "scan_done")

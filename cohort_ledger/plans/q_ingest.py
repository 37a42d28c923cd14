"""Ingest queries: merges, upserts and sheet splitting."""

from __future__ import annotations

from functools import reduce

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.model import DEFAULT_SCHEMA, ColumnSpec
from cohort_ledger.operators import ingest, qc
from cohort_ledger.plans.dataset import AS_OF, Model
from cohort_ledger.plans.registry import query


def _documents(m: Model) -> DataFrame:
    """A flat manifest with a partly filled ``quality`` column."""
    return m.raw("documents").select(
        "doc_id",
        "source",
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("int")).alias("quality"),
    )


def _labels(m: Model) -> DataFrame:
    return m.raw("labels").select("doc_id", "quality", "toxic")


@query(
    "fill_only",
    """SELECT d.doc_id, d.source,
              CAST(coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.n_chars END, l.quality, -1) AS INTEGER) AS quality
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(m: Model) -> DataFrame:
    return ingest.fill_only(_documents(m), _labels(m), "doc_id", ["quality"]).fillna(-1, ["quality"])


BEYOND_DOUBLES = 2**53


@query(
    "fill_only_typed_keys",
    f"""SELECT d.doc_id + {BEYOND_DOUBLES} AS doc_id, coalesce(l.quality, -1) AS quality
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND d.doc_id % 4 < 3""",
)
def _(m: Model) -> DataFrame:
    """Long keys that doubles cannot tell apart, filled by text, decimal and (even) double keys."""
    key = (F.col("doc_id") + F.lit(BEYOND_DOUBLES)).alias("doc_id")
    filled = m.raw("documents").select(key, F.lit(None).cast("int").alias("quality"))
    for turn, kind in enumerate(("string", "decimal(20,2)", "double")):
        labels = m.raw("labels").filter(F.col("doc_id") % 4 == turn).select(key, "quality")
        filled = ingest.fill_only(filled, labels.withColumn("doc_id", F.col("doc_id").cast(kind)), "doc_id")
    return filled.fillna(-1, ["quality"])


@query(
    "fill_only_ordered",
    """SELECT s.specimen_id, coalesce(s.merge_done IS NULL, FALSE) AS was_empty,
              coalesce(CAST(CAST(coalesce(s.merge_done, r.first_done) AS DATE) AS VARCHAR), '') AS merge_done
       FROM specimens s LEFT JOIN (
         SELECT specimen_id, arg_min(flagstat_done, assay_id) FILTER (WHERE flagstat_done IS NOT NULL) AS ignored,
                first(flagstat_done ORDER BY assay_id) AS first_done
         FROM assay_rows GROUP BY specimen_id) r ON r.specimen_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    base = m.specimens.select("specimen_id", "merge_done", F.col("merge_done").isNull().alias("was_empty"))
    results = m.assay_rows.select("specimen_id", "assay_id", F.col("flagstat_done").alias("merge_done"))
    out = ingest.fill_only(base, results, "specimen_id", ["merge_done"], order_col="assay_id")
    return out.select(
        "specimen_id", "was_empty",
        F.coalesce(F.date_format("merge_done", "yyyy-MM-dd"), F.lit("")).alias("merge_done"),
    )


APPEND_SQL = """
    SELECT d.doc_id, d.source, CAST({quality} AS INTEGER) AS quality,
           coalesce(l.toxic, -1) AS toxic,
           CASE WHEN l.doc_id IS NOT NULL THEN '2024-06-01' ELSE '' END AS labels_done
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def _flat(m: Model, **options) -> DataFrame:
    out = ingest.append_flat(_documents(m), _labels(m), "doc_id", "labels", "2024-06-01", **options)
    return out.fillna(-1, ["quality", "toxic"]).fillna("", ["labels_done", "source"])


@query(
    "append_flat",
    APPEND_SQL.format(quality="coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.n_chars END, l.quality, -1)"),
)
def _(m: Model) -> DataFrame:
    return _flat(m)


@query("append_flat_overwrite", APPEND_SQL.format(quality="coalesce(l.quality, -1)"))
def _(m: Model) -> DataFrame:
    return _flat(m, overwrite=True)


@query(
    "append_flat_allow_new",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.source, '') AS source,
              CAST(coalesce(CASE WHEN d.filled THEN d.n_chars END, l.quality, -1) AS INTEGER) AS quality,
              coalesce(l.toxic, -1) AS toxic,
              CASE WHEN l.doc_id IS NOT NULL THEN '2024-06-01' ELSE '' END AS labels_done
       FROM (SELECT * REPLACE (CASE WHEN lang <> 'en' THEN doc_id ELSE -1 - doc_id END AS doc_id),
                    doc_id % 3 = 0 AS filled FROM documents) d FULL JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(m: Model) -> DataFrame:
    own = F.when(F.col("lang") != "en", F.col("doc_id")).otherwise(-1 - F.col("doc_id"))
    keys = m.raw("documents").select("doc_id", own.alias("_own"))
    manifest = _documents(m).join(keys, "doc_id").withColumn("doc_id", F.col("_own")).drop("_own")
    out = ingest.append_flat(manifest, _labels(m), "doc_id", "labels", "2024-06-01", allow_new=True)
    return out.fillna(-1, ["quality", "toxic"]).fillna("", ["labels_done", "source"])


def _price_results(m: Model) -> DataFrame:
    """Several result rows per specimen, with gaps and an order."""
    return m.raw("lineitem").select(
        F.col("l_orderkey").cast("string").alias("specimen_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("part"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"),
    )


@query(
    "append_results",
    """SELECT s.specimen_id, coalesce(r.part, -1) AS part,
              CASE WHEN r.specimen_id IS NOT NULL THEN '2024-06-01' ELSE '' END AS parts_done
       FROM specimens s LEFT JOIN (
         SELECT CAST(l_orderkey AS VARCHAR) AS specimen_id,
                first(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_linenumber % 2 = 0) AS part
         FROM lineitem GROUP BY l_orderkey) r ON r.specimen_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    out = ingest.append_results(
        m.specimens.select("specimen_id"), _price_results(m), "specimen", "parts", "2024-06-01", order_col="at"
    )
    return out.fillna(-1, ["part"]).fillna("", ["parts_done"])


@query(
    "append_results_overwrite",
    """SELECT s.specimen_id, coalesce(r.part, CASE WHEN r.specimen_id IS NULL THEN 7 ELSE -1 END) AS part
       FROM specimens s LEFT JOIN (
         SELECT CAST(l_orderkey AS VARCHAR) AS specimen_id,
                last(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END ORDER BY l_linenumber, l_partkey, l_suppkey) AS part
         FROM lineitem GROUP BY l_orderkey) r ON r.specimen_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    base = m.specimens.select("specimen_id", F.lit(7).cast("bigint").alias("part"))
    out = ingest.append_results(
        base, _price_results(m), "specimen", "parts", "2024-06-01", overwrite=True, order_col="at"
    )
    return out.select("specimen_id", "part").fillna(-1, ["part"])


@query(
    "evolve_columns",
    "SELECT doc_id, lang, '' AS quality, '' AS toxic FROM documents",
)
def _(m: Model) -> DataFrame:
    out = ingest.evolve_columns(m.raw("documents").select("doc_id", "lang"), _labels(m), {"toxic": "TEXT"})
    return out.select(
        "doc_id", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"),
        F.coalesce("toxic", F.lit("")).alias("toxic"),
    )


@query(
    "prefix_columns",
    "SELECT doc_id, quality AS lab_quality, toxic AS lab_toxic, quality = 1 AS qc_pass FROM labels",
)
def _(m: Model) -> DataFrame:
    rows = _labels(m).withColumn("qc_pass", F.col("quality") == 1)
    return ingest.prefix_columns(rows, "lab", "doc_id", "labels")


@query("stamp_done", "SELECT doc_id, quality, '2024-06-01' AS labels_done FROM labels")
def _(m: Model) -> DataFrame:
    return ingest.stamp_done(_labels(m).select("doc_id", "quality"), "labels", "2024-06-01")


@query(
    "gate_missing_keys",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(m: Model) -> DataFrame:
    return ingest.gate_missing_keys(m.raw("documents"), m.raw("labels"), "doc_id")


@query(
    "gate_censored",
    """SELECT specimen_id, qc_status FROM specimens s
       WHERE qc_status IN ('fail', 'censored', 'consent_revoked')
         AND EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) = s.specimen_id)""",
)
def _(m: Model) -> DataFrame:
    return ingest.gate_censored(_price_results(m), m.specimens, "specimen_id")


def _flag_results(m: Model) -> DataFrame:
    """Result rows with pass and warn tokens in several spellings."""
    turn = F.col("event_id") % 7
    return m.raw("events").select(
        F.col("event_id").cast("string").alias("specimen_id"),
        F.when(turn == 0, "False").when(turn == 1, " no ").when(turn == 2, "maybe").otherwise("true").alias("qc_pass"),
        F.when(turn == 0, F.concat(F.lit(" low "), "event_type")).alias("qc_fail_reason"),
        F.when(turn == 3, "YES").when(turn == 4, "mapped_pct=96.00 within 3pp of fail threshold").otherwise("0").alias("qc_warn"),
    )


FLAGS_SQL = """
    flags AS (
      SELECT CAST(event_id AS VARCHAR) AS entity_id,
             CASE WHEN event_id % 7 IN (0, 1) THEN 'fail' ELSE 'warn' END AS action,
             CASE event_id % 7 WHEN 0 THEN 'low ' || event_type WHEN 1 THEN 'slurm: qc_pass=False'
                  ELSE 'slurm: qc_warn=True' END AS reason
      FROM events WHERE event_id % 7 IN (0, 1, 3))
"""


@query("autoflag_extract", "WITH " + FLAGS_SQL + "SELECT entity_id, action, reason FROM flags")
def _(m: Model) -> DataFrame:
    return qc.autoflag_extract(_flag_results(m), "specimen_id")


@query(
    "autoflag_by_value",
    """SELECT CAST(event_id AS VARCHAR) AS entity_id, form, CASE event_id % 5 WHEN 0 THEN 'fail' ELSE 'warn' END AS action
       FROM events, (SELECT unnest(['double', 'bigint', 'boolean', 'text', 'token']) AS form) WHERE event_id % 5 IN (0, 1)""",
)
def _(m: Model) -> DataFrame:
    """Flags as numbers, booleans and text: 0 fails, 1 passes, blanks, NaN and free text say nothing."""
    turn = F.col("event_id") % 5
    no, yes, silent = turn == 0, turn == 1, turn == 2
    spelled = {
        "double": [F.lit(0.0), F.lit(1.0), F.lit(float("nan"))],
        "bigint": [F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(None).cast("bigint")],
        "boolean": [F.lit(False), F.lit(True), F.lit(None).cast("boolean")],
        "text": [F.lit("0.0"), F.lit("1.0"), F.lit("nan")],
        "token": [F.lit(" No "), F.lit("Yes"), F.lit("see the report")],
    }
    found = []
    for form, (zero, one, blank) in spelled.items():
        results = m.raw("events").select(
            "event_id",
            F.when(no, zero).when(silent, blank).otherwise(one).alias("qc_pass"),
            F.when(yes, one).when(silent, blank).otherwise(zero).alias("qc_warn"),
        )
        found.append(qc.autoflag_extract(results, "event_id").select("entity_id", F.lit(form).alias("form"), "action"))
    return reduce(DataFrame.unionAll, found)


@query(
    "autoflag_apply",
    "WITH " + FLAGS_SQL
    + """SELECT entity_id, CASE action WHEN 'fail' THEN 'qc_fail' ELSE 'qc_warn' END AS kind, reason FROM flags f
         WHERE entity_id IN (SELECT specimen_id FROM specimens) AND NOT EXISTS (
           SELECT 1 FROM active_events a WHERE a.level = 'specimen' AND a.entity_id = f.entity_id
             AND a.kind = CASE f.action WHEN 'fail' THEN 'qc_fail' ELSE 'qc_warn' END)""",
)
def _(m: Model) -> DataFrame:
    flags = qc.autoflag_extract(_flag_results(m), "specimen_id")
    out = qc.autoflag_apply(flags, "specimen", m.specimens, m.qc_events, AS_OF, "txn-flags")
    return out["new_events"].select("entity_id", "kind", "reason")


@query(
    "capture_usage",
    """SELECT a.assay_id AS entity_id, r.ref_key, r.version AS version_used
       FROM assay_rows a JOIN refs r ON r.ref_key IN ('NATION_1', 'NATION_2')
       WHERE a.flagstat_done IS NOT NULL""",
)
def _(m: Model) -> DataFrame:
    entities = m.assay_rows.filter(F.col("flagstat_done").isNotNull())
    out = ingest.capture_usage(
        entities, "assay", "flagstat", ["NATION_1", "NATION_2", "NATION_99"],
        m.reference_artifacts, m.reference_usage,
    )
    return out.filter(F.col("scope") == "analysis").select("entity_id", "ref_key", "version_used")


@query(
    "capture_artifact_usage",
    """SELECT a.artifact_id, r.ref_key, r.version AS version_used FROM artifacts a JOIN refs r ON r.ref_key = 'NATION_3'
       UNION
       SELECT u.artifact_id, u.ref_key, u.version_used FROM usage u WHERE u.ref_key <> 'NATION_3'""",
)
def _(m: Model) -> DataFrame:
    return ingest.capture_artifact_usage(
        m.cohort_artifacts, ["NATION_3"], m.reference_artifacts, m.reference_usage
    ).select("artifact_id", "ref_key", "version_used")


@query(
    "capture_derivation",
    """SELECT 'analysis:assay/' || assay_id || '/flagstat' AS down_node, u.up_node
       FROM assay_rows, (VALUES ('reference:NATION_1'), ('cohort:panel@r1')) u(up_node)""",
)
def _(m: Model) -> DataFrame:
    return ingest.capture_derivation(
        m.assay_rows, "assay", "flagstat", ["reference:NATION_1", "cohort:panel@r1"]
    )


def _specimen_updates(m: Model) -> DataFrame:
    """Metadata for every fourth specimen key, new ones included, some without a parent."""
    return m.raw("events").select(
        (F.col("event_id") * 4).cast("string").alias("specimen_id"),
        F.when(F.col("event_id") % 10 == 0, F.lit("nobody")).otherwise(F.col("user_id").cast("string")).alias("patient_id"),
        F.col("event_type").alias("tissue_site"),
        F.lit("new").alias("timepoint"),
    )


@query(
    "upsert_level",
    """WITH incoming AS (
         SELECT CAST(event_id * 4 AS VARCHAR) AS specimen_id,
                CASE WHEN event_id % 10 = 0 THEN 'nobody' ELSE CAST(user_id AS VARCHAR) END AS patient_id,
                event_type AS tissue_site FROM events)
       SELECT s.specimen_id, s.patient_id, s.tissue_site, s.timepoint FROM specimens s
       UNION ALL SELECT i.specimen_id, i.patient_id, i.tissue_site, 'new' FROM incoming i
       WHERE i.specimen_id NOT IN (SELECT specimen_id FROM specimens)
         AND i.patient_id IN (SELECT patient_id FROM patients)""",
)
def _(m: Model) -> DataFrame:
    out = ingest.upsert_level(m.specimens, _specimen_updates(m), "specimen", m.patients, allow_new=True)
    return out["rows"].select("specimen_id", "patient_id", "tissue_site", "timepoint")


@query(
    "upsert_level_overwrite",
    """SELECT s.specimen_id, coalesce(CASE WHEN e.event_id % 10 = 0 THEN 'nobody' ELSE CAST(e.user_id AS VARCHAR) END, s.patient_id) AS patient_id,
              coalesce(e.event_type, s.tissue_site) AS tissue_site
       FROM specimens s LEFT JOIN events e ON CAST(e.event_id * 4 AS VARCHAR) = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    out = ingest.upsert_level(m.specimens, _specimen_updates(m), "specimen", overwrite=True)
    return out["rows"].select("specimen_id", "patient_id", "tissue_site")


@query(
    "upsert_level_rejects",
    """WITH incoming AS (
         SELECT CAST(event_id * 4 AS VARCHAR) AS specimen_id,
                CASE WHEN event_id % 10 = 0 THEN 'nobody' ELSE CAST(user_id AS VARCHAR) END AS patient_id
         FROM events)
       SELECT specimen_id AS id, 'missing_parent' AS reject FROM incoming
       WHERE specimen_id NOT IN (SELECT specimen_id FROM specimens)
         AND patient_id NOT IN (SELECT patient_id FROM patients)""",
)
def _(m: Model) -> DataFrame:
    return ingest.upsert_level(
        m.specimens, _specimen_updates(m), "specimen", m.patients, allow_new=True
    )["rejects"]


@query(
    "register_rows",
    """SELECT 'stub' AS what, CAST(count(DISTINCT user_id + 1000000) AS BIGINT) AS n FROM events
       UNION ALL SELECT 'inserted', count(*) FROM events
                 WHERE CAST(event_id * 3 AS VARCHAR) NOT IN (SELECT specimen_id FROM specimens)
       UNION ALL SELECT 'already_exists', count(*) FROM events
                 WHERE CAST(event_id * 3 AS VARCHAR) IN (SELECT specimen_id FROM specimens)""",
)
def _(m: Model) -> DataFrame:
    rows = m.raw("events").select(
        (F.col("event_id") * 3).cast("string").alias("specimen_id"),
        (F.col("user_id") + 1000000).cast("string").alias("patient_id"),
        F.col("event_type").alias("tissue_site"),
    )
    out = ingest.register_rows(m.specimens, rows, "specimen", m.patients, allow_new_parent=True)

    def count(frame, label):
        return frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("what"), "n")

    return (
        count(out["stubs"], "stub")
        .unionByName(count(out["inserted"], "inserted"))
        .unionByName(count(out["rejects"], "already_exists"))
    )


def _dirty_sheet(m: Model) -> DataFrame:
    """The sheet with planted conflicts and blanks."""
    number = F.split_part("assay_id", F.lit("-"), F.lit(2)).cast("int")
    order = F.col("specimen_id").cast("bigint")
    return m.sheet.select(
        F.when((order % 50 == 0) & (number == 2), F.lit("other")).otherwise(F.col("patient_id")).alias("patient_id"),
        "cohort",
        "site",
        "specimen_id",
        F.when((order % 40 == 0) & (number == 1), F.lit("moved")).otherwise(F.col("tissue_site")).alias("tissue_site"),
        "timepoint",
        F.when((order % 100 == 0) & (number == 3), F.lit(" ")).otherwise(F.col("assay_id")).alias("assay_id"),
        "assay_type",
        "batch_id",
    )


DIRTY_SQL = """
    dirty AS (
      SELECT CASE WHEN CAST(specimen_id AS BIGINT) % 50 = 0 AND split_part(assay_id, '-', 2) = '2' THEN 'other' ELSE patient_id END AS patient_id,
             cohort, site, specimen_id,
             CASE WHEN CAST(specimen_id AS BIGINT) % 40 = 0 AND split_part(assay_id, '-', 2) = '1' THEN 'moved' ELSE tissue_site END AS tissue_site,
             timepoint,
             CASE WHEN CAST(specimen_id AS BIGINT) % 100 = 0 AND split_part(assay_id, '-', 2) = '3' THEN ' ' ELSE assay_id END AS assay_id,
             assay_type, batch_id
      FROM sheet)
"""


@query(
    "validate_sheet",
    "WITH " + DIRTY_SQL + """
       SELECT 'blank_cell' AS "check", assay_id AS "key" FROM dirty WHERE trim(assay_id) = ''
       UNION ALL SELECT 'patient_conflict', patient_id FROM dirty GROUP BY patient_id
                 HAVING count(DISTINCT (cohort, site)) > 1
       UNION ALL SELECT 'specimen_with_several_parents', specimen_id FROM dirty GROUP BY specimen_id
                 HAVING count(DISTINCT patient_id) > 1
       UNION ALL SELECT 'specimen_conflict', specimen_id FROM dirty GROUP BY specimen_id
                 HAVING count(DISTINCT (patient_id, tissue_site, timepoint)) > 1
       UNION ALL SELECT 'assay_conflict', assay_id FROM dirty WHERE trim(assay_id) <> '' GROUP BY assay_id
                 HAVING count(DISTINCT (specimen_id, assay_type, batch_id)) > 1""",
)
def _(m: Model) -> DataFrame:
    return ingest.validate_sheet(_dirty_sheet(m)).select("check", "key")


@query(
    "explode_sheet",
    """SELECT 'patient' AS level, patient_id AS "key", cohort AS attribute FROM sheet GROUP BY 2, 3
       UNION ALL SELECT 'specimen', specimen_id, tissue_site FROM sheet GROUP BY 2, 3
       UNION ALL SELECT 'assay', assay_id, assay_type FROM sheet GROUP BY 2, 3""",
)
def _(m: Model) -> DataFrame:
    frames = ingest.explode_sheet(m.sheet)
    parts = [
        frames[lv].select(F.lit(lv).alias("level"), F.col(k).alias("key"), F.col(a).alias("attribute"))
        for lv, k, a in (
            ("patient", "patient_id", "cohort"), ("specimen", "specimen_id", "tissue_site"),
            ("assay", "assay_id", "assay_type"),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "dry_run_counts",
    """SELECT 'patient' AS level, count(DISTINCT patient_id) FILTER (WHERE cohort = 'BUILDING') AS n_existing,
              count(DISTINCT patient_id) FILTER (WHERE cohort <> 'BUILDING') AS n_new FROM sheet
       UNION ALL SELECT 'specimen', count(DISTINCT specimen_id), 0 FROM sheet
       UNION ALL SELECT 'assay', count(DISTINCT assay_id), 0 FROM sheet""",
)
def _(m: Model) -> DataFrame:
    return ingest.dry_run_counts(ingest.explode_sheet(m.sheet), {**m.tables, "patient": _half_known(m)})


def _half_known(m: Model) -> DataFrame:
    """The patients, those outside one cohort under other ids."""
    own = F.when(F.col("cohort") == "BUILDING", F.col("patient_id")).otherwise(F.concat(F.lit("x"), "patient_id"))
    return m.patients.withColumn("patient_id", own)


@query(
    "register_cohort",
    """SELECT a.assay_id, a.specimen_id, s.patient_id, p.cohort, s.tissue_site, a.assay_type
       FROM assay_rows a JOIN specimens s ON s.specimen_id = a.specimen_id JOIN patients p ON p.patient_id = s.patient_id""",
)
def _(m: Model) -> DataFrame:
    out = ingest.register_cohort(m.sheet, {**m.level_rows, "patient": _half_known(m)})
    above = out["specimen"].select("specimen_id", "patient_id", "tissue_site").join(out["patient"].select("patient_id", "cohort"), "patient_id")
    return (
        out["assay"].select("assay_id", "specimen_id", "assay_type")
        .join(above, "specimen_id")
        .select("assay_id", "specimen_id", "patient_id", "cohort", "tissue_site", "assay_type")
    )


CLASSES_SQL = """
    classes AS (
      SELECT * FROM (VALUES ('cohort', 'patient', 'constant within every patient'),
                            ('site', 'patient', 'constant within every patient'),
                            ('tissue_site', 'specimen', 'constant within every specimen'),
                            ('timepoint', 'specimen', 'constant within every specimen'),
                            ('assay_type', 'assay', 'varies within specimens'),
                            ('batch_id', 'assay', 'explicit override')) t("column", level, reason)
      WHERE (SELECT count(*) FROM sheet) > 0)
"""


@query("classify_columns", "WITH " + CLASSES_SQL + """SELECT "column", level, reason FROM classes""")
def _(m: Model) -> DataFrame:
    return ingest.classify_columns(m.sheet, overrides={"batch_id": "assay"})


@query(
    "normalize_flat",
    """SELECT 'patient' AS level, patient_id AS "key", min(cohort) AS a, min(site) AS b FROM sheet GROUP BY 2
       UNION ALL SELECT 'specimen', specimen_id, min(tissue_site), min(timepoint) FROM sheet GROUP BY 2
       UNION ALL SELECT 'assay', assay_id, assay_type, batch_id FROM sheet""",
)
def _(m: Model) -> DataFrame:
    classes = {
        r["column"]: r["level"] for r in ingest.classify_columns(m.sheet).collect()
    }
    frames = ingest.normalize_flat(m.sheet, classes)
    pick = {
        "patient": ("patient_id", "cohort", "site"),
        "specimen": ("specimen_id", "tissue_site", "timepoint"),
        "assay": ("assay_id", "assay_type", "batch_id"),
    }
    parts = [
        frames[lv].select(F.lit(lv).alias("level"), F.col(k).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
        for lv, (k, a, b) in pick.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _texts(m: Model) -> DataFrame:
    """Document attributes as text, the way a sniffed file has them."""
    return m.raw("documents").join(m.raw("labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "lang",
        F.col("quality").cast("string").alias("quality"),
        F.concat(F.col("n_chars").cast("string"), F.lit(".5")).alias("size"),
        F.when(F.col("n_chars") > 100, "True").otherwise("False").alias("long"),
        F.when(F.col("n_chars") < 0, "x").alias("nothing"),
    )


@query(
    "infer_types",
    """SELECT "column", CASE WHEN "column" = 'quality' AND (SELECT count(*) FROM doc_rows WHERE quality IS NULL) = 0
                             THEN 'INTEGER' ELSE type END AS type
       FROM (VALUES ('doc_id', 'INTEGER'), ('lang', 'TEXT'), ('quality', 'REAL'), ('size', 'REAL'),
                    ('long', 'BOOLEAN'), ('nothing', 'REAL')) t("column", type)""",
)
def _(m: Model) -> DataFrame:
    return ingest.infer_types(_texts(m))


@query(
    "migration_report",
    "WITH " + CLASSES_SQL + """
       SELECT "column", level, CASE WHEN "column" IN ('site', 'batch_id') THEN 'INTEGER' ELSE 'TEXT' END AS type, reason FROM classes""",
)
def _(m: Model) -> DataFrame:
    return ingest.migration_report(m.sheet, overrides={"batch_id": "assay"})


@query(
    "coerce_columns",
    """SELECT CAST(doc_id AS BIGINT) AS doc_id, n_chars > 100 AS "long", CAST(n_chars AS DOUBLE) + 0.5 AS size
       FROM documents WHERE doc_id % 9 <> 4""",
)
def _(m: Model) -> DataFrame:
    rows = _texts(m).select(
        "doc_id",
        F.when(F.col("doc_id").cast("bigint") % 9 == 4, "perhaps").otherwise(F.col("long")).alias("long"),
        "size",
    )
    good, _bad = ingest.coerce_columns(rows, {"doc_id": "INTEGER", "long": "BOOLEAN", "size": "REAL"})
    return good


@query(
    "seed_batches",
    """SELECT b.batch_id, count(a.assay_id) AS n_assays FROM (
         SELECT batch_id FROM batches UNION
         SELECT 'flow-' || assay_type FROM assay_rows WHERE n_reads < 5) b
       LEFT JOIN (SELECT assay_id, CASE WHEN n_reads < 5 THEN 'flow-' || assay_type ELSE batch_id END AS batch_id
                  FROM assay_rows) a ON a.batch_id = b.batch_id GROUP BY b.batch_id""",
)
def _(m: Model) -> DataFrame:
    assays = m.assay_rows.select(
        "assay_id",
        F.when(F.col("n_reads") >= 5, F.col("batch_id")).alias("batch_id"),
        F.when(F.col("n_reads") < 5, F.concat(F.lit("flow-"), "assay_type")).alias("flowcell_id"),
    )
    batches, assays = ingest.seed_batches(assays, m.batches)
    counts = assays.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return batches.join(counts, "batch_id", "left").select(
        "batch_id", F.coalesce("n", F.lit(0)).alias("n_assays")
    )


@query(
    "migrate_legacy_qc",
    """SELECT assay_id AS entity_id, 'qc_fail' AS kind, 'import' AS source FROM assay_rows WHERE n_reads < 3""",
)
def _(m: Model) -> DataFrame:
    legacy = m.assay_rows.select("assay_id", F.when(F.col("n_reads") < 40, F.col("n_reads") >= 3).alias("qc_pass"))
    _rest, events = ingest.migrate_legacy_qc(legacy, AS_OF, "txn-migrate")
    return events.select("entity_id", "kind", "source")


@query(
    "derive_sheet_keys",
    """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, CAST(o_custkey AS VARCHAR) || '_' || o_orderstatus AS specimen_id,
              CAST(o_orderkey AS VARCHAR) AS assay_id, 'WGS' AS assay_type FROM orders""",
)
def _(m: Model) -> DataFrame:
    sheet = m.raw("orders").select(
        F.col("o_custkey").alias("patient"), F.col("o_orderstatus").alias("condition"), F.col("o_orderkey").alias("sample")
    )
    out = ingest.derive_sheet_keys(sheet, constants={"assay_type": "WGS"})
    return out.select("patient_id", "specimen_id", "assay_id", "assay_type")


@query(
    "append_project",
    "WITH " + FLAGS_SQL + """,
       hit AS (SELECT * FROM active_events WHERE level = 'specimen'
               UNION ALL SELECT '', 'specimen', entity_id, CASE action WHEN 'fail' THEN 'qc_fail' ELSE 'qc_warn' END, '', NULL, NULL, 0 FROM flags),
       worst AS (SELECT entity_id, max(CASE WHEN kind IN ('qc_fail', 'protocol_deviation') THEN 3
                                            WHEN kind IN ('qc_warn', 'batch_effect_flagged') THEN 1 ELSE 2 END) AS sev
                 FROM hit GROUP BY entity_id)
       SELECT s.specimen_id, coalesce(e.event_type, '') AS run_kind,
              CASE WHEN e.event_id IS NOT NULL THEN '2024-06-01' ELSE '' END AS flags_done,
              CASE coalesce(w.sev, 0) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'censored' ELSE 'fail' END AS qc_status
       FROM specimens s LEFT JOIN events e ON CAST(e.event_id AS VARCHAR) = s.specimen_id
       LEFT JOIN worst w ON w.entity_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    kinds = m.raw("events").select(F.col("event_id").cast("string").alias("specimen_id"), F.col("event_type").alias("kind"))
    results = _flag_results(m).join(kinds, "specimen_id")
    out = ingest.append(
        m.specimens, results, "specimen", "flags", m.qc_events, "2024-06-01", "txn-append", prefix="run"
    )
    return out["rows"].select("specimen_id", "run_kind", "flags_done", "qc_status").fillna("", ["run_kind", "flags_done"])


@query(
    "constraints_schema",
    """SELECT 'enum:assay_type' AS detail, count(*) AS n FROM assay_rows WHERE assay_type NOT IN ('A', 'N')""",
)
def _(m: Model) -> DataFrame:
    from cohort_ledger.operators import validate

    levels = list(DEFAULT_SCHEMA.levels)
    levels[2] = replace(
        levels[2], columns=(ColumnSpec("assay_type", required=True, enum=("A", "N")), ColumnSpec("batch_id"))
    )
    schema = replace(DEFAULT_SCHEMA, levels=tuple(levels))
    issues = validate.constraints(m.level_rows, schema)
    return issues.groupBy("detail").agg(F.count(F.lit(1)).alias("n"))

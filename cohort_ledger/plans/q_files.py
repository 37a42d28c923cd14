"""Sources, sinks, file summaries and streams.

Files are written from the given tables to a fresh folder below the shared one,
then read back by the operator under test.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger import sinks, sources, streaming
from cohort_ledger.operators import summaries, validate, views
from cohort_ledger.plans.dataset import AS_OF, Model
from cohort_ledger.plans.q_qc import REPLAY_SQL
from cohort_ledger.plans.registry import query
from cohort_ledger.session import cut, fresh_path
from cohort_ledger.sinks import colocated, versions
from cohort_ledger.streaming import compact

DOC_FIELDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def _docs(m: Model) -> DataFrame:
    return m.raw("documents").select(*DOC_FIELDS.names)


@query("read_manifest", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "manifest")
    sinks.write_table(_docs(m), path, "tsv")
    return sources.read_manifest(m.spark, path, DOC_FIELDS)


@query("read_manifest_sniffed", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "manifest")
    sinks.write_table(_docs(m), path, "tsv")
    out = sources.read_manifest(m.spark, path)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in DOC_FIELDS.fields])


@query(
    "read_manifests_union",
    """SELECT CASE WHEN lang = 'en' THEN 'alpha' ELSE 'beta' END AS project, CAST(doc_id AS VARCHAR) AS doc_id,
              CASE WHEN lang = 'en' THEN lang ELSE '~' END AS lang, CASE WHEN lang = 'en' THEN '~' ELSE source END AS source,
              CAST(CASE WHEN lang = 'en' THEN 2 ELSE 2 END AS INTEGER) AS n_columns
       FROM documents""",
)
def _(m: Model) -> DataFrame:
    root = fresh_path(m.spark, "projects")
    docs = _docs(m)
    sinks.write_table(docs.filter("lang = 'en'").select("doc_id", "lang"), f"{root}/alpha", "tsv")
    sinks.write_table(docs.filter("lang <> 'en'").select("doc_id", "source"), f"{root}/beta", "tsv")
    sinks.write_table(docs.select("n_chars"), f"{root}/sandbox", "tsv")
    out = sources.read_manifests_union(m.spark, root, "part-*.csv")
    return out.select(
        "project", "doc_id", F.coalesce("lang", F.lit("~")).alias("lang"),
        F.coalesce("source", F.lit("~")).alias("source"), F.size("manifest_columns").alias("n_columns"),
    )


@query(
    "read_levels",
    """SELECT a.assay_id, s.patient_id, a.qc_status FROM assays a JOIN specimens s USING (specimen_id)
       JOIN patients p USING (patient_id)""",
)
def _(m: Model) -> DataFrame:
    root = fresh_path(m.spark, "snapshot")
    for name in ("patients", "specimens", "assays"):
        sinks.write_table(getattr(m, name), f"{root}/{name}")
    tables = sources.read_levels(m.spark, root)
    return views.joined(tables["patient"], tables["specimen"], tables["assay"]).select(
        "assay_id", "patient_id", F.col("assay_qc_status").alias("qc_status")
    )


@query("read_sample_sheet", "SELECT * FROM sheet")
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "sheet")
    sinks.write_table(m.sheet, path, "tsv")
    return sources.read_sample_sheet(m.spark, path, m.sheet.columns)


@query("read_results", "SELECT doc_id, quality, toxic FROM labels")
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "results")
    labels = m.raw("labels").select("doc_id", "quality", "toxic")
    sinks.write_table(labels.repartition(4), path, "tsv")
    return sources.read_results(m.spark, path, labels.schema)


@query(
    "read_results_by_layout",
    """SELECT lower(c_mktsegment) AS tool, CAST(c_nationkey AS VARCHAR) AS patient_id, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys,
              'matched' AS outcome
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2
       UNION ALL SELECT '~', '~', count(*), CAST(sum(c_custkey) AS BIGINT),
              CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'level_disagrees' ELSE 'tool_not_declared' END
       FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 5""",
)
def _(m: Model) -> DataFrame:
    root = fresh_path(m.spark, "results-tree")
    rows = m.raw("customer").select(
        F.lower("c_mktsegment").alias("tool"), F.lit("r1").alias("run"), F.col("c_nationkey").alias("patient"), "c_custkey"
    )
    rows.repartition("tool", "patient").write.partitionBy("tool", "run", "patient").option("sep", "\t").option(
        "header", True
    ).csv(root)
    good, bad = sources.read_results_by_layout(
        m.spark,
        root,
        T.StructType([T.StructField("c_custkey", T.LongType())]),
        {
            "patient": "tool={tool}/run={run_tag}/patient={patient_id}",
            "specimen": "tool={tool}/run={run_tag}/patient={patient_id}/specimen={specimen_id}",
        },
        {"building": {"level": "patient"}, "machinery": {"level": "patient"}, "household": {"level": "assay"}},
        glob="*.csv",
    )
    matched = good.select("tool", "patient_id", "c_custkey", F.lit("matched").alias("outcome"))
    rejected = bad.select(
        F.lit("~").alias("tool"), F.lit("~").alias("patient_id"), "c_custkey", F.col("reject").alias("outcome")
    )
    return matched.unionByName(rejected).groupBy("tool", "patient_id", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")
    )


LOG_SQL = """
    SELECT 2 * seq AS seq, 'censor' AS action, level, entity_id, kind FROM qc_events
    UNION ALL SELECT 2 * (seq + 333) + 1, 'uncensor', level, entity_id, kind FROM qc_events WHERE resolved_at IS NOT NULL"""


@query("read_event_log", LOG_SQL)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "log")
    lines = m.qc_log.select(F.to_json(F.struct("*")).alias("value"))
    broken = m.raw("events").filter("event_type = 'signup'").select(
        F.concat(F.lit('{"action": "censor", "entity_id": '), F.col("event_id").cast("string")).alias("value")
    )
    lines.unionByName(broken).write.text(path)
    return sources.read_event_log(m.spark, path).select("seq", "action", "level", "entity_id", "kind")


@query("read_event_log_strict", LOG_SQL)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "log")
    sinks.write_table(m.qc_log, path, "json")
    return sources.read_event_log(m.spark, path, strict=True).select(
        "seq", "action", "level", "entity_id", "kind"
    )


@query(
    "read_bulk_qc",
    """SELECT entity_id, kind, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'blank: reason' ELSE 'ok' END AS outcome FROM qc_events""",
)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "bulk-qc")
    reason = F.when(F.col("id").cast("bigint") % 5 != 0, F.col("reason")).otherwise(F.lit(" "))
    sinks.write_table(m.qc_events.select("level", "entity_id", "kind", reason.alias("reason")), path, "tsv")
    good, bad = sources.read_bulk_qc(m.spark, path)
    return good.select("entity_id", "kind", F.lit("ok").alias("outcome")).unionByName(
        bad.select("entity_id", "kind", F.col("reject").alias("outcome"))
    )


@query(
    "read_bulk_lineage",
    """SELECT source_assay_id, coalesce(merged_assay_id, '') AS merged_assay_id,
              coalesce(consumer_specimen_id, '') AS consumer_specimen_id FROM sources""",
)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "links")
    sinks.write_table(m.assay_sources, path, "csv")
    good, _bad = sources.read_bulk_lineage(m.spark, path, "links", ",")
    return good.fillna("", ["merged_assay_id", "consumer_specimen_id"])


@query("read_artifact_inputs", "SELECT assay_id, 'tumor' AS role FROM artifact_inputs")
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "inputs")
    rows = m.cohort_artifact_inputs.select("assay_id", F.lit("tumor").alias("role"))
    sinks.write_table(rows, path, "tsv")
    return sources.read_artifact_inputs(m.spark, path)


@query(
    "parse_artifact_inputs",
    """SELECT CAST(o_orderkey AS VARCHAR) AS artifact_id, 'A' || o_orderkey AS assay_id, o_orderstatus AS role FROM orders
       UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'B' || o_custkey, '~' FROM orders""",
)
def _(m: Model) -> DataFrame:
    text = F.concat(
        F.lit("A"), F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderstatus",
        F.lit(", B"), F.col("o_custkey").cast("string"), F.lit(","),
    )
    rows = m.raw("orders").select(F.col("o_orderkey").cast("string").alias("artifact_id"), text.alias("inputs"))
    return sources.parse_artifact_inputs(rows, "inputs").fillna("~", ["role"])


@query(
    "init_manifest",
    """SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, coalesce(CAST(l.quality AS VARCHAR), '~') AS quality, '~' AS note
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "samples")
    ids = m.raw("documents").select(F.explode(F.array(F.col("doc_id").cast("string"), F.lit(""), F.lit("# comment"))).alias("value"))
    ids.write.text(path)
    metadata = m.raw("labels").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("quality").cast("string").alias("quality"))
    return sources.init_manifest(m.spark, path, metadata, ["note"]).fillna("~")


# Sinks


@query(
    "write_table",
    """SELECT f.format AS "format", lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
       FROM documents, (VALUES ('tsv'), ('csv'), ('json'), ('parquet')) f("format") GROUP BY 1, 2""",
)
def _(m: Model) -> DataFrame:
    out = None
    for fmt in ("tsv", "csv", "json", "parquet"):
        path = fresh_path(m.spark, fmt)
        sinks.write_table(_docs(m), path, fmt)
        reader = m.spark.read.schema(DOC_FIELDS)
        if fmt in ("tsv", "csv"):
            back = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
        else:
            back = getattr(reader, fmt)(path)
        part = back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
        part = part.withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "export_tables",
    """SELECT 'patients' AS "table", count(*) AS n FROM active_p WHERE patient_id IN (SELECT patient_id FROM active_s WHERE specimen_id IN (
                SELECT specimen_id FROM active_a WHERE assay_type = 'A'))
       UNION ALL SELECT 'specimens', count(*) FROM active_s WHERE specimen_id IN (SELECT specimen_id FROM active_a WHERE assay_type = 'A')
       UNION ALL SELECT 'assays', count(*) FROM active_a WHERE assay_type = 'A'
       UNION ALL SELECT 'cohort_artifacts', count(*) FROM artifacts
       UNION ALL SELECT 'assay_sources', count(*) FROM sources""",
)
def _(m: Model) -> DataFrame:
    frames = sinks.export_plan(
        *m.written_levels(),
        subset=m.assay_rows.filter("assay_type = 'A'").select("assay_id"),
        cohort_artifacts=m.cohort_artifacts,
        assay_sources=m.assay_sources,
    )
    paths = sinks.export_tables(frames, fresh_path(m.spark, "export"), "parquet")
    counts = [
        m.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        for name, path in paths.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "export_everything",
    """SELECT 'cohort_artifacts' AS "table", a.artifact_id AS "key", CAST(d.stale_inputs AS VARCHAR) || ' ' || CAST(d.stale_inputs > 0 AS VARCHAR) AS detail
       FROM artifacts a JOIN direct d ON d.node = a.node
       UNION ALL SELECT 'cohort_artifact_inputs', CAST(artifact_id AS VARCHAR), assay_id FROM artifact_inputs
       UNION ALL SELECT 'reference_usage', CAST(artifact_id AS VARCHAR), ref_key || ' ' || version_used FROM usage
       UNION ALL SELECT 'patients', patient_id, cohort FROM active_p
       UNION ALL SELECT 'specimens', specimen_id, patient_id FROM active_s
       UNION ALL SELECT 'assays', assay_id, specimen_id FROM active_a""",
)
def _(m: Model) -> DataFrame:
    frames = sinks.export_plan(
        *m.levels, cohort_artifacts=m.cohort_artifacts, cohort_artifact_inputs=m.cohort_artifact_inputs, reference_usage=m.reference_usage
    )
    paths = sinks.export_tables(frames, fresh_path(m.spark, "export"), "parquet")
    details = {
        "cohort_artifacts": ("artifact_id", ["n_censored_inputs", "stale"]), "cohort_artifact_inputs": ("artifact_id", ["assay_id"]),
        "reference_usage": ("artifact_id", ["ref_key", "version_used"]), "patients": ("patient_id", ["cohort"]),
        "specimens": ("specimen_id", ["patient_id"]), "assays": ("assay_id", ["specimen_id"]),
    }
    parts = [
        m.spark.read.parquet(paths[t]).select(
            F.lit(t).alias("table"), F.col(key).cast("string").alias("key"), F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("detail")
        )
        for t, (key, columns) in details.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "export_joined",
    """SELECT a.assay_id, s.patient_id, a.qc_status AS assay_qc_status, s.qc_status AS specimen_qc_status
       FROM active_a a JOIN specimens s USING (specimen_id)""",
)
def _(m: Model) -> DataFrame:
    path = fresh_path(m.spark, "joined")
    sinks.export_joined(*m.levels, path)
    return m.spark.read.parquet(path).select(
        "assay_id", "patient_id", "assay_qc_status", "specimen_qc_status"
    )


@query("export_sql", "SELECT assay_type, count(*) AS n FROM active_a GROUP BY assay_type")
def _(m: Model) -> DataFrame:
    views.register_views(m.spark, *m.levels)
    path = fresh_path(m.spark, "query")
    sinks.export_sql(m.spark, "SELECT assay_type, count(*) AS n FROM _active GROUP BY assay_type", path)
    return m.spark.read.parquet(path)


@query(
    "export_audit",
    """SELECT CASE qc_status WHEN 'fail' THEN 'qc_failed_assay' ELSE 'censored_assay' END AS reason, 'assay' AS level, count(*) AS n
       FROM assays WHERE qc_status IN ('fail', 'censored') GROUP BY 1
       UNION ALL SELECT 'consent_revoked_patient', 'patient', count(*) FROM patients
                 WHERE consent_status NOT IN ('consented', 'consented_limited_use')
       UNION ALL SELECT 'consent_revoked_assay', 'assay', count(*)
                 FROM assays a JOIN specimens s USING (specimen_id) JOIN patients p USING (patient_id)
                 WHERE p.consent_status NOT IN ('consented', 'consented_limited_use')""",
)
def _(m: Model) -> DataFrame:
    return sinks.export_audit(*m.levels)


@query(
    "collect_capped",
    """SELECT assay_id, (SELECT count(*) FROM active_a) > 500 AS truncated FROM active_a ORDER BY assay_id LIMIT 500""",
)
def _(m: Model) -> DataFrame:
    from cohort_ledger.operators.active import active_assays

    ordered = active_assays(*m.levels).select("assay_id").orderBy("assay_id")
    rows, truncated = sinks.collect_capped(ordered, 500)
    return m.spark.createDataFrame([(r.assay_id, truncated) for r in rows], "assay_id string, truncated boolean")


CHECKSUM_SQL = """
    SELECT 'supplier ' || s_suppkey AS "key", CASE WHEN s_suppkey % 3 = 1 THEN 'changed' ELSE 'missing' END AS detail
    FROM supplier WHERE s_suppkey % 3 > 0"""


def _logged_files(m: Model) -> tuple[DataFrame, DataFrame]:
    """A file for each supplier, and the log of them: a third changed, a third gone."""
    root = fresh_path(m.spark, "logged")
    supplier = m.raw("supplier").select(
        "s_suppkey", F.concat(F.lit("s_suppkey="), "s_suppkey", F.lit(".txt")).alias("name"), F.concat("s_name", F.lit("\n")).alias("content")
    )
    written = sinks.write_files(supplier, root)
    log = written.select(
        F.when(F.col("s_suppkey") % 3 == 2, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("results_file"),
        F.when(F.col("s_suppkey") % 3 == 1, F.lit("0" * 32)).otherwise(F.md5("content")).alias("results_checksum"),
    )
    files = m.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    return log, files


def _named(issues: DataFrame) -> DataFrame:
    return issues.select(
        F.concat(F.lit("supplier "), F.regexp_extract("key", r"s_suppkey=(\d+)", 1)).alias("key"), "detail"
    )


@query("checksum_match", CHECKSUM_SQL)
def _(m: Model) -> DataFrame:
    return _named(validate.checksum_match(*_logged_files(m)))


@query("checksum_by_ranges", CHECKSUM_SQL)
def _(m: Model) -> DataFrame:
    log, _ = _logged_files(m)
    return _named(validate.checksum_match(log, sources.file_digests(log, "results_file")))


# Summaries of result files


def _pileup_lines(m: Model) -> DataFrame:
    """One pileup line per line item, grouped under its supplier."""
    key = F.col("l_orderkey").cast("string")
    code = F.when(F.col("l_returnflag") == "A", "m").when(F.col("l_returnflag") == "N", "5mC").otherwise("h")
    coverage = F.when(F.col("l_linenumber") == 7, "bad").otherwise(F.col("l_quantity").cast("int").cast("string"))
    share = F.when(F.col("l_linenumber") == 6, "NA").otherwise((F.col("l_orderkey") % 101).cast("string"))
    line = F.concat_ws("\t", F.lit("chr1"), key, key, code, F.lit("0"), F.lit("+"), key, key, F.lit("0,0,0"), coverage, share)
    lines = m.raw("lineitem").select(F.col("l_suppkey").cast("string").alias("assay_id"), line.alias("line"))
    heads = m.raw("supplier").select(F.col("s_suppkey").cast("string").alias("assay_id"), F.lit("# head").alias("line"))
    return lines.unionByName(heads)


@query(
    "methylation_summary",
    """SELECT CAST(s_suppkey AS VARCHAR) AS assay_id, coalesce(n, 0) AS n_cpg_sites,
              coalesce(((200 * s + n) // (2 * n)) / 10000.0::DOUBLE, 0.0) AS mean_meth, coalesce(round(med / 100.0, 4), 0.0) AS median_meth,
              coalesce(((20000 * high + n) // (2 * n)) / 100.0::DOUBLE, 0.0) AS pct_high_conf
       FROM supplier LEFT JOIN (
         SELECT l_suppkey, count(*) AS n, CAST(sum(l_orderkey % 101) AS BIGINT) AS s, median(l_orderkey % 101) AS med,
                count(*) FILTER (WHERE l_linenumber <> 7 AND l_quantity >= 5) AS high
         FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber <> 6 GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
)
def _(m: Model) -> DataFrame:
    return summaries.methylation_summary(_pileup_lines(m))


@query(
    "methylation_summary_flat",
    """SELECT CAST(s_suppkey AS VARCHAR) AS assay_id, coalesce(n, 0) AS modkit_total_cpg,
              ((200 * s + c) // (2 * c)) / 10000.0::DOUBLE AS modkit_mean_meth, round(med / 100.0, 4) AS modkit_median_meth,
              ((20000 * above + n) // (2 * n)) / 10000.0::DOUBLE AS modkit_meth_above_50pct,
              ((20 * cov + k) // (2 * k)) / 10.0::DOUBLE AS modkit_mean_coverage
       FROM supplier LEFT JOIN (
         SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_linenumber <> 6) AS c,
                CAST(sum(CASE WHEN l_linenumber <> 6 THEN l_orderkey % 101 END) AS BIGINT) AS s,
                median(CASE WHEN l_linenumber <> 6 THEN l_orderkey % 101 END) AS med,
                count(*) FILTER (WHERE l_linenumber <> 6 AND l_orderkey % 101 > 50) AS above,
                CAST(sum(CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INT) END) AS BIGINT) AS cov,
                count(*) FILTER (WHERE l_linenumber <> 7) AS k
         FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
)
def _(m: Model) -> DataFrame:
    return summaries.methylation_summary_flat(_pileup_lines(m))


@query(
    "sv_summary",
    """SELECT CAST(l_suppkey AS VARCHAR) AS assay_id, count(*) FILTER (WHERE l_linenumber < 7) AS n_svs_total,
              count(*) FILTER (WHERE l_linenumber = 1) AS n_ins, count(*) FILTER (WHERE l_linenumber = 2) AS n_del,
              count(*) FILTER (WHERE l_linenumber = 3) AS n_inv, count(*) FILTER (WHERE l_linenumber IN (4, 5, 6)) AS n_bnd,
              CAST(floor(coalesce(median(CASE WHEN l_linenumber < 5 THEN l_partkey END), 0)) AS BIGINT) AS sv_size_median
       FROM lineitem GROUP BY l_suppkey""",
)
def _(m: Model) -> DataFrame:
    number = F.col("l_linenumber")
    kind = (
        F.when(number == 1, "INS").when(number == 2, "DEL").when(number == 3, "INV").when(number == 4, "DUP")
        .when(number == 5, "BND").when(number == 6, "TRA")
    )
    size = F.when(number == 2, F.concat(F.lit("-"), F.col("l_partkey").cast("string"))).when(number < 5, F.col("l_partkey").cast("string"))
    info = F.concat_ws(
        ";", F.lit("PRECISE"), F.concat(F.lit("SVTYPE="), kind), F.concat(F.lit("SVLEN="), size)
    )
    line = F.concat_ws("\t", F.lit("chr1"), F.col("l_orderkey").cast("string"), F.lit("id"), F.lit("N"), F.lit("N"), F.lit("."), F.lit("PASS"), info)
    lines = m.raw("lineitem").select(F.col("l_suppkey").cast("string").alias("assay_id"), line.alias("line"))
    return summaries.sv_summary(lines)


def _reports(m: Model, key: str = "assay_id") -> DataFrame:
    """An alignment report per order; every fiftieth lacks the duplicates line."""
    total = F.col("o_orderkey") * 700 + 1000
    mapped = F.expr("(o_orderkey * 700 + 1000) * (60 + o_orderkey % 41) div 100")

    def line(n, text):
        return F.concat(n.cast("string"), F.lit(f" + 0 {text}"))

    text = F.concat_ws(
        "\n",
        line(total, "in total (QC-passed reads + QC-failed reads)"),
        line(F.lit(0), "secondary"),
        line(F.expr("o_orderkey % 17"), "supplementary"),
        F.when(F.col("o_orderkey") % 50 != 0, line(F.expr("o_orderkey % 19"), "duplicates")),
        line(mapped, "mapped (97.50% : N/A)"),
        line(F.lit(0), "paired in sequencing"),
        line(F.expr("o_orderkey % 23"), "properly paired (N/A : N/A)"),
    )
    return m.raw("orders").select(F.col("o_orderkey").cast("string").alias(key), text.alias("text"))


STATS_SQL = """
    stats AS (
      SELECT o_orderkey, o_orderkey * 700 + 1000 AS total, (o_orderkey * 700 + 1000) * (60 + o_orderkey % 41) // 100 AS mapped,
             ((20000 * ((o_orderkey * 700 + 1000) * (60 + o_orderkey % 41) // 100) + (o_orderkey * 700 + 1000))
              // (2 * (o_orderkey * 700 + 1000))) / 100.0::DOUBLE AS pct
      FROM orders),
    flagged AS (
      SELECT *, CASE WHEN total < 1000000 THEN 'total_reads=' || format('{:,}', total) || ' < 1,000,000 (min)' END AS r1,
             CASE WHEN pct < 95.0 THEN 'mapped_pct=' || format('{:.2f}', pct) || ' < 95.0 (min)' END AS r2 FROM stats)
"""


@query(
    "alignment_summary",
    "WITH " + STATS_SQL + """
       SELECT CAST(o_orderkey AS VARCHAR) AS assay_id, total AS total_reads, mapped AS mapped_reads, pct AS mapped_pct,
              o_orderkey % 23 AS properly_paired_reads,
              CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_orderkey % 19 END AS duplicates_reads,
              o_orderkey % 17 AS supplementary_reads,
              CASE WHEN o_orderkey % 50 = 0 THEN 'duplicates_reads' ELSE '' END AS reject FROM stats""",
)
def _(m: Model) -> DataFrame:
    return summaries.alignment_summary(_reports(m)).fillna(-1, ["duplicates_reads"]).fillna("", ["reject"])


@query(
    "insertion_summary",
    """SELECT CAST(l_suppkey AS VARCHAR) AS assay_id, count(*) AS tldr_total_insertions,
              count(*) FILTER (WHERE l_returnflag <> 'N') AS tldr_l1_insertions,
              count(*) FILTER (WHERE l_returnflag <> 'N' AND l_linenumber <> 4 AND l_partkey * 10 > 6000) AS tldr_full_length,
              CAST((20 * sum(CAST(l_quantity AS INT)) + count(*)) // (2 * count(*)) AS BIGINT) / 10.0::DOUBLE AS tldr_mean_support
       FROM lineitem GROUP BY l_suppkey""",
)
def _(m: Model) -> DataFrame:
    family = F.when(F.col("l_returnflag") == "A", "L1HS").when(F.col("l_returnflag") == "N", "ALU").otherwise("line-2")
    table = m.raw("lineitem").select(
        F.col("l_suppkey").cast("string").alias("assay_id"),
        family.alias("Family"),
        F.when(F.col("l_linenumber") == 4, "NA").otherwise((F.col("l_partkey") * 10).cast("string")).alias("TE len"),
        F.col("l_quantity").cast("int").cast("string").alias("NumReads"),
    )
    return summaries.insertion_summary(table)


@query(
    "threshold_flags",
    "WITH " + STATS_SQL + """
       SELECT CAST(o_orderkey AS VARCHAR) AS assay_id,
              CASE WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 'false' ELSE 'true' END AS qc_pass,
              concat_ws('; ', r1, r2) AS qc_fail_reason,
              CASE WHEN r1 IS NULL AND r2 IS NULL AND pct < 98.0
                   THEN 'mapped_pct=' || format('{:.2f}', pct) || ' within 3pp of fail threshold' ELSE '' END AS qc_warn
       FROM flagged""",
)
def _(m: Model) -> DataFrame:
    stats = summaries.alignment_summary(_reports(m))
    return summaries.threshold_flags(stats).select("assay_id", "qc_pass", "qc_fail_reason", "qc_warn")


@query(
    "merge_summary",
    "WITH " + STATS_SQL + """
       SELECT CAST(f.o_orderkey AS VARCHAR) AS specimen_id, count(a.assay_id) AS merged_n_input_bams,
              f.total AS merged_total_reads, f.mapped AS merged_mapped_reads, f.pct AS merged_mapped_pct,
              CASE WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 'false' ELSE 'true' END AS qc_pass
       FROM flagged f LEFT JOIN assay_rows a ON a.specimen_id = CAST(f.o_orderkey AS VARCHAR)
       GROUP BY f.o_orderkey, f.total, f.mapped, f.pct, f.r1, f.r2""",
)
def _(m: Model) -> DataFrame:
    inputs = m.assay_rows.select("specimen_id", F.concat("assay_id", F.lit(".bam")).alias("path"))
    out = summaries.merge_summary(inputs, _reports(m, "specimen_id"))
    return out.drop("qc_fail_reason", "qc_warn")


@query(
    "threshold_flags_multi",
    """SELECT doc_id, CASE WHEN n_chars < 1000 OR doc_id % 30 > 20 THEN 'false' ELSE 'true' END AS qc_pass,
              concat_ws('; ', CASE WHEN n_chars < 1000 THEN 'n_cells=' || n_chars || ' < 1000' END,
                        CASE WHEN doc_id % 30 > 20 THEN 'pct_mito=' || (doc_id % 30) || '.0% > 20 (high mitochondrial)' END) AS qc_fail_reason,
              CASE WHEN n_chars >= 1000 AND doc_id % 30 BETWEEN 16 AND 20
                   THEN 'pct_mito=' || (doc_id % 30) || '.0% within 5pp of fail threshold' ELSE '' END AS qc_warn
       FROM documents""",
)
def _(m: Model) -> DataFrame:
    stats = m.raw("documents").select(
        "doc_id", F.col("n_chars").alias("n_cells"), (F.col("doc_id") % 30).cast("double").alias("pct_mito")
    )
    return summaries.threshold_flags_multi(stats).drop("n_cells", "pct_mito")


# Streams


@query(
    "stream_append",
    """SELECT s.specimen_id, CASE WHEN l.n IS NULL THEN '~' WHEN CAST(s.specimen_id AS BIGINT) % 2 = 0 THEN 'first' ELSE 'second' END AS wave,
              CASE WHEN l.n IS NULL THEN '~' ELSE '2024-06-01' END AS wave_done
       FROM specimens s LEFT JOIN (SELECT specimen_id, count(*) AS n FROM assay_rows GROUP BY specimen_id) l
         ON l.specimen_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    spark = m.spark
    landing, out, checkpoint = (fresh_path(spark, n) for n in ("landing", "stream", "progress"))
    schema = T.StructType([T.StructField("specimen_id", T.StringType()), T.StructField("wave", T.StringType())])
    keys = m.assay_rows.select("specimen_id").distinct()
    even = keys.filter(F.col("specimen_id").cast("bigint") % 2 == 0)
    for rows, wave in ((even, "first"), (keys, "second")):
        files = rows.withColumn("wave", F.lit(wave))
        files.write.mode("append").option("header", True).option("sep", "\t").csv(landing)
        streaming.stream_append(
            spark, landing, schema, "specimen_id", "wave", out, checkpoint, "2024-06-01", level="specimen"
        ).awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    rows = streaming.current_rows(m.specimens.select("specimen_id"), results, "specimen_id")
    return rows.fillna("~")


@query(
    "stream_flags",
    """SELECT DISTINCT CAST(e.user_id AS VARCHAR) AS entity_id, 'qc_fail' AS kind, 'wave ' || CASE WHEN f.n = 1 THEN 'second' ELSE 'first' END AS reason
       FROM events e JOIN (SELECT user_id, min(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END) AS n FROM events GROUP BY user_id) f ON f.user_id = e.user_id
       WHERE CAST(e.user_id AS VARCHAR) IN (SELECT patient_id FROM patients)
         AND NOT EXISTS (SELECT 1 FROM active_events a WHERE a.level = 'patient' AND a.kind = 'qc_fail' AND a.entity_id = CAST(e.user_id AS VARCHAR))""",
)
def _(m: Model) -> DataFrame:
    """Failed flags that come twice, for known and unknown patients, in two waves."""
    spark = m.spark
    landing, out, checkpoint = (fresh_path(spark, n) for n in ("landing", "stream", "progress"))
    names = ("patient_id", "qc_pass", "qc_fail_reason")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    for n, wave in enumerate(("first", "second")):
        rows = m.raw("events").filter(F.col("event_id") % 2 == n).select(
            F.col("user_id").cast("string").alias("patient_id"), F.lit("0.0").alias("qc_pass"), F.lit(f"wave {wave}").alias("qc_fail_reason")
        )
        rows.write.mode("append").option("header", True).option("sep", "\t").csv(landing)
        streaming.stream_append(
            spark, landing, schema, "patient_id", "wave", out, checkpoint, AS_OF, level="patient"
        ).awaitTermination()
    flags = spark.read.parquet(f"{out}/events")
    found = streaming.current_flags(flags, m.patients, m.qc_events, "patient_id")
    return found.select("entity_id", "kind", "reason")


@query(
    "stream_qc_log",
    "WITH " + REPLAY_SQL + """
       SELECT id, p.level, p.entity_id, kind, after IS NULL AS active FROM paired p
       JOIN known k ON k.level = p.level AND k.entity_id = p.entity_id WHERE op = 'open'""",
)
def _(m: Model) -> DataFrame:
    spark = m.spark
    landing, out, checkpoint = (fresh_path(spark, n) for n in ("log", "events", "progress"))
    # Closes land before opens: the state must not depend on the order.
    for action in ("uncensor", "censor"):
        m.qc_log.filter(F.col("action") == action).write.mode("append").json(landing)
        streaming.stream_qc_log(spark, landing, out, checkpoint).awaitTermination()
    events = streaming.current_events(spark.read.parquet(f"{out}/log"), *m.level_rows.values())
    return events.select("id", "level", "entity_id", "kind", F.col("resolved_at").isNull().alias("active"))


@query(
    "stream_qc_state",
    "WITH " + REPLAY_SQL + """
       SELECT id, p.level, p.entity_id, kind, after IS NULL AS active FROM paired p
       JOIN known k ON k.level = p.level AND k.entity_id = p.entity_id WHERE op = 'open'""",
)
def _(m: Model) -> DataFrame:
    """The whole log in three waves that mix its order, through keyed state."""
    spark = m.spark
    landing, out, checkpoint = (fresh_path(spark, n) for n in ("log", "changes", "progress"))
    m.qc_events = cut(m.qc_events)  # read once for each wave
    log = m.qc_log
    for wave in range(3):
        log.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == wave).write.mode("append").option("compression", "gzip").json(landing)
        streaming.stream_qc_state(spark, landing, out, checkpoint).awaitTermination()
    events = streaming.state_events(spark.read.parquet(out), m.patient_rows, m.specimen_rows, m.assay_ids)
    return events.select("id", "level", "entity_id", "kind", F.col("resolved_at").isNull().alias("active"))


@query(
    "stream_append_compacted",
    """SELECT s.specimen_id, CASE WHEN l.n IS NULL THEN '~' ELSE 'wave ' || (CAST(s.specimen_id AS BIGINT) % 4) END AS wave
       FROM specimens s LEFT JOIN (SELECT specimen_id, count(*) AS n FROM assay_rows GROUP BY specimen_id) l
         ON l.specimen_id = s.specimen_id""",
)
def _(m: Model) -> DataFrame:
    """Four waves, each with the keys of those before, merged into snapshots as they come."""
    spark = m.spark
    landing, out, checkpoint = (fresh_path(spark, n) for n in ("landing", "stream", "progress"))
    schema = T.StructType([T.StructField("specimen_id", T.StringType()), T.StructField("wave", T.StringType())])
    keys = cut(m.assay_rows.select("specimen_id").distinct())
    merge = compact.first_values("specimen_id")
    for n in range(4):
        files = keys.filter(F.col("specimen_id").cast("bigint") % 4 <= n).withColumn("wave", F.lit(f"wave {n}"))
        files.write.mode("append").option("header", True).option("sep", "\t").csv(landing)
        streaming.stream_append(spark, landing, schema, "specimen_id", "wave", out, checkpoint, "2024-06-01", level="specimen").awaitTermination()
        while compact.compact(spark, f"{out}/results", merge, ["specimen_id"], fan=2):
            pass
    results = compact.current(spark, f"{out}/results").drop("wave_done")
    return streaming.current_rows(m.specimens.select("specimen_id"), results, "specimen_id").fillna("~")


@query(
    "commit_tables",
    """SELECT 'patient' AS level, patient_id AS id FROM patients UNION ALL SELECT 'patient', 'new-' || r_name FROM region
       UNION ALL SELECT 'specimen', specimen_id FROM specimens UNION ALL SELECT 'specimen', 'of-' || r_name FROM region
       UNION ALL SELECT 'assay', assay_id FROM assays
       UNION ALL SELECT 'refused', 'of-' || r_name FROM region""",
)
def _(m: Model) -> DataFrame:
    """Specimens without their patients are refused as a whole; with them, both tables are published."""
    spark, root = m.spark, fresh_path(m.spark, "versions")
    names = ["patient", "specimen", "assay"]
    tables = {n: t.select(f"{n}_id", *([f"{p}_id"] if p else [])) for n, p, t in zip(names, [None, "patient", "specimen"], m.levels, strict=True)}
    audits = {"orphans": validate.fk_orphans}
    versions.commit_tables(spark, root, tables, audits)
    region = m.raw("region")
    people = region.select(F.concat(F.lit("new-"), "r_name").alias("patient_id"))
    taken = region.select(F.concat(F.lit("of-"), "r_name").alias("specimen_id"), F.concat(F.lit("new-"), "r_name").alias("patient_id"))
    more = {"patient": tables["patient"].unionByName(people), "specimen": tables["specimen"].unionByName(taken)}
    refused = versions.commit_tables(spark, root, {"specimen": more["specimen"]}, audits)
    versions.commit_tables(spark, root, more, audits)
    rows = [t.select(F.lit(n).alias("level"), F.col(f"{n}_id").alias("id")) for n, t in versions.read_tables(spark, root).items()]
    bad = refused["rejects"]["orphans"]
    rows.append(bad.select(F.lit("refused").alias("level"), F.col("key").alias("id")))
    return reduce(DataFrame.unionByName, rows)


@query(
    "joined_colocated",
    """SELECT a.assay_id, a.specimen_id, s.patient_id, p.cohort, s.tissue_site, a.assay_type
       FROM assays a JOIN specimens s ON s.specimen_id = a.specimen_id JOIN patients p ON p.patient_id = s.patient_id""",
)
def _(m: Model) -> DataFrame:
    """The levels laid out by place, large patients in parts, and joined without an exchange."""
    path = fresh_path(m.spark, "levels")
    name = "levels_" + path.rsplit("-", 1)[1]
    colocated.write_colocated(*m.levels, path, name, buckets=16, per_place=40, counted=m.assay_rows.select("specimen_id"))
    levels = colocated.read_colocated(m.spark, name)
    return colocated.joined_colocated(levels).select("assay_id", "specimen_id", "patient_id", "cohort", "tissue_site", "assay_type")

"""Artifact, reference, lineage and derivation graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import format_node
from cohort_ledger.operators import artifacts as art
from cohort_ledger.operators import closure, graph
from cohort_ledger.plans.dataset import AS_OF, Model
from cohort_ledger.plans.registry import query
from cohort_ledger.session import cut


def _direct(m: Model) -> DataFrame:
    return graph.direct_staleness(
        m.cohort_artifacts, m.cohort_artifact_inputs, *m.input_levels, m.reference_usage, m.reference_artifacts
    )


def _edges(m: Model) -> DataFrame:
    return graph.combined_edges(m.artifact_derivation, m.reference_usage, m.cohort_artifacts)


@query(
    "append_artifacts",
    """SELECT analysis, run_tag, 'stored' AS outcome FROM artifacts
       UNION ALL SELECT 'panel', source, 'stored' FROM documents GROUP BY source HAVING count(*) = 1
       UNION ALL SELECT 'panel', source, 'repeated_in_batch' FROM documents
                 WHERE source IN (SELECT source FROM documents GROUP BY source HAVING count(*) > 1)
       UNION ALL SELECT analysis, run_tag, 'already_exists' FROM artifacts WHERE region_scope = 'PROMO'""",
)
def _(m: Model) -> DataFrame:
    again = m.cohort_artifacts.filter("region_scope = 'PROMO'")
    fresh = m.raw("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("artifact_id"),
        F.lit("panel").alias("analysis"),
        F.col("source").alias("run_tag"),
        "lang",
    ).withColumnRenamed("lang", "region_scope")
    stored, rejects = art.append_artifacts(m.cohort_artifacts, again.unionByName(fresh))
    return stored.select("analysis", "run_tag", F.lit("stored").alias("outcome")).unionByName(
        rejects.select("analysis", "run_tag", F.col("reject").alias("outcome"))
    )


@query(
    "link_inputs",
    """SELECT artifact_id, assay_id, CASE WHEN max(stored) = 1 THEN max(CASE WHEN stored = 1 THEN role END)
                                         ELSE min(role) END AS role
       FROM (SELECT artifact_id, assay_id, 'tumor' AS role, 1 AS stored FROM artifact_inputs
             UNION ALL SELECT part_id, assay_id, CASE WHEN line = 2 THEN 'normal' ELSE 'other' END, 0
             FROM assay_rows WHERE line <= 2 AND part_id IN (SELECT artifact_id FROM artifacts)) GROUP BY artifact_id, assay_id""",
)
def _(m: Model) -> DataFrame:
    line = F.split_part("assay_id", F.lit("-"), F.lit(2)).cast("int")
    pairs = m.assay_rows.filter(line <= 2).select(
        F.split_part("assay_id", F.lit("-"), F.lit(3)).alias("artifact_id"),
        "assay_id",
        F.when(line == 2, "normal").otherwise("other").alias("role"),
    )
    base = m.cohort_artifact_inputs.withColumn("role", F.lit("tumor"))
    return art.link_inputs(base, pairs, m.cohort_artifacts, m.assay_rows)["inputs"]


@query(
    "input_staleness",
    """SELECT a.artifact_id, a.analysis, a.run_tag, coalesce(i.n, 0) AS n_censored_inputs, coalesce(i.n, 0) > 0 AS stale
       FROM artifacts a LEFT JOIN (SELECT artifact_id, count(*) AS n FROM bad_inputs GROUP BY 1) i
         ON i.artifact_id = a.artifact_id""",
)
def _(m: Model) -> DataFrame:
    return art.input_staleness(m.cohort_artifacts, m.cohort_artifact_inputs, *m.input_levels).drop("region_scope")


@query("censored_inputs", "SELECT artifact_id, assay_id FROM bad_inputs")
def _(m: Model) -> DataFrame:
    return art.censored_inputs(m.cohort_artifact_inputs, *m.input_levels).select("artifact_id", "assay_id")


@query("artifact_inputs_listing", "SELECT artifact_id, assay_id FROM artifact_inputs")
def _(m: Model) -> DataFrame:
    return art.artifact_inputs_listing(m.cohort_artifact_inputs)


@query(
    "list_artifacts",
    """SELECT a.artifact_id, a.analysis, a.run_tag, count(*) AS n_censored_inputs
       FROM artifacts a JOIN bad_inputs i ON i.artifact_id = a.artifact_id
       WHERE a.region_scope = 'ECONOMY' GROUP BY ALL""",
)
def _(m: Model) -> DataFrame:
    table = art.input_staleness(m.cohort_artifacts, m.cohort_artifact_inputs, *m.input_levels)
    return art.list_artifacts(table, "ECONOMY", stale_only=True).select(
        "artifact_id", "analysis", "run_tag", "n_censored_inputs"
    )


def _declared(m: Model) -> DataFrame:
    """Declarations: most references again, one region at a new version, one added."""
    known = m.raw("nation").filter("n_nationkey <> 7").select(
        F.col("n_name").alias("ref_key"),
        F.when(F.col("n_regionkey") == 2, "v9")
        .otherwise(F.concat(F.lit("v"), F.col("n_regionkey").cast("string")))
        .alias("version"),
    )
    added = m.raw("region").select(F.col("r_name").alias("ref_key"), F.lit("v1").alias("version"))
    return known.unionByName(added)


@query(
    "sync_references",
    """SELECT n_name AS ref_key, CASE WHEN n_regionkey = 2 AND n_nationkey <> 7 THEN 'v9' ELSE 'v' || n_regionkey END AS version,
              n_regionkey = 2 AND n_nationkey <> 7 AS touched FROM nation
       UNION ALL SELECT r_name, 'v1', TRUE FROM region""",
)
def _(m: Model) -> DataFrame:
    table, _changes = art.sync_references(m.reference_artifacts, _declared(m), AS_OF)
    return table.select("ref_key", "version", F.col("updated_at").isNotNull().alias("touched"))


@query(
    "sync_references_changes",
    """SELECT n_name AS ref_key, 'v2' AS old_version, 'v9' AS new_version FROM nation
       WHERE n_regionkey = 2 AND n_nationkey <> 7""",
)
def _(m: Model) -> DataFrame:
    return art.sync_references(m.reference_artifacts, _declared(m), AS_OF)[1]


@query(
    "declared_reference_edges",
    """SELECT 'reference:' || n_name AS down_node, 'reference:' || r_name AS up_node
       FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def _(m: Model) -> DataFrame:
    rows = m.raw("nation").join(m.raw("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("ref_key"),
        F.array(F.concat(F.lit("reference:"), "r_name"), F.lit("broken"), F.concat(F.lit("reference:"), "n_name")).alias("derived_from"),
    )
    return art.declared_reference_edges(rows, m.reference_artifacts)["edges"]


@query(
    "record_usage",
    """SELECT artifact_id, ref_key, CASE WHEN version_used = 'v_old' THEN 'v_new' ELSE version_used END AS version_used
       FROM usage
       UNION ALL SELECT artifact_id, 'EXTRA', 'v_new' FROM usage WHERE version_used = 'v_old'""",
)
def _(m: Model) -> DataFrame:
    old = m.reference_usage.filter("version_used = 'v_old'")
    rows = old.withColumn("version_used", F.lit("v_new"))
    rows = rows.unionByName(rows.withColumn("ref_key", F.lit("EXTRA"))).unionByName(rows)
    return art.record_usage(m.reference_usage, rows).select("artifact_id", "ref_key", "version_used")


@query(
    "output_staleness",
    """SELECT a.artifact_id, CASE WHEN u.artifact_id IS NULL THEN 'untracked' WHEN u.is_stale THEN 'STALE' ELSE 'fresh' END AS state,
              CASE WHEN u.artifact_id IS NULL OR NOT u.is_stale THEN ''
                   WHEN u.current_version IS NULL THEN 'reference removed: ' || u.ref_key
                   ELSE u.ref_key || ': ' || u.version_used || ' -> ' || u.current_version END AS reasons
       FROM artifacts a LEFT JOIN usage_now u ON u.artifact_id = a.artifact_id AND u.version_used <> 'v0'""",
)
def _(m: Model) -> DataFrame:
    outputs = m.cohort_artifacts.select(F.lit("cohort").alias("scope"), "artifact_id")
    untracked = F.col("version_used") == "v0"
    other = F.when(untracked, F.concat(F.lit("other-"), "artifact_id")).otherwise(F.col("artifact_id"))
    usage = m.reference_usage.withColumn("artifact_id", other)
    out = art.output_staleness(outputs, usage, m.reference_artifacts)
    return out.select("artifact_id", "state", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "all_stale_outputs",
    """SELECT artifact_id, 'STALE' AS state,
              CASE WHEN current_version IS NULL THEN 'reference removed: ' || ref_key
                   ELSE ref_key || ': ' || version_used || ' -> ' || current_version END AS reasons
       FROM usage_now WHERE is_stale""",
)
def _(m: Model) -> DataFrame:
    out = art.all_stale_outputs(m.reference_usage, m.reference_artifacts, stale_only=True)
    return out.select("artifact_id", "state", F.array_join("reasons", "; ").alias("reasons"))


NODE_TEXT_SQL = """
    texts AS (
      SELECT node FROM artifacts UNION ALL SELECT 'reference:' || ref_key FROM refs
      UNION ALL SELECT 'analysis:assay/' || assay_id || '/' || assay_type FROM assay_rows
      UNION ALL SELECT 'cohort:' || o_orderpriority || '@' FROM orders
      UNION ALL SELECT 'analysis:specimen/ /' || o_orderstatus FROM orders
      UNION ALL SELECT o_orderpriority FROM orders)
"""


@query(
    "parse_nodes",
    "WITH " + NODE_TEXT_SQL + """
       SELECT node, CASE WHEN node LIKE 'cohort:%@' OR node LIKE 'analysis:specimen/ /%' OR node NOT LIKE '%:%' THEN 'malformed'
                         ELSE split_part(node, ':', 1) END AS scope,
              CASE WHEN node LIKE 'analysis:assay/%' THEN split_part(node, '/', 2) ELSE '' END AS entity_id
       FROM texts""",
)
def _(m: Model) -> DataFrame:
    orders = m.raw("orders")
    node = F.col("node")
    texts = (
        m.cohort_artifacts.select(F.concat(F.lit("cohort:"), "analysis", F.lit("@"), "run_tag").alias("node"))
        .unionByName(m.reference_artifacts.select(F.concat(F.lit("reference:"), "ref_key").alias("node")))
        .unionByName(m.assay_rows.select(F.concat(F.lit("analysis:assay/"), "assay_id", F.lit("/"), "assay_type").alias("node")))
        .unionByName(orders.select(F.concat(F.lit("cohort:"), "o_orderpriority", F.lit("@")).alias("node")))
        .unionByName(orders.select(F.concat(F.lit("analysis:specimen/ /"), "o_orderstatus").alias("node")))
        .unionByName(orders.select(F.col("o_orderpriority").alias("node")))
    )
    parsed = graph.nodes_table(texts)
    same = format_node(F.struct("scope", "analysis", "run_tag", "ref_key", "entity_level", "entity_id")).eqNullSafe(node)
    return parsed.filter(F.col("reject").isNotNull() | same).select(
        "node",
        F.coalesce("scope", "reject").alias("scope"),
        F.coalesce("entity_id", F.lit("")).alias("entity_id"),
    )


@query("combined_edges", "SELECT down_node, up_node FROM edges")
def _(m: Model) -> DataFrame:
    return _edges(m)


@query("neighbors", """
    SELECT down_node AS node, 'up' AS direction, up_node AS neighbor FROM derivation
    UNION ALL SELECT up_node, 'down', down_node FROM derivation""")
def _(m: Model) -> DataFrame:
    return graph.all_neighbors(m.artifact_derivation)


@query("reachability", """
    SELECT node, upstream FROM reach""")
def _(m: Model) -> DataFrame:
    nodes = m.cohort_artifacts.select(
        F.concat(F.lit("cohort:"), "analysis", F.lit("@"), "run_tag").alias("node")
    )
    return graph.reachability(_edges(m), nodes)


@query("direct_staleness", """
    SELECT node, CAST(stale_inputs AS BIGINT) AS stale_inputs, CAST(stale_refs AS BIGINT) AS stale_refs,
           stale_inputs > 0 OR stale_refs > 0 AS directly_stale FROM direct""")
def _(m: Model) -> DataFrame:
    return _direct(m)


@query("direct_causes", """
    SELECT a.node, 'input_censored' AS cause, i.assay_id AS detail
    FROM bad_inputs i JOIN artifacts a ON a.artifact_id = i.artifact_id
    UNION ALL SELECT a.node, 'reference', CASE WHEN current_version IS NULL THEN 'reference removed: ' || ref_key
                   ELSE ref_key || ': ' || version_used || ' -> ' || current_version END
    FROM usage_now u JOIN artifacts a ON a.artifact_id = u.artifact_id WHERE u.is_stale""")
def _(m: Model) -> DataFrame:
    return graph.direct_causes(
        m.cohort_artifacts, m.cohort_artifact_inputs, *m.input_levels, m.reference_usage, m.reference_artifacts
    )


@query("derived_staleness", """
    SELECT r.node, r.upstream AS stale_upstream,
           'upstream ' || r.upstream || ' is STALE (' || concat_ws('; ',
             CASE WHEN d.stale_inputs > 0 THEN 'inputs censored: ' || d.stale_inputs END,
             CASE WHEN d.stale_refs > 0 THEN 'references stale: ' || d.stale_refs END) || ')' AS reason
    FROM reach r JOIN direct d ON d.node = r.upstream WHERE d.stale_inputs > 0 OR d.stale_refs > 0""")
def _(m: Model) -> DataFrame:
    return graph.derived_staleness(_edges(m), _direct(m))


@query("derived_staleness_inputs_only", """
    SELECT DISTINCT r.node FROM reach r JOIN direct d ON d.node = r.upstream
    JOIN derivation e ON e.down_node = r.node WHERE d.stale_inputs > 0""")
def _(m: Model) -> DataFrame:
    stale = _direct(m).filter("stale_inputs > 0")
    return graph.derived_stale_nodes(m.artifact_derivation, stale)


@query("derived_reasons", """
    SELECT r.node, r.upstream AS stale_upstream,
           'upstream ' || r.upstream || ' is STALE (' || concat_ws('; ',
             CASE WHEN d.stale_inputs > 0 THEN 'inputs censored: ' || d.stale_inputs END,
             CASE WHEN d.stale_refs > 0 THEN 'references stale: ' || d.stale_refs END) || ')' AS reason
    FROM reach r JOIN direct d ON d.node = r.upstream WHERE d.stale_inputs > 0 OR d.stale_refs > 0""")
def _(m: Model) -> DataFrame:
    direct = _direct(m)
    pairs = graph.derived_stale_pairs(_edges(m), direct.filter("directly_stale"))
    return graph.derived_reasons(pairs, direct)


RING_SQL = """
    ring AS (
      SELECT 'cohort:ring' || (p_partkey // 5) || '@r' || p_partkey AS down_node,
             'cohort:ring' || (p_partkey // 5) || '@r' || (CASE WHEN p_partkey = high THEN low ELSE p_partkey + 1 END) AS up_node,
             p_partkey // 5 AS grp, p_partkey = high AS last
      FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_partkey // 5) AS low,
                   max(p_partkey) OVER (PARTITION BY p_partkey // 5) AS high FROM part)),
    ringed AS (
      SELECT down_node, up_node FROM ring WHERE NOT (grp % 2 = 1 AND last)
      UNION ALL SELECT a.node, 'cohort:ring' || (CAST(a.artifact_id AS BIGINT) // 5) || '@r' || a.artifact_id FROM artifacts a)
"""


def _ringed(m: Model) -> DataFrame:
    """Rings of five parts (fewer at the end), every other one cut open, with nodes pointing in."""
    part = m.raw("part")
    group = F.expr("p_partkey div 5")

    def name(key):
        return F.concat(F.lit("cohort:ring"), group.cast("string"), F.lit("@r"), key.cast("string"))

    ends = part.groupBy(group.alias("ring")).agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    last = F.col("p_partkey") == F.col("high")
    onward = F.when(last, F.col("low")).otherwise(F.col("p_partkey") + 1)
    ring = part.join(ends, group == F.col("ring")).filter(~((group % 2 == 1) & last)).select(
        name(F.col("p_partkey")).alias("down_node"), name(onward).alias("up_node")
    )
    inward = part.select(
        F.concat(F.lit("cohort:"), "p_brand", F.lit("@r"), F.col("p_partkey").cast("string")).alias("down_node"),
        name(F.col("p_partkey")).alias("up_node"),
    )
    return ring.unionByName(inward)


@query("find_cycles", "WITH " + RING_SQL + """
    SELECT down_node, up_node FROM ring WHERE grp % 2 = 0""")
def _(m: Model) -> DataFrame:
    return graph.find_cycles(_ringed(m))


@query("add_edges", "WITH " + RING_SQL + """
    SELECT down_node, up_node FROM ringed WHERE (down_node, up_node) NOT IN (
      SELECT (down_node, up_node) FROM ring WHERE grp % 2 = 0)""")
def _(m: Model) -> DataFrame:
    return graph.add_edges(
        m.artifact_derivation, _ringed(m), m.reference_usage, m.cohort_artifacts
    )["added"]


LINKS_SQL = """
    links AS (
      SELECT source_assay_id, CASE WHEN line = 3 THEN 'nowhere' ELSE merged END AS merged_assay_id,
             CASE WHEN line IN (1, 4) THEN specimen_id END AS consumer_specimen_id
      FROM (SELECT a.assay_id AS source_assay_id, a.line, a.specimen_id, CASE WHEN a.line > 1 THEN f.m END AS merged
            FROM assay_rows a JOIN (SELECT specimen_id, min(assay_id) AS m FROM assay_rows GROUP BY specimen_id) f
              ON f.specimen_id = a.specimen_id))
"""


@query("link_sources", "WITH " + LINKS_SQL + """
    SELECT CASE WHEN merged_assay_id IS NOT NULL AND consumer_specimen_id IS NOT NULL THEN 'two_targets'
                WHEN merged_assay_id IS NULL AND consumer_specimen_id IS NULL THEN 'no_target'
                WHEN merged_assay_id = source_assay_id THEN 'self_edge'
                WHEN merged_assay_id = 'nowhere' THEN 'unknown_merged_assay'
                WHEN EXISTS (SELECT 1 FROM sources s WHERE s.source_assay_id = l.source_assay_id
                     AND s.merged_assay_id IS NOT DISTINCT FROM l.merged_assay_id
                     AND s.consumer_specimen_id IS NOT DISTINCT FROM l.consumer_specimen_id) THEN 'known'
                ELSE 'added' END AS outcome, count(*) AS n
    FROM links l GROUP BY 1""")
def _(m: Model) -> DataFrame:
    line = F.split_part("assay_id", F.lit("-"), F.lit(2)).cast("int")
    first = m.assay_rows.groupBy("specimen_id").agg(F.min("assay_id").alias("m"))
    rows = m.assay_rows.join(first, "specimen_id").select(
        F.col("assay_id").alias("source_assay_id"),
        F.when(line == 3, "nowhere").when(line > 1, F.col("m")).alias("merged_assay_id"),
        F.when(line.isin(1, 4), F.col("specimen_id")).alias("consumer_specimen_id"),
    )
    out = art.link_sources(m.assay_sources, rows, m.assay_rows, m.specimen_rows)
    added = out["added"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("added").alias("outcome"), "n")
    known = out["n_valid"].select(F.lit("known").alias("outcome"), F.col("n_valid").alias("n")).unionByName(
        added.select(F.lit("known").alias("outcome"), (-F.col("n")).alias("n"))
    ).groupBy("outcome").agg(F.sum("n").alias("n"))
    rejected = out["rejects"].groupBy(F.col("reject").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return added.unionByName(known).unionByName(rejected)


@query("upsert_batches", """
    SELECT CAST(s_suppkey AS VARCHAR) AS batch_id, CASE WHEN s_acctbal < 3000 THEN 'second' ELSE s_name END AS operator FROM supplier
    UNION ALL SELECT 'new-' || r_name, 'second' FROM region""")
def _(m: Model) -> DataFrame:
    again = m.raw("supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").cast("string").alias("batch_id"))
    fresh = m.raw("region").select(F.concat(F.lit("new-"), "r_name").alias("batch_id"))
    keys = again.unionByName(fresh)
    rows = keys.select("batch_id", F.lit("first").alias("operator"), F.lit(1).alias("n")).unionByName(
        keys.select("batch_id", F.lit("second").alias("operator"), F.lit(2).alias("n"))
    )
    return art.upsert_batches(m.batches, rows, "n")


def _some(edges: DataFrame, new: bool) -> DataFrame:
    """One edge in a hundred by a hash as the new ones, the rest as those there were."""
    turn = F.pmod(F.xxhash64("down_node", "up_node"), F.lit(100)) == 0
    return edges.filter(turn if new else ~turn)


@query("reachability_after", "SELECT node, upstream FROM reach")
def _(m: Model) -> DataFrame:
    """The stored closure without one edge in a hundred and without the last nodes, brought up to date."""
    nodes = m.cohort_artifacts.select(F.concat(F.lit("cohort:"), "analysis", F.lit("@"), "run_tag").alias("node"), "artifact_id")
    late = F.col("artifact_id").cast("bigint") % 50 == 7
    old_nodes, new_nodes = nodes.filter(~late).select("node"), nodes.filter(late).select("node")
    edges = cut(_edges(m))
    old, new = _some(edges, False), _some(edges, True)
    reach = cut(graph.reachability(old, old_nodes))
    return closure.reachability_after(reach, old, old_nodes, new, new_nodes)


@query("derived_staleness_after", "SELECT node FROM stale_nodes")
def _(m: Model) -> DataFrame:
    """The nodes of derived_staleness, with new edges and nodes that have just become stale."""
    edges, stale = cut(_edges(m)), cut(_direct(m).filter("directly_stale").select("node"))
    late = F.pmod(F.xxhash64("node"), F.lit(20)) == 0
    old, new = _some(edges, False), _some(edges, True)
    derived = cut(graph.derived_stale_nodes(old, stale.filter(~late)))
    return closure.derived_stale_after(derived, old, stale.filter(~late), new, stale.filter(late))


@query(
    "is_above",
    """WITH numbered AS (SELECT node, CAST(artifact_id AS BIGINT) AS n FROM artifacts),
       pairs AS (SELECT a.node, b.node AS other FROM numbered a JOIN numbered b ON b.n = a.n // 2 OR b.n = a.n // 8 OR b.n = a.n // 8 + 1 OR b.n = a.n + 1)
       SELECT p.node, p.other, r.node IS NOT NULL AS above FROM pairs p LEFT JOIN reach r ON r.node = p.node AND r.upstream = p.other""",
)
def _(m: Model) -> DataFrame:
    """Every artifact with its parent's number, its third ancestor's, the one beside that, and the next one."""
    numbered = m.cohort_artifacts.select(
        F.concat(F.lit("cohort:"), "analysis", F.lit("@"), "run_tag").alias("node"), F.col("artifact_id").cast("bigint").alias("n")
    )
    wanted = F.array_distinct(F.array(F.expr("n div 2"), F.expr("n div 8"), F.expr("n div 8 + 1"), F.expr("n + 1")))
    asked = numbered.select("node", F.explode(wanted).alias("w"))
    pairs = asked.join(numbered.select(F.col("node").alias("other"), "n"), F.col("w") == F.col("n")).select("node", "other")
    edges = cut(_edges(m))
    return closure.is_above(pairs, edges, closure.interval_index(edges))


@query(
    "link_inputs_rejects",
    """SELECT artifact_id, assay_id, reject FROM (
         SELECT part_id AS artifact_id, CASE WHEN line = 1 THEN 'absent-' || assay_id ELSE assay_id END AS assay_id, line FROM assay_rows WHERE line <= 3) x
       JOIN (VALUES (1, 'unknown_assay'), (2, 'unknown_artifact')) r(line, reject) ON r.line = x.line""",
)
def _(m: Model) -> DataFrame:
    """Inputs whose assay (first lines) or artifact (second lines) is not there; third lines are good."""
    line = F.split_part("assay_id", F.lit("-"), F.lit(2)).cast("int")
    part = F.split_part("assay_id", F.lit("-"), F.lit(3))
    pairs = m.assay_rows.filter(line <= 3).select(
        F.when(line == 2, F.concat(F.lit("absent-"), part)).otherwise(part).alias("artifact_id"),
        F.when(line == 1, F.concat(F.lit("absent-"), "assay_id")).otherwise(F.col("assay_id")).alias("assay_id"),
        F.lit("tumor").alias("role"),
    )
    refused = art.link_inputs(m.cohort_artifact_inputs, pairs, m.cohort_artifacts, m.assay_rows)["rejects"]
    return refused.select(F.regexp_replace("artifact_id", "^absent-", "").alias("artifact_id"), "assay_id", "reject")


@query("neighbors_of_busiest", """
    WITH busiest AS (SELECT up_node AS node FROM derivation GROUP BY up_node ORDER BY count(*) DESC, up_node LIMIT 1)
    SELECT 'up' AS direction, up_node AS node FROM derivation WHERE down_node = (SELECT node FROM busiest)
    UNION ALL SELECT 'down', down_node FROM derivation WHERE up_node = (SELECT node FROM busiest)""")
def _(m: Model) -> DataFrame:
    """One hop around the artifact from which most are derived."""
    n = F.count(F.lit(1)).alias("n")
    busiest = m.artifact_derivation.groupBy("up_node").agg(n).orderBy(F.desc("n"), "up_node").first()
    return graph.neighbors(m.artifact_derivation, busiest.up_node if busiest else "")

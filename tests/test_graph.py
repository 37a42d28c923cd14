"""Derivation graph shapes, and agreement with a brute-force walk."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import format_node, parse_node
from cohort_ledger.operators import artifacts as art
from cohort_ledger.operators import graph


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "down_node string, up_node string")


def closure(pairs):
    ups = {}
    for d, u in pairs:
        ups.setdefault(d, set()).add(u)
    out = {}
    for start in ups:
        seen, stack = set(), list(ups[start])
        while stack:
            cur = stack.pop()
            if cur not in seen:
                seen.add(cur)
                stack.extend(ups.get(cur, ()))
        out[start] = seen
    return out


def stale_by_walk(pairs, stale):
    return {n for n, ups in closure(pairs).items() if ups & set(stale)}


def cyclic_by_walk(pairs):
    reach = closure(pairs)
    return {(d, u) for d, u in pairs if d == u or d in reach.get(u, ())}


@pytest.mark.parametrize(
    "pairs, stale",
    [
        ([("b", "a"), ("c", "b")], ["a"]),
        ([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], ["a"]),
        ([("a", "b"), ("b", "a"), ("c", "b")], ["a"]),
        ([("b", "a")], []),
        ([("b", "a"), ("d", "c")], ["b", "d"]),
        ([(f"n{i + 1:02d}", f"n{i:02d}") for i in range(30)], ["n00"]),
    ],
)
def test_shapes(spark, rows, pairs, stale):
    frame = edges_of(spark, *pairs)
    seeds = spark.createDataFrame([(s,) for s in stale], "node string")
    assert {r[0] for r in rows(graph.derived_stale_nodes(frame, seeds))} == stale_by_walk(pairs, stale)
    expected = {(n, u) for n, ups in closure(pairs).items() for u in ups if u in stale}
    assert set(rows(graph.derived_stale_pairs(frame, seeds))) == expected


def test_derived_staleness_names_each_stale_upstream(spark, rows):
    pairs = [("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("x", "y"), ("y", "x"), ("z", "q")]
    causes = {"a": (2, 0), "c": (1, 3), "d": (1, 0), "x": (0, 1), "q": (0, 0), "b": (0, 0)}
    direct = spark.createDataFrame(
        [(n, i, r, i + r > 0) for n, (i, r) in causes.items()], "node string, stale_inputs long, stale_refs long, directly_stale boolean"
    )
    text = {"a": "inputs censored: 2", "c": "inputs censored: 1; references stale: 3", "d": "inputs censored: 1", "x": "references stale: 1"}
    expected = {(n, u, f"upstream {u} is STALE ({text[u]})") for n, ups in closure(pairs).items() for u in ups if u in text}
    found = graph.derived_staleness(edges_of(spark, *pairs), direct)
    assert found.columns == ["node", "stale_upstream", "reason"]
    assert len(rows(found)) == len(expected) and set(rows(found)) == expected


def test_derived_staleness_query_keeps_the_pairs(spark):
    from cohort_ledger.plans import registry

    registry.load()
    found = registry.run("derived_staleness", spark, "/root/testdata/sf0.001")
    assert found.columns == ["node", "stale_upstream", "reason"]
    assert found.groupBy("node").count().filter("count > 1").count()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_cycles_and_reachability_agree_with_a_walk(spark, rows, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(16)})
    frame = edges_of(spark, *pairs)
    assert set(rows(graph.find_cycles(frame))) == cyclic_by_walk(pairs)
    nodes = spark.createDataFrame([(n,) for n in names[:4]], "node string")
    expected = {(n, u) for n, ups in closure(pairs).items() if n in names[:4] for u in ups}
    assert set(rows(graph.reachability(frame, nodes))) == expected


def test_node_pointing_into_a_cycle_is_not_cyclic(spark, rows):
    frame = edges_of(spark, ("x", "a"), ("a", "b"), ("b", "a"), ("b", "y"), ("c", "d"), ("d", "c"), ("a", "c"))
    assert rows(graph.find_cycles(frame)) == [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")]


def test_parse_nodes(spark):
    good = ["cohort:joint@v1", "cohort:joint@v@2", "reference:hg38", "analysis:assay/A1/align"]
    bad = ["", "joint@v1", "cohort:joint", "cohort:@v1", "cohort:joint@", "reference:", "analysis:assay/A1",
           "analysis:assay/ /align", "analysis:assay/A1/align/x", "other:thing", None]
    frame = spark.createDataFrame([(n,) for n in good + bad], "node string")
    out = {r.node: r for r in graph.nodes_table(frame).collect()}
    assert [n for n in good if out[n].reject] == [] and [n for n in bad if not out[n].reject] == []
    assert out["cohort:joint@v@2"].run_tag == "v@2" and out["analysis:assay/A1/align"].entity_id == "A1"
    back = frame.select("node", format_node(parse_node(F.col("node"))).alias("again")).collect()
    assert all(r.again == r.node for r in back if r.node in good)


@pytest.fixture()
def small(spark):
    artifacts = spark.createDataFrame(
        [("1", "joint", "v1", "hg38"), ("2", "annot", "v1", None)],
        "artifact_id string, analysis string, run_tag string, region_scope string",
    )
    references = spark.createDataFrame([("hg38", "v1")], "ref_key string, version string")
    usage = spark.createDataFrame(
        [("cohort", None, None, "joint", "1", "hg38", "v0"), ("analysis", "assay", "A1", "align", None, "gone", "v1")],
        "scope string, entity_level string, entity_id string, analysis string, artifact_id string, "
        "ref_key string, version_used string",
    )
    return artifacts, references, usage


def test_add_edges_refuses_cycles_across_tables(spark, rows, small):
    artifacts, _references, usage = small
    new = edges_of(
        spark, ("cohort:annot@v1", "cohort:joint@v1"), ("reference:hg38", "cohort:joint@v1"),
        ("cohort:joint@v1", "cohort:joint@v1"), ("nonsense", "cohort:joint@v1"),
    )
    none = spark.createDataFrame([], "down_node string, up_node string")
    out = graph.add_edges(none, new, usage, artifacts)
    assert rows(out["added"]) == [("cohort:annot@v1", "cohort:joint@v1")]
    assert {r[2] for r in rows(out["rejects"])} == {"closes_cycle", "self_edge", "malformed"}
    again = graph.add_edges(out["derivation"], new, usage, artifacts)
    assert rows(again["added"]) == []


def test_reference_versions(spark, rows, small):
    artifacts, references, usage = small
    declared = spark.createDataFrame([("hg38", "v2"), ("t2t", "v1")], "ref_key string, version string")
    table, changes = art.sync_references(references, declared, "2024-01-01")
    assert rows(table, "ref_key", "version") == [("hg38", "v2"), ("t2t", "v1")]
    assert rows(changes) == [("hg38", "v1", "v2")]
    states = {(r.scope, r.state): r.reasons for r in art.all_stale_outputs(usage, references).collect()}
    assert states[("cohort", "STALE")] == ["hg38: v0 -> v1"]
    assert states[("analysis", "STALE")] == ["reference removed: gone"]
    unused = artifacts.select(F.lit("cohort").alias("scope"), "artifact_id")
    assert rows(art.output_staleness(unused, usage, references), "artifact_id", "state") == [
        ("1", "STALE"), ("2", "untracked")
    ]
    fresh = art.record_usage(usage, usage.filter("scope = 'cohort'").withColumn("version_used", F.lit("v1")))
    assert fresh.count() == 2 and not art.all_stale_outputs(fresh, references).filter(
        "scope = 'cohort' AND state = 'STALE'"
    ).count()


def test_artifacts_and_inputs(spark, rows, small):
    artifacts, _r, _u = small
    new = spark.createDataFrame(
        [("3", "joint", "v1", ["A1"]), ("4", "joint", "v2", ["A1", "A1"])],
        "artifact_id string, analysis string, run_tag string, inputs array<string>",
    )
    stored, rejects = art.append_artifacts(artifacts, new)
    assert rows(rejects, "artifact_id", "reject") == [("3", "already_exists")]
    assert stored.filter("artifact_id = '4'").first().n_inputs == 2
    assays = spark.createDataFrame([("A1",)], "assay_id string")
    pairs = spark.createDataFrame(
        [("1", "A1", "normal"), ("1", "A9", None), ("9", "A1", None)], "artifact_id string, assay_id string, role string"
    )
    base = spark.createDataFrame([("1", "A1", "tumor")], "artifact_id string, assay_id string, role string")
    out = art.link_inputs(base, pairs, artifacts, assays)
    assert rows(out["inputs"]) == [("1", "A1", "tumor")]
    assert {r[3] for r in rows(out["rejects"])} == {"unknown_assay", "unknown_artifact"}


def test_link_sources(spark, rows):
    assays = spark.createDataFrame([("A1",), ("A2",)], "assay_id string")
    specimens = spark.createDataFrame([("S1",)], "specimen_id string")
    text = "source_assay_id string, merged_assay_id string, consumer_specimen_id string"
    have = spark.createDataFrame([("A1", "A2", None)], text)
    new = spark.createDataFrame(
        [("A1", "A2", None), ("A1", None, "S1"), ("A1", None, "S1"), ("A1", "A1", None), ("A1", "A2", "S1"),
         ("A1", None, None), ("A9", "A2", None), ("A1", None, "S9"), ("A1", "A9", None)], text,
    )
    out = art.link_sources(have, new, assays, specimens)
    assert rows(out["added"]) == [("A1", None, "S1")] and out["n_valid"].first().n_valid == 3
    assert sorted(r[3] for r in rows(out["rejects"])) == [
        "no_target", "self_edge", "two_targets", "unknown_merged_assay", "unknown_source", "unknown_specimen"
    ]


def test_long_chains_and_rings_take_few_rounds(spark):
    n = 2000
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    ring = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)]
    theta = [("t0", "t1"), ("t1", "t2"), ("t2", "t0"), ("t1", "u"), ("u", "v"), ("v", "t0"), ("v", "out"), ("r0", "c5")]
    edges = spark.createDataFrame(chain + ring + theta, "down_node string, up_node string")
    got = {(r.down_node, r.up_node) for r in graph.find_cycles(edges).collect()}
    assert got == set(ring) | set(theta[:6])
    seed = spark.createDataFrame([("c1500",), ("t2",)], "node string")
    reached = {r.node for r in graph.derived_stale_nodes(edges, seed).collect()}
    want, frontier = set(), {"c1500", "t2"}
    down = {}
    for a, b in chain + ring + theta:
        down.setdefault(b, []).append(a)
    while frontier:
        frontier = {x for f in frontier for x in down.get(f, [])} - want
        want |= frontier
    assert reached == want


def test_the_seed_of_a_closure_is_worked_out_once(spark, rows):
    asked = spark.sparkContext.accumulator(0)

    def name(number):
        asked.add(1)
        return f"n{number}"

    seed = spark.range(0, 4, 1, 1).select(F.udf(name, "string")("id").alias("node"))
    steps = spark.range(12).select(F.concat(F.lit("n"), "id").alias("_from"), F.concat(F.lit("n"), F.col("id") * 2 + 1).alias("_to"))
    steps = steps.unionByName(spark.range(12).select(F.concat(F.lit("n"), "id").alias("_from"), F.concat(F.lit("n"), F.col("id") + 2).alias("_to")))
    found = rows(graph.fixpoint(seed, steps, hops=2))
    assert asked.value == 4
    reached, frontier = set(), set(range(4))
    while frontier:
        frontier = {y for x in frontier if x < 12 for y in (2 * x + 1, x + 2)} - reached
        reached |= frontier
    assert found == sorted((f"n{x}",) for x in reached)

"""Derivation graph: edges, reachability, staleness and cycles.

Every closure is a frontier fixpoint on DataFrames.  A round takes several hops
in one plan, drops what was seen before, and is written to the shared folder, so
lineage stays short, sizes are known and a lost executor costs one round.
Only whether the frontier is empty reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import (
    analysis_node,
    cohort_node,
    parse_node,
    reference_node,
)
from cohort_ledger.operators import artifacts as art
from cohort_ledger.session import cut

HOPS_PER_ROUND = 4
COMPACT_EVERY = 8


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _thin(steps: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Nodes with one step in and one step out, but for those in ``keep``."""
    once = lambda c: steps.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("node")
    thin = once("_from").join(once("_to"), "node", "left_semi")
    return cut(thin if keep is None else thin.join(keep, "node", "left_anti"))


def _chain_ends(steps: DataFrame, thin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, end)`` of each thin node: where its chain leaves the thin nodes; and the nodes of pure rings.

    Pointers double in each round, so a chain of n nodes takes log n rounds.
    A round settles some node of every chain that is still open; when none is
    settled, only rings are left.
    """
    here = thin.select(F.col("node").alias("_t"))
    pointers = cut(steps.join(here, F.col("_from") == F.col("_t"), "left_semi").select(F.col("_from").alias("node"), F.col("_to").alias("end")))
    still = None
    while True:
        open_ends = pointers.join(here, F.col("end") == F.col("_t"), "left_semi")
        left = open_ends.count()
        if left in (0, still):
            rings = open_ends.select("node")
            return pointers.join(rings, "node", "left_anti"), rings
        still = left
        further = pointers.select(F.col("node").alias("_t"), F.col("end").alias("_further"))
        pointers = cut(
            pointers.join(further, F.col("end") == F.col("_t"), "left").select("node", F.coalesce("_further", "end").alias("end"))
        )


def _reversed(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("_to").alias("_from"), F.col("_from").alias("_to"))


def fixpoint(
    seed: DataFrame, steps: DataFrame, key: str = "node", hops: int = HOPS_PER_ROUND
) -> DataFrame:
    """All rows reachable from ``seed`` in one or more steps.

    ``steps`` has columns ``(_from, _to)``.  Columns of ``seed`` other than
    ``key`` are carried along; a row is expanded once, so cycles end.  Chains
    without branches are walked as one step, and their nodes then get what
    the start of the chain has.
    """
    steps, seed = cut(steps.distinct()), cut(seed)  # both are read in several places
    keep = seed.select(F.col(key).alias("node")).distinct()
    thin = _thin(steps, keep)
    if thin.isEmpty():
        return walked(seed, steps, key, hops)
    starts, rings = _chain_ends(_reversed(steps), thin)
    inner = starts.select(F.col("node").alias("_inner"), F.col("end").alias("_start"))
    here = thin.select(F.col("node").alias("_t"))
    short = (
        steps.join(here, F.col("_to") == F.col("_t"), "left_anti")
        .join(inner, F.col("_from") == F.col("_inner"), "left")
        .select(F.coalesce("_start", "_from").alias("_from"), "_to")
    )
    found = cut(walked(seed, cut(short.distinct()), key, hops))
    ahead = found.unionByName(seed).distinct()
    within = ahead.join(inner, F.col(key) == F.col("_start")).select(
        *[F.col("_inner").alias(c) if c == key else F.col(c) for c in seed.columns]
    )
    return found.unionByName(within)


def walked(seed: DataFrame, steps: DataFrame, key: str, hops: int, seen: list[DataFrame] | None = None) -> DataFrame:
    """Rows that ``seed`` reaches and that are not in ``seen``: the rounds of ``fixpoint``.

    ``steps`` are distinct and written already.
    """
    columns = seed.columns
    carried = [c for c in columns if c != key]

    def hop(frontier: DataFrame) -> DataFrame:
        moved = frontier.withColumnRenamed(key, "_from").join(steps, "_from")
        return moved.select(F.col("_to").alias(key), *carried).distinct().select(*columns)

    before = list(seen or [])
    frontier = cut(seed.distinct())
    new: list[DataFrame] = []
    while True:
        layers, current = [], frontier
        for i in range(hops):
            current = hop(current)
            layers.append(current.withColumn("_hop", F.lit(i)))
        found = _union(layers).groupBy(*columns).agg(F.min("_hop").alias("_hop"))
        if before or new:  # once a round: what was seen before is read and dealt out once, not for every hop
            found = found.join(_union(before + new), columns, "left_anti")
        found = cut(found)
        frontier = found.filter(F.col("_hop") == hops - 1).select(*columns)
        new.append(found.select(*columns))
        if frontier.isEmpty():
            return _union(new)
        if len(new) >= COMPACT_EVERY:
            new = [cut(_union(new))]


def nodes_table(nodes: DataFrame, column: str = "node") -> DataFrame:
    """Node references split into parts; ``reject`` marks malformed ones.

    Each text is worked out and parsed once: filters on the parts are not moved before
    the row that ``explode`` makes of them.
    """
    parts = F.explode(F.array(parse_node(F.col(column)))).alias("_p")
    return nodes.select("*", parts).select(
        *nodes.columns,
        "_p.*",
        F.when(F.col("_p").isNull(), "malformed").alias("reject"),
    )


def _with_node(usage: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Usage rows with the node of their output; rows of unknown artifacts drop out.

    The scopes are handled apart, so the NULL artifact ids of analysis-scope
    rows never meet in one shuffle partition.
    """
    named = artifacts.select(
        "artifact_id", cohort_node(F.col("analysis"), F.col("run_tag")).alias("node")
    )
    cohort = usage.filter(F.col("scope") == "cohort").join(named, "artifact_id")
    own = analysis_node(F.col("entity_level"), F.col("entity_id"), F.col("analysis"))
    analysis = usage.filter(F.col("scope") == "analysis").withColumn("node", own)
    return cohort.unionByName(analysis.filter(F.col("node").isNotNull()))


def combined_edges(derivation: DataFrame, usage: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Recorded edges plus the consumer-to-reference edges implied by usage."""
    implied = _with_node(usage, artifacts).select(
        F.col("node").alias("down_node"), reference_node(F.col("ref_key")).alias("up_node")
    )
    return derivation.select("down_node", "up_node").unionByName(implied).distinct()


def neighbors(derivation: DataFrame, node: str) -> DataFrame:
    """One hop in both directions over the recorded edges."""
    up = derivation.filter(F.col("down_node") == node).select(
        F.lit("up").alias("direction"), F.col("up_node").alias("node")
    )
    down = derivation.filter(F.col("up_node") == node).select(
        F.lit("down").alias("direction"), F.col("down_node").alias("node")
    )
    return up.unionByName(down)


def all_neighbors(derivation: DataFrame) -> DataFrame:
    """One-hop neighbors of every node."""
    up = derivation.select(
        F.col("down_node").alias("node"), F.lit("up").alias("direction"),
        F.col("up_node").alias("neighbor"),
    )
    down = derivation.select(
        F.col("up_node").alias("node"), F.lit("down").alias("direction"),
        F.col("down_node").alias("neighbor"),
    )
    return up.unionByName(down)


def up_steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("down_node").alias("_from"), F.col("up_node").alias("_to"))


def down_steps(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("up_node").alias("_from"), F.col("down_node").alias("_to"))


def reachability(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upstreams at one or more hops of each given ``node``: ``(node, upstream)``."""
    seed = nodes.select(F.col("node").alias("upstream"), F.col("node"))
    return fixpoint(seed, up_steps(edges), key="upstream").select("node", "upstream")


def direct_staleness(
    artifacts: DataFrame,
    inputs: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    usage: DataFrame,
    references: DataFrame,
) -> DataFrame:
    """Each node's own causes: counts of inactive inputs and stale references."""
    cohort = artifacts.select(
        "artifact_id", cohort_node(F.col("analysis"), F.col("run_tag")).alias("node")
    )
    stale_inputs = (
        art.censored_inputs(inputs, patients, specimens, assays)
        .groupBy("artifact_id")
        .agg(F.count(F.lit(1)).alias("n_inputs"))
    )
    by_input = cohort.join(stale_inputs, "artifact_id", "left").select(
        "node",
        F.coalesce("n_inputs", F.lit(0)).cast("bigint").alias("stale_inputs"),
        F.lit(0).cast("bigint").alias("stale_refs"),
    )
    flagged = art.usage_with_current(usage, references)
    by_ref = _with_node(flagged, artifacts).select(
        "node",
        F.lit(0).cast("bigint").alias("stale_inputs"),
        F.col("is_stale").cast("bigint").alias("stale_refs"),
    )
    refs = references.select(
        reference_node(F.col("ref_key")).alias("node"),
        F.lit(0).cast("bigint").alias("stale_inputs"),
        F.lit(0).cast("bigint").alias("stale_refs"),
    )
    return (
        by_input.unionByName(by_ref)
        .unionByName(refs)
        .groupBy("node")
        .agg(F.sum("stale_inputs").alias("stale_inputs"), F.sum("stale_refs").alias("stale_refs"))
        .withColumn("directly_stale", (F.col("stale_inputs") > 0) | (F.col("stale_refs") > 0))
    )


def direct_causes(
    artifacts: DataFrame,
    inputs: DataFrame,
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    usage: DataFrame,
    references: DataFrame,
) -> DataFrame:
    """Each own cause of a node as one row ``(node, cause, detail)``."""
    named = artifacts.select(
        "artifact_id", cohort_node(F.col("analysis"), F.col("run_tag")).alias("node")
    )
    censored = (
        art.censored_inputs(inputs, patients, specimens, assays)
        .join(named, "artifact_id")
        .select("node", F.lit("input_censored").alias("cause"), F.col("assay_id").alias("detail"))
    )
    flagged = art.usage_with_current(usage, references).filter("is_stale")
    stale_refs = _with_node(flagged, artifacts).select(
        "node", F.lit("reference").alias("cause"), art.usage_reason().alias("detail")
    )
    return censored.unionByName(stale_refs)


def derived_stale_nodes(edges: DataFrame, stale: DataFrame) -> DataFrame:
    """Nodes with a directly stale upstream, one row per node.

    Only the stale nodes seed the walk, which goes down the edges.  A node's own
    cause does not count unless it is its own upstream in a cycle.  This says only
    whether there is such an upstream; ``derived_staleness`` says which, and why.
    """
    return fixpoint(stale.select("node"), down_steps(edges))


def derived_stale_pairs(edges: DataFrame, stale: DataFrame) -> DataFrame:
    """``(node, stale_upstream)`` for every directly stale upstream of a node."""
    seed = stale.select(F.col("node"), F.col("node").alias("stale_upstream"))
    return fixpoint(seed, down_steps(edges))


def derived_reasons(pairs: DataFrame, direct: DataFrame) -> DataFrame:
    """Pairs with the upstream's causes spelled out, one row per reason."""
    causes = direct.select(F.col("node").alias("stale_upstream"), "stale_inputs", "stale_refs")
    text = F.concat(
        F.lit("upstream "),
        F.col("stale_upstream"),
        F.lit(" is STALE ("),
        F.concat_ws(
            "; ",
            F.when(
                F.col("stale_inputs") > 0,
                F.concat(F.lit("inputs censored: "), F.col("stale_inputs").cast("string")),
            ),
            F.when(
                F.col("stale_refs") > 0,
                F.concat(F.lit("references stale: "), F.col("stale_refs").cast("string")),
            ),
        ),
        F.lit(")"),
    )
    return pairs.join(causes, "stale_upstream").select("node", "stale_upstream", text.alias("reason"))


def derived_staleness(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Derived-stale nodes as ``(node, stale_upstream, reason)``, a row for each stale upstream.

    The directly stale nodes of ``direct``, which is written once, seed the walk;
    each pair of a node and a stale upstream is carried down to the fixpoint and
    gets the upstream's causes.
    """
    direct = cut(direct)
    return derived_reasons(derived_stale_pairs(edges, direct.filter("directly_stale")), direct)


def _trim(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop edges that cannot lie on a cycle until none can be dropped."""
    current = cut(edges.filter(F.col("down_node") != F.col("up_node")).distinct())
    size = current.count()
    while size:
        trimmed = current
        for _ in range(rounds):
            ups = trimmed.select(F.col("up_node").alias("down_node")).distinct()
            trimmed = trimmed.join(ups, "down_node", "left_semi")
            downs = trimmed.select(F.col("down_node").alias("up_node")).distinct()
            trimmed = trimmed.join(downs, "up_node", "left_semi")
        current = cut(trimmed.select("down_node", "up_node"))
        left = current.count()
        if left == size:
            break
        size = left
    return current


def _smallest_ancestor(edges: DataFrame, steps: int = 1) -> DataFrame:
    """Per node the smallest node that reaches it along ``down -> up``, itself included."""
    nodes = edges.select(F.col("down_node").alias("node")).unionByName(
        edges.select(F.col("up_node").alias("node"))
    )
    colors = cut(nodes.distinct().withColumn("color", F.col("node")))
    while True:
        merged = colors.withColumn("_old", F.col("color"))
        for _ in range(steps):
            pushed = edges.join(
                merged.select(F.col("node").alias("down_node"), "color"), "down_node"
            ).select(F.col("up_node").alias("node"), "color")
            merged = (
                merged.unionByName(pushed, allowMissingColumns=True)
                .groupBy("node")
                .agg(F.min("color").alias("color"), F.max("_old").alias("_old"))
            )
        merged = cut(merged)
        colors = merged.select("node", "color")
        if merged.filter(F.col("color") != F.col("_old")).isEmpty():
            return colors


def find_cycles(edges: DataFrame) -> DataFrame:
    """Every edge that lies on a cycle; empty for an acyclic graph.

    Chains without branches are taken as one edge, and rings without branches are
    cycles as they are.  Edges outside the cyclic core are trimmed.  The core is split into
    strongly connected components by colouring: a node's colour is the smallest
    node that reaches it, and the component of a colour's root is what reaches
    the root inside the colour.  Memory stays linear in the edges; no pairs of
    mutually reachable nodes are formed.
    """
    edges = cut(edges.select("down_node", "up_node").distinct())
    loops = edges.filter(F.col("down_node") == F.col("up_node"))
    steps = up_steps(edges.filter(F.col("down_node") != F.col("up_node")))
    thin = _thin(steps)
    if thin.isEmpty():
        return loops.unionByName(_core_cycles(edges))
    ends, rings = _chain_ends(steps, thin)
    starts, _ = _chain_ends(_reversed(steps), thin)
    tails = starts.select(F.col("node").alias("_a"), F.col("end").alias("_start"))
    heads = ends.select(F.col("node").alias("_b"), F.col("end").alias("_end"))
    on_ring = rings.select(F.col("node").alias("_r"))
    spans = cut(
        steps.join(on_ring, F.col("_from") == F.col("_r"), "left_anti")
        .join(tails, F.col("_from") == F.col("_a"), "left")
        .join(heads, F.col("_to") == F.col("_b"), "left")
        .select("_from", "_to", F.coalesce("_start", "_from").alias("_s"), F.coalesce("_end", "_to").alias("_e"))
    )
    short = spans.select(F.col("_s").alias("down_node"), F.col("_e").alias("up_node")).distinct()
    closed = _core_cycles(short).unionByName(short.filter(F.col("down_node") == F.col("up_node")))
    whole = closed.select(F.col("down_node").alias("_s"), F.col("up_node").alias("_e")).distinct()
    in_rings = steps.join(on_ring, F.col("_from") == F.col("_r"), "left_semi")
    found = spans.join(whole, ["_s", "_e"], "left_semi").select("_from", "_to").unionByName(in_rings)
    return loops.unionByName(found.select(F.col("_from").alias("down_node"), F.col("_to").alias("up_node")))


def _core_cycles(edges: DataFrame) -> DataFrame:
    """``find_cycles`` of edges between different nodes, without looking for chains."""
    cyclic = [edges.limit(0).select("down_node", "up_node")]
    core = _trim(edges)
    while not core.isEmpty():
        colors = _smallest_ancestor(core)
        colored = cut(
            core.join(
                colors.select(F.col("node").alias("down_node"), F.col("color").alias("_c1")),
                "down_node",
            )
            .join(
                colors.select(F.col("node").alias("up_node"), F.col("color").alias("_c2")),
                "up_node",
            )
            .filter(F.col("_c1") == F.col("_c2"))
            .select("down_node", "up_node", F.col("_c1").alias("color"))
        )
        roots = colors.filter(F.col("node") == F.col("color")).select("node")
        members = cut(roots.unionByName(fixpoint(roots, down_steps(colored))).distinct())
        cyclic.append(
            colored.join(members.withColumnRenamed("node", "down_node"), "down_node", "left_semi")
            .join(members.withColumnRenamed("node", "up_node"), "up_node", "left_semi")
            .select("down_node", "up_node")
        )
        rest = core.join(
            members.withColumnRenamed("node", "down_node"), "down_node", "left_anti"
        ).join(members.withColumnRenamed("node", "up_node"), "up_node", "left_anti")
        core = _trim(rest.select("down_node", "up_node"))
    return _union(cyclic).distinct()


def add_edges(
    derivation: DataFrame, edges: DataFrame, usage: DataFrame, artifacts: DataFrame
) -> dict[str, DataFrame]:
    """Add a batch of edges; malformed, self and cycle-closing ones are refused."""
    rows = edges.select("down_node", "up_node").distinct()
    bad_form = parse_node(F.col("down_node")).isNull() | parse_node(F.col("up_node")).isNull()
    checked = rows.withColumn(
        "reject",
        F.when(bad_form, "malformed").when(F.col("down_node") == F.col("up_node"), "self_edge"),
    )
    well_formed = checked.filter(F.col("reject").isNull()).drop("reject")
    fresh = well_formed.join(
        derivation.select("down_node", "up_node"), ["down_node", "up_node"], "left_anti"
    )
    whole = combined_edges(derivation.select("down_node", "up_node").unionByName(fresh), usage, artifacts)
    cyclic = find_cycles(whole)
    added = fresh.join(cyclic, ["down_node", "up_node"], "left_anti")
    refused = fresh.join(cyclic, ["down_node", "up_node"], "left_semi")
    return {
        "derivation": derivation.unionByName(added, allowMissingColumns=True),
        "added": added,
        "rejects": checked.filter(F.col("reject").isNotNull()).unionByName(
            refused.withColumn("reject", F.lit("closes_cycle"))
        ),
    }

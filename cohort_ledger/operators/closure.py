"""Kept closures that grow with their graph, and a reachability index.

``extended`` brings a stored closure up to date after edges and seeds were added:
only rows that the additions make are walked, so the rounds follow the depth of
what changed.  ``interval_index`` and ``is_above`` answer "is this node above
that one" for a table of pairs without any closure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohort_ledger.operators.graph import HOPS_PER_ROUND, down_steps, up_steps, walked
from cohort_ledger.session import cut

BUCKETS = 64  #: parts in which the children of one node are put in order


def extended(
    found: DataFrame, seed: DataFrame, steps: DataFrame, new_seed: DataFrame, new_steps: DataFrame,
    key: str = "node", hops: int = HOPS_PER_ROUND,
) -> DataFrame:
    """The closure of all seeds along all steps, from ``found``, that of ``seed`` along ``steps``.

    Semi-naive: rows that a new step makes of what is there and rows that any step
    makes of new seeds are the first frontier; what was found before is never
    walked again.  Only additions are covered; after a removal the closure is
    worked out anew.
    """
    columns = found.columns
    every = cut(steps.unionByName(new_steps).distinct())

    def moved(rows: DataFrame, along: DataFrame) -> DataFrame:
        carried = [F.col(c) for c in columns if c != key]
        return rows.join(along, F.col(key) == F.col("_from")).select(F.col("_to").alias(key), *carried).select(*columns)

    there = found.unionByName(seed.select(*columns))
    first = moved(there, new_steps).unionByName(moved(new_seed.select(*columns), every)).distinct()
    first = cut(first.join(found, columns, "left_anti"))
    if first.isEmpty():
        return found
    more = walked(first, every, key, hops, [found, first])
    return found.unionByName(first).unionByName(more)


def reachability_after(reach: DataFrame, edges: DataFrame, nodes: DataFrame, new_edges: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """``reachability`` of all nodes over all edges, from that of ``nodes`` over ``edges``."""
    seeds = [n.select(F.col("node").alias("upstream"), F.col("node")) for n in (nodes, new_nodes)]
    grown = extended(reach.select("upstream", "node"), seeds[0], up_steps(edges), seeds[1], up_steps(new_edges), "upstream")
    return grown.select("node", "upstream")


def derived_stale_after(derived: DataFrame, edges: DataFrame, stale: DataFrame, new_edges: DataFrame, new_stale: DataFrame) -> DataFrame:
    """``derived_stale_nodes`` after edges were added and nodes became stale."""
    return extended(derived.select("node"), stale.select("node"), down_steps(edges), new_stale.select("node"), down_steps(new_edges))


# A reachability index


def _doubled(pointers: DataFrame, up: bool) -> DataFrame:
    """``sum`` over the ancestors (``up``) or descendants of each node in a forest of ``(node, parent, sum)``.

    The pointers double: after round i a sum covers what is less than 2^i away,
    so the rounds follow the logarithm of the depth.  Nodes on or below a cycle
    never reach a root and are left out.
    """
    current = cut(pointers.select("node", F.col("parent").alias("at"), "sum"))
    still = None
    while True:
        n_open = current.filter(F.col("at").isNotNull()).count()
        if n_open in (0, still):
            return current.filter(F.col("at").isNull()).select("node", "sum")
        still = n_open
        ahead = current.select(F.col("node").alias("_n"), F.col("at").alias("_next"), F.col("sum").alias("_more"))
        jumped = current.join(ahead, F.col("at") == F.col("_n"), "left")
        if up:
            current = cut(jumped.select("node", F.col("_next").alias("at"), (F.col("sum") + F.coalesce("_more", F.lit(0))).alias("sum")))
            continue
        below = current.filter(F.col("at").isNotNull()).groupBy(F.col("at").alias("_of")).agg(F.sum("sum").alias("_below"))
        current = cut(
            jumped.join(below, F.col("node") == F.col("_of"), "left").select("node", F.col("_next").alias("at"), (F.col("sum") + F.coalesce("_below", F.lit(0))).alias("sum"))
        )


def _earlier_siblings(sized: DataFrame) -> DataFrame:
    """``(node, parent, offset)``: the sizes of the siblings before each node, in parts of a parent's children."""
    rows = sized.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(BUCKETS)))
    parts = rows.groupBy(F.col("parent").alias("_p"), F.col("_part").alias("_q")).agg(F.sum("size").alias("_size"))
    earlier = W.partitionBy("_p").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_p", "_q", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy("parent", "_part").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("parent").eqNullSafe(F.col("_p")) & (F.col("_part") == F.col("_q"))
    return placed.join(parts, same).select("node", "parent", (F.col("_before") + F.col("_within")).alias("offset"))


def interval_index(edges: DataFrame, hops: int = HOPS_PER_ROUND) -> DataFrame:
    """``(node, first, last, low, high)`` of every node of ``edges (down_node, up_node)``.

    Each node hangs on its smallest upstream; in that forest ``first`` to ``last``
    numbers the node and all below it, so containment proves a tree path.  ``low``
    and ``high`` bound a number over the node and everything above it in the whole
    graph: where they are not contained there is no path.  Nodes below a cycle
    have no ``first`` and are searched for.
    """
    edges = cut(edges.select("down_node", "up_node").filter(F.col("down_node") != F.col("up_node")).distinct())
    nodes = edges.select(F.col("down_node").alias("node")).union(edges.select("up_node")).distinct()
    parents = edges.groupBy(F.col("down_node").alias("_d")).agg(F.min("up_node").alias("parent"))
    forest = cut(nodes.join(parents, F.col("node") == F.col("_d"), "left").select("node", "parent"))
    sizes = _doubled(forest.withColumn("sum", F.lit(1).cast("long")), up=False).select(F.col("node").alias("_s"), F.col("sum").alias("size"))
    sized = cut(forest.join(sizes, F.col("node") == F.col("_s")).select("node", "parent", "size"))
    offsets = _earlier_siblings(sized).withColumn("sum", F.col("offset") + F.when(F.col("parent").isNull(), 0).otherwise(1))
    starts = _doubled(offsets, up=True).select(F.col("node").alias("_f"), F.col("sum").alias("first"))
    numbered = sized.join(starts, F.col("node") == F.col("_f"), "left").select(F.col("node").alias("_n"), "first", (F.col("first") + F.col("size") - 1).alias("last"))
    rows = nodes.join(numbered, F.col("node") == F.col("_n"), "left").select("node", "first", "last")
    return cut(_bounds(cut(rows), edges, hops))


def _bounds(rows: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Adds the bounds of a hash over each node and all above it, pushed down until nothing changes."""
    own = F.xxhash64("node")
    bounds = cut(rows.select("node", own.alias("low"), own.alias("high")))
    while True:
        merged = bounds
        for _ in range(hops):
            above = merged.select(F.col("node").alias("up_node"), "low", "high")
            pushed = edges.join(above, "up_node").select(F.col("down_node").alias("node"), "low", "high")
            merged = merged.unionByName(pushed).groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        merged = cut(merged)
        old = bounds.select(F.col("node").alias("_n"), F.col("low").alias("_low"), F.col("high").alias("_high"))
        changed = merged.join(old, F.col("node") == F.col("_n")).filter((F.col("low") != F.col("_low")) | (F.col("high") != F.col("_high")))
        bounds = merged
        if changed.isEmpty():
            return rows.join(bounds, "node")


def is_above(pairs: DataFrame, edges: DataFrame, index: DataFrame) -> DataFrame:
    """``pairs (node, other)`` with ``above``: whether ``other`` is above ``node`` by one or more edges.

    Intervals answer most pairs at once.  The others walk up, and a walker stops
    where its node's bounds do not hold those of the node it looks for.
    """
    asked = cut(pairs.select("node", "other").distinct())
    steps = cut(edges.select(F.col("down_node").alias("_down"), F.col("up_node").alias("_up")).distinct())
    goal = index.select(*[F.col(c).alias(f"_g_{c}") for c in index.columns])
    here = index.select(*[F.col(c).alias(f"_h_{c}") for c in index.columns])
    tree = F.coalesce((F.col("_g_first") <= F.col("_h_first")) & (F.col("_h_first") <= F.col("_g_last")), F.lit(False))
    hopeful = (F.col("_h_low") <= F.col("_g_low")) & (F.col("_h_high") >= F.col("_g_high"))

    def judged(walkers: DataFrame) -> DataFrame:
        """Walkers ``(node, other, at)`` that may get there, with ``_there``."""
        both = walkers.join(goal, F.col("other") == F.col("_g_node")).join(here, F.col("at") == F.col("_h_node")).filter(hopeful)
        there = (F.col("at") == F.col("other")) | (tree & (F.col("_h_node") != F.col("_g_node")))
        return both.select("node", "other", "at", there.alias("_there"))

    frontier = asked.join(steps, F.col("node") == F.col("_down")).select("node", "other", F.col("_up").alias("at"))
    frontier = cut(judged(frontier).distinct())
    seen, reached = frontier.select("node", "other", "at"), frontier.filter("_there").select("node", "other").distinct()
    while not frontier.isEmpty():
        walking = frontier.join(reached, ["node", "other"], "left_anti")
        onward = walking.join(steps, F.col("at") == F.col("_down")).select("node", "other", F.col("_up").alias("at")).distinct()
        frontier = cut(judged(onward.join(seen, ["node", "other", "at"], "left_anti")))
        seen = cut(seen.unionByName(frontier.select("node", "other", "at")))
        reached = cut(reached.unionByName(frontier.filter("_there").select("node", "other")).distinct())
    answered = reached.select(F.col("node").alias("_a"), F.col("other").alias("_b"), F.lit(True).alias("_yes"))
    return pairs.join(answered, (F.col("node") == F.col("_a")) & (F.col("other") == F.col("_b")), "left").select(*pairs.columns, F.coalesce("_yes", F.lit(False)).alias("above"))

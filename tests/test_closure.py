"""Kept closures that grow, and the reachability index, against a walk."""

import random

import pytest
from test_graph import closure as walked
from test_graph import edges_of, stale_by_walk

from cohort_ledger.operators import closure, graph


def names(spark, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def shape(kind, draw):
    nodes = [f"n{i:02d}" for i in range(24)]
    if kind == "dag":
        return nodes, sorted({tuple(sorted(draw.sample(nodes, 2), reverse=True)) for _ in range(34)})
    if kind == "chain":
        return nodes, [(nodes[i + 1], nodes[i]) for i in range(23)]
    return nodes, sorted({tuple(draw.sample(nodes, 2)) for _ in range(30)})  # with cycles


@pytest.mark.parametrize("kind, seed", [("dag", 1), ("chain", 2), ("any", 3)])
def test_grown_closures_equal_full_ones(spark, rows, kind, seed):
    draw = random.Random(seed)
    nodes, pairs = shape(kind, draw)
    new = draw.sample(pairs, 4)
    old = [p for p in pairs if p not in new]
    seeds = draw.sample(nodes, 9)
    before, after = seeds[:6], seeds[6:]
    frames = [edges_of(spark, *old), names(spark, before), edges_of(spark, *new), names(spark, after)]
    reach = graph.reachability(frames[0], frames[1])
    got = closure.reachability_after(reach, *frames)
    assert rows(got) == sorted((n, u) for n, ups in walked(pairs).items() if n in seeds for u in ups)
    derived = graph.derived_stale_nodes(frames[0], frames[1])
    assert {r[0] for r in rows(closure.derived_stale_after(derived, *frames))} == stale_by_walk(pairs, seeds)


def test_nothing_new(spark, rows):
    edges, none = edges_of(spark, ("b", "a"), ("c", "b")), edges_of(spark, ("x", "y")).limit(0)
    reach = graph.reachability(edges, names(spark, ["c"]))
    assert rows(closure.reachability_after(reach, edges, names(spark, ["c"]), none, names(spark, ["q"]))) == [("c", "a"), ("c", "b")]


@pytest.mark.parametrize("kind, seed", [("dag", 4), ("chain", 5), ("any", 6)])
def test_index_answers_pairs(spark, rows, kind, seed):
    draw = random.Random(seed)
    nodes, pairs = shape(kind, draw)
    asked = [(draw.choice(nodes), draw.choice([*nodes, "absent"])) for _ in range(120)] + [("absent", nodes[0]), (nodes[0], nodes[0])] * 2
    edges = edges_of(spark, *pairs, (nodes[0], nodes[0])) if kind == "any" else edges_of(spark, *pairs)
    reach = walked(pairs + [(nodes[0], nodes[0])] if kind == "any" else pairs)
    index = closure.interval_index(edges)
    got = closure.is_above(spark.createDataFrame(asked, "node string, other string"), edges, index)
    assert rows(got) == sorted(((a, b, b in reach.get(a, ())) for a, b in asked), key=lambda t: tuple(map(str, t)))


def test_intervals_are_those_of_the_forest(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("e", "c"), ("g", "f")]
    index = {r.node: r for r in closure.interval_index(edges_of(spark, *pairs)).collect()}
    inside = lambda x, y: index[y].first <= index[x].first <= index[y].last
    parent = {"b": "a", "c": "a", "d": "b", "e": "b", "g": "f"}
    for x in index:
        line, at = [x], x
        while at in parent:
            at = parent[at]
            line.append(at)
        assert {y for y in index if index[y].first <= index[x].first <= index[y].last and (y in "abcde") == (x in "abcde")} == set(line)
    assert inside("e", "b") and not inside("e", "c")

"""Near duplicates by SimHash fingerprints, found with vantage-point trees.

A fingerprint has a bit set where over half of the shingle hashes of a text have
it set.  Equal fingerprints are one node throughout, so copies never meet each
other, and no node has more than 43,744 others within ``RADIUS`` bits.

The tree's upper levels are fitted on a bounded sample of ``SAMPLE`` nodes: a
branch has a vantage point and a radius, nodes within the radius go left, the
rest right.  Its leaves are the shards, and every node lives in one.  By the
triangle inequality a node can only have a link on the other side of a branch
if its distance to the vantage point is within ``RADIUS`` of the boundary; then
a copy of it goes on as a query.  Of two nodes that a branch parts, the right
one asks the left side, so each pair is looked for once.

A shard goes on with a tree of its own: branches halve the indexed nodes, and
queries follow the same bounds, until what is left is small enough to compare.
A vantage point links all within ``RADIUS`` of it at once.  What is known to be
one component is not compared within itself, so a dense crowd of fingerprints
costs about as much as it has members.  Shards give a spanning forest, not all
pairs.  A shard with many queries is dealt to several tasks, each with the
whole index of the shard and a part of its queries.  The number of shards grows
with the power 0.4 of the nodes, which balances copies against comparisons.

Defined results: a NULL text has no words; a text without words has fingerprint
zero and is linked like any other; rows that repeat share a component; a
component without any doc_id has NULL; an empty table gives an empty result.
Texts are read in pieces of ``PIECE`` bytes, so memory does not follow the length
of a text beyond the text itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.llm.components import components
from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SEED, RADIUS = 3, 42, 3
SAMPLE = 32_768  #: nodes on which the upper tree is fitted
LEAST_SHARDS, MOST_SHARDS = 32, 8_192
TASK_ROWS = 2_000_000  #: index and queries of a shard that one task takes
COMPARED = 1 << 18  #: pairs that are compared without a further branch
PIECE = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


# Fingerprints


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time; pieces end at white space."""
    at = 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        while stop < len(raw) and not _BLANKS[raw[stop]]:
            gap = np.flatnonzero(_BLANKS[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - stop), stop)])
            stop = stop + int(gap[0]) if len(gap) else min(stop + PIECE, len(raw))
        yield raw[at:stop].translate(_LOWER).split()
        at = stop


def _votes(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many of the windows of ``size`` words set each bit, and their number."""
    from xxhash import xxh64_intdigest

    total, n = np.zeros(64, np.int64), len(words) - size + 1
    for start in range(0, n, 50_000):
        part = words[start : min(start + 50_000, n) + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = np.concatenate([[0], ends[:-1]])
        spans = zip(starts[: len(part) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total, max(n, 0)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    total, n, kept = np.zeros(64, np.int64), 0, []
    for words in _pieces(text or b""):
        kept += words
        if len(kept) >= SHINGLE:
            more, times = _votes(kept, SHINGLE)
            total, n, kept = total + more, n + times, kept[len(kept) - SHINGLE + 1 :]
    if not n and kept:
        total, n = _votes(kept, len(kept))
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def sign(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            values = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(sign, "doc_id long, fp long")


# The upper tree


def distances(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to)


def vantage(points: np.ndarray, draw: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that halve the points with the fewest near the boundary; None where nothing parts them."""
    best = None
    for v in points[draw.integers(0, len(points), tries)]:
        d = distances(points, v)
        radius = int(np.median(d))
        if radius >= d.max():
            radius = int(d.max()) - 1
        left = int((d <= radius).sum())
        if not 0 < left < len(points):
            continue
        near = int((np.abs(d.astype(np.int16) - radius) <= RADIUS).sum())
        cost = near + abs(2 * left - len(points))
        if best is None or cost < best[0]:
            best = (cost, v, radius)
    return best and best[1:]


def fit(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """The upper tree as (vantage point, radius, left, right); a child below zero is shard ``-1 - child``."""
    draw = np.random.default_rng(1)
    tree: list[tuple[int, int, int, int]] = []
    leaves = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal leaves
        found = vantage(points, draw) if wanted > 1 and len(points) > 1 else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(tree)
        tree.append((0, 0, 0, 0))
        left = distances(points, found[0]) <= found[1]
        tree[at] = (int(found[0]), found[1], grow(points[left], wanted // 2), grow(points[~left], wanted - wanted // 2))
        return at

    grow(sample, shards)
    return tree


def route(points: np.ndarray, tree: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every node in its home shard and as a query in others."""
    if not tree:
        rows = np.arange(len(points))
        return rows, np.zeros(len(rows), np.int32), np.ones(len(rows), bool)
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            out.append((rows, np.full(len(rows), -1 - at, np.int32), home))
            continue
        v, radius, left, right = tree[at]
        d = distances(points[rows], np.uint64(v)).astype(np.int16)
        inside = d <= radius
        asks = ~inside & (d <= radius + RADIUS)  # a right node that can have a link on the left
        over = inside & ~home & (d > radius - RADIUS)  # queries look on both sides
        todo.append((left, rows[inside | asks], home[inside | asks] & inside[inside | asks]))
        todo.append((right, rows[~inside | over], home[~inside | over]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))


# Within a shard


class Forest:
    """Labels of the nodes of a shard; linked nodes share the smallest position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join_all(self, rows: np.ndarray) -> None:
        """All ``rows`` become one component."""
        labels = np.unique(self.label[rows])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def join_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            names, at = np.unique(np.concatenate([la, lb]), return_inverse=True)
            low, (x, y) = np.arange(len(names)), at.reshape(2, -1)
            while True:  # least label over the links, with shortcuts
                before = low.copy()
                np.minimum.at(low, x, low[y])
                np.minimum.at(low, y, low[x])
                low = low[low]
                if (low == before).all():
                    break
            where = np.searchsorted(names, self.label)
            hit = (where < len(names)) & (names[np.minimum(where, len(names) - 1)] == self.label)
            self.label[hit] = names[low[where[hit]]]


def search(points: np.ndarray, index: np.ndarray, queries: np.ndarray, forest: Forest, draw: np.random.Generator) -> None:
    """Links every query with the indexed nodes within ``RADIUS``; ``index`` and ``queries`` are positions in ``points``."""
    todo = [(index, queries)]
    while todo:
        index, queries = todo.pop()
        if not len(index) or not len(queries):
            continue
        known = forest.label[index]
        names, times = np.unique(known, return_counts=True)
        main = names[times.argmax()]
        if times.max() * 2 > len(index) and times.max() > 64:
            # Most of the index is one component: its members need not look for each other.
            same = forest.label[queries] == main
            if same.any() and not same.all():
                todo += [(index, queries[~same]), (index[known != main], queries[same])]
                continue
            if same.all():
                index = index[known != main]
                if not len(index):
                    continue
        if len(index) * len(queries) <= COMPARED or len(index) <= 16:
            for start in range(0, len(queries), max(1, 4 * COMPARED // len(index))):
                part = queries[start : start + max(1, 4 * COMPARED // len(index))]
                i, q = np.nonzero(np.bitwise_count(points[index][:, None] ^ points[part][None, :]) <= RADIUS)
                forest.join_pairs(index[i], part[q])
            continue
        found = vantage(points[index], draw, 4)
        if found is None:  # cannot be: distinct nodes differ in their distance to one of them
            half = len(index) // 2
            todo += [(index[:half], queries), (index[half:], queries)]
            continue
        v, radius = found
        d, e = distances(points[index], v).astype(np.int16), distances(points[queries], v).astype(np.int16)
        forest.join_all(np.concatenate([index[d <= RADIUS], queries[e <= RADIUS]]))
        todo.append((index[d <= radius], queries[e <= radius + RADIUS]))
        todo.append((index[d > radius], queries[e > radius - RADIUS]))


def shard_links(table: pa.Table) -> pa.Table:
    """(a, b) of a spanning forest of the links between the indexed nodes and the queries of one group."""
    points = table.column("fp").to_numpy().view(np.uint64)
    kind = table.column("kind").to_numpy()
    points, at = np.unique(points, return_inverse=True)
    index, queries = np.unique(at[kind != QUERY]), np.unique(at[kind != INDEX])
    forest = Forest(len(points))
    search(points, index, queries, forest, np.random.default_rng(2))
    linked = forest.label != np.arange(len(points))
    names = points.view(np.int64)
    return pa.table({"a": names[linked], "b": names[forest.label[linked]]})


QUERY, INDEX, BOTH = 0, 1, 2


def links(nodes: DataFrame, shards: int | None = None, sample: int = SAMPLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``nodes.fp`` that give the components of all links."""
    n = nodes.count()
    shards = shards or int(min(max(LEAST_SHARDS, n**0.4), MOST_SHARDS))
    picked = nodes.orderBy(F.xxhash64(F.lit(3), "fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = fit(picked, shards)

    def deal(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for start in range(0, len(points), 10_000):
                part = points[start : start + 10_000]
                rows, shard, home = route(part, tree)
                yield pa.RecordBatch.from_arrays([pa.array(part[rows].view(np.int64)), pa.array(shard), pa.array(home)], names=["fp", "shard", "home"])

    dealt = cut(nodes.mapInArrow(deal, "fp long, shard int, home boolean"))
    # One number for each shard, of which there are at most MOST_SHARDS.
    sizes = {r.shard: r["count"] for r in dealt.groupBy("shard").count().collect()}
    parts = {s: -(-rows // task_rows) for s, rows in sizes.items() if rows > task_rows}
    dealt = dealt.withColumn("part", F.lit(0)).withColumn("kind", F.when(F.col("home"), BOTH).otherwise(QUERY))
    if parts:
        n_parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, k in parts.items() for x in (s, k)]), F.col("shard")), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), n_parts.cast("long")).cast("int")
        every = F.when(F.col("home"), F.sequence(F.lit(0), n_parts - 1)).otherwise(F.array(own))
        dealt = dealt.withColumn("own", own).withColumn("part", F.explode(every))
        dealt = dealt.withColumn("kind", F.when(~F.col("home"), QUERY).when(F.col("part") == F.col("own"), BOTH).otherwise(INDEX))
    return dealt.select("fp", "shard", "part", "kind").groupBy("shard", "part").applyInArrow(shard_links, "a long, b long")


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(nodes.select("fp"), **settings))
    owned = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = owned.groupBy(F.col("label").alias("of")).agg(F.min("least").alias("component_id"))
    of_node = owned.join(smallest, F.col("label") == F.col("of")).select(F.col("fp").alias("node"), "component_id")
    return rows.join(of_node, F.col("fp") == F.col("node"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

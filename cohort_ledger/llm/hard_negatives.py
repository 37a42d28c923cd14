"""Hard negatives by Fagin's threshold algorithm.

Rows are vectors of integers, ``floor(256 * x)`` of each component, and a score
is an integer inner product, so ties are exact.  Rows are dealt to blocks and
anchors to groups; a task holds one block and one group.  A block keeps, for
each dimension, its rows sorted by that component.  An anchor walks all lists
at once, from the top where its own component is positive and from the bottom
where it is negative.  A row met for the first time is scored at once (random
access).  The sum of what the lists stand at, weighted by the anchor, is the
threshold: no row not yet met scores more.  The walk ends once the threshold is
strictly below what every window of the anchor still needs, its kth score or, if
it is higher, its lower bound.

Positives come first (one window without bounds, same label), then negatives, in
a window for each positive.  Each block gives its own best rows and the best of
those are taken over all blocks, so the result does not depend on the dealing.

Defined results: rows with a NULL label, vector or component, a component that
is not finite, or a NULL vec_id take no part; neither do rows with a component
beyond 2^20, whose scores would not fit a long.  Rows equal in id, label and
vector are one row; rows that share an id only are rows of their own, ordered by
label and then by a hash of the vector; a short vector is filled up with zeros.
An anchor without positives, or a positive without negatives in its window, gives
no row.  An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE = 256
LARGEST = float(2**20)
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80  #: a negative has at least so much of the positive's score
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
BLOCK_ROWS, LEAST_BLOCKS = 32_768, 48
GROUP_ANCHORS = 2_048
FIRST_DEPTH = 8


def vectors(rows: DataFrame, relabel_every: int = RELABEL_EVERY, labels: int = LABELS) -> DataFrame:
    """(vec_id, label, v, tie) of the distinct rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST))
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"), whole.alias("whole"))
    good = good.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND whole")
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    ints = F.transform("x", lambda e: F.floor(e * SCALE).cast("long"))
    return good.select("vec_id", label.alias("label"), ints.alias("v")).withColumn("tie", F.xxhash64("v")).distinct()


@dataclass
class Block:
    """Rows of one task, with a sorted list of positions for each dimension."""

    ids: np.ndarray
    labels: np.ndarray
    ties: np.ndarray
    values: np.ndarray  #: (row, dimension)
    lists: np.ndarray  #: (dimension, place) positions by falling component
    tops: np.ndarray  #: (dimension, place) those components

    def __post_init__(self):
        self.doubles = self.values.astype(np.float64)
        self.largest = float(np.abs(self.doubles).max(initial=0.0))

    @classmethod
    def of(cls, ids, labels, ties, values) -> Block:
        order = np.lexsort((ties, labels, ids))  # position order is the order of ties
        ids, labels, ties, values = ids[order], labels[order], ties[order], values[order]
        lists = np.argsort(-values, axis=0, kind="stable").T.astype(np.int32)
        return cls(ids, labels, ties, values, np.ascontiguousarray(lists), np.take_along_axis(values.T, lists, 1))

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; by floating point where every sum is an exact double."""
        if self.largest * float(np.abs(anchor).max()) * max(self.values.shape[1], 1) < 2.0**53:
            return (self.doubles[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.values[at] @ anchor


def walk(block: Block, anchor: np.ndarray, wanted, floors: np.ndarray, ceilings: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, scores) of the best ``k`` wanted rows of each window ``floor <= score <= ceiling``.

    ``wanted`` says of positions which may be taken.  Best first, ties by position.
    """
    n, _ = block.values.shape
    weight = anchor[anchor != 0]
    lists, tops = block.lists[anchor != 0], block.tops[anchor != 0]
    down = weight > 0
    falling, rising = lists[down], lists[~down]
    met, n_met = np.zeros(n, bool), 0
    kept_at, kept_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = floors.copy()  # a window needs no row below this
    depth, step = 0, FIRST_DEPTH
    if not len(weight):  # every score is zero and the threshold never falls
        n_met, kept_at = n, np.flatnonzero(wanted(np.arange(n)))
        kept_score = np.zeros(len(kept_at), np.int64)
    while n_met < n:
        stop = min(depth + step, n)
        here = np.zeros(n, bool)
        here[falling[:, depth:stop]] = True
        here[rising[:, n - stop : n - depth]] = True
        fresh = np.flatnonzero(here & ~met)
        met |= here
        n_met += len(fresh)
        fresh = fresh[wanted(fresh)]
        scores = block.scores(fresh, anchor)
        useful = (scores >= kth.min()) & (scores <= ceilings.max())
        kept_at, kept_score = np.concatenate([kept_at, fresh[useful]]), np.concatenate([kept_score, scores[useful]])
        depth, step = stop, 2 * step
        if n_met == n:
            break
        threshold = int((weight * np.where(down, tops[:, depth - 1], tops[:, n - depth])).sum())
        for w in range(len(floors)):
            inside = kept_score[(kept_score >= floors[w]) & (kept_score <= ceilings[w])]
            if len(inside) >= k:
                kth[w] = max(floors[w], np.partition(inside, len(inside) - k)[len(inside) - k])
        if (threshold < kth).all():
            break
    out = []
    for floor, ceiling in zip(floors, ceilings, strict=True):
        inside = np.flatnonzero((kept_score >= floor) & (kept_score <= ceiling))
        best = inside[np.lexsort((kept_at[inside], -kept_score[inside]))[:k]]
        out.append((kept_at[best], kept_score[best]))
    return out


def _matrix(column, dims: int) -> np.ndarray:
    """A list column as a matrix of ``dims`` columns; short vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), dims), np.int64)
    if (sizes == dims).all():
        out[:] = flat.reshape(-1, dims)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


FOUND = "anchor_id long, anchor_label long, anchor_tie long, w int, positive_id long, positive_score long, id long, label long, tie long, score long"


def _walks(k: int, same: bool, percent: int):
    """A function from one task's rows (a block and a group of anchors) to each window's best rows."""
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("anchor").to_numpy()
        dims = int(np.max(np.asarray(table.column("v").combine_chunks().value_lengths()), initial=0))
        rows, anchors = table.filter(pa.array(~kind)), table.filter(pa.array(kind))
        take = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        out: dict[str, list] = {f.split(" ")[0]: [] for f in FOUND.split(", ")}
        if rows.num_rows and anchors.num_rows:
            block = Block.of(take(rows, "vec_id"), take(rows, "label"), take(rows, "tie"), _matrix(rows.column("v"), dims))
            values = _matrix(anchors.column("v"), dims)
            windows = anchors.column("windows").to_pylist()
            for a, (i, label, tie) in enumerate(zip(take(anchors, "vec_id"), take(anchors, "label"), take(anchors, "tie"), strict=True)):
                if same:
                    lists = [{"w": 0, "positive_id": None, "positive_score": None}]
                    floors, ceilings = np.array([lowest]), np.array([highest])
                    itself = (block.ids == i) & (block.labels == label) & (block.ties == tie)
                    wanted = lambda at: (block.labels[at] == label) & ~itself[at]  # noqa: E731, B023
                else:
                    lists = windows[a]
                    ceilings = np.array([w["positive_score"] for w in lists])
                    floors = -((-percent * ceilings) // 100)
                    wanted = lambda at: block.labels[at] != label  # noqa: E731, B023
                for window, (at, scores) in zip(lists, walk(block, values[a], wanted, floors, ceilings, k), strict=True):
                    for x, s in zip(at, scores, strict=True):
                        found = (i, label, tie, window["w"], window["positive_id"], window["positive_score"], block.ids[x], block.labels[x], block.ties[x], s)
                        for column, value in zip(out.values(), found, strict=True):
                            column.append(value)
        kinds = {f.split(" ")[0]: pa.int32() if f.endswith(" int") else pa.int64() for f in FOUND.split(", ")}
        return pa.table({c: pa.array(values, kinds[c]) for c, values in out.items()})

    return run


def best(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, same: bool, percent: int, block_rows: int) -> DataFrame:
    """The ``k`` best rows of every window of ``anchors``, with their place ``rank`` from 1."""
    blocks, groups = max(LEAST_BLOCKS, -(-n_rows // block_rows)), max(1, -(-n_anchors // GROUP_ANCHORS))
    key = F.xxhash64("vec_id", "label", "tie")
    block, group = F.pmod(key, F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(5), key), F.lit(groups)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("array<struct<w:int,positive_id:bigint,positive_score:bigint>>")
    left = rows.select("vec_id", "label", "tie", "v", none.alias("windows"), F.lit(False).alias("anchor"), block.alias("block")).withColumn("group", each(groups))
    right = anchors.select("vec_id", "label", "tie", "v", "windows", F.lit(True).alias("anchor"), group.alias("group")).withColumn("block", each(blocks))
    found = left.unionByName(right).groupBy("block", "group").applyInArrow(_walks(k, same, percent), FOUND)
    place = Window.partitionBy("anchor_id", "anchor_label", "anchor_tie", "w").orderBy(F.desc("score"), "id", "label", "tie")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor_every: int = ANCHOR_EVERY, percent: int = LEAST_PERCENT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    rows = cut(vectors(rows))
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    n_rows, n_anchors = rows.count(), anchors.count()
    none = F.lit(None).cast("array<struct<w:int,positive_id:bigint,positive_score:bigint>>")
    positives = cut(best(rows, anchors.withColumn("windows", none), n_rows, n_anchors, POSITIVES, True, percent, block_rows))
    # At most POSITIVES windows for an anchor.
    windows = positives.groupBy("anchor_id", "anchor_label", "anchor_tie").agg(
        F.sort_array(F.collect_list(F.struct(F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))).alias("windows")
    )
    same = (F.col("vec_id") == F.col("anchor_id")) & (F.col("label") == F.col("anchor_label")) & (F.col("tie") == F.col("anchor_tie"))
    found = best(rows, anchors.join(windows, same), n_rows, n_anchors, NEGATIVES, False, percent, block_rows)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

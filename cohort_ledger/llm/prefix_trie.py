"""The prefix trie of conversations, with count-min screening.

A prefix of a conversation is known by a digest: the exclusive-or of a hash of
every turn salted with its place, 128 bits in two longs.  That is associative, so
conversations are cut into chunks and a very long one is no single task's work.

Screening: each task counts its digests in a count-min sketch whose counters stop
at two, which is all that matters: an estimate of one proves that a prefix has
one member, and so have all longer prefixes of that conversation.  Such tails
become nodes where they are, without a shuffle by prefix.  Only prefixes that may
be shared are grouped exactly.  The merged sketch is one bit for each cell ("two
or more"), ``LEAST_CELLS`` to ``MOST_CELLS`` of them by the number of turns,
at most 32 MB in all.  A full sketch proves less and changes no result.

The numbers of a subtree need no walk over its levels.  Every node is represented
by its smallest member, a member represents the nodes of an unbroken end of its
path, and each of these is counted once: in the member's own suffix sums, which
are then summed over the members of each prefix.

Defined results: turns are ordered by turn, NULL first, then by role and text
hash; rows without a conv_id take no part; a NULL role or text is empty; repeated
rows are turns like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_CELLS, MOST_CELLS = 1 << 20, 1 << 28
CELLS_PER_TURN = 16
ROWS_OF_SKETCH = 2
SLICES = 64  #: parts in which the sketch is merged
WORD = r"[^\x20\x09-\x0D]+"
SHARED_TURNS, FAMILY = 4, 20  #: a conversation starts with fewer than 4 turns of the first one of its 20
KEY = ("depth", "k1", "k2")


# Rebuilt conversations and their prefixes


def _before(sizes: DataFrame, totals: dict[str, Column], latest_first: bool = False) -> DataFrame:
    """What the earlier (or later) chunks of each conversation add up to, from one row for each chunk."""
    order = F.desc("of_chunk") if latest_first else F.asc("of_chunk")
    others = Window.partitionBy("of_conv").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("of_conv", "of_chunk", *[F.coalesce(total.over(others), F.lit(0)).alias(name) for name, total in totals.items()])


def _chunk_sums(rows: DataFrame, *sums: Column) -> DataFrame:
    return rows.groupBy(F.col("conv_id").alias("of_conv"), F.col("chunk").alias("of_chunk")).agg(*sums)


def _with(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    return rows.join(chunks, (F.col("conv_id") == F.col("of_conv")) & (F.col("chunk") == F.col("of_chunk"))).drop("of_conv", "of_chunk")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, chunk, place, c1, c2, words) of every turn; place counts from 1, chunks follow the order of turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(F.lit(2), role, text).alias("c2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    rows = cut(cut(rows).repartitionByRange("conv_id", "turn", "c1", "c2").withColumn("chunk", F.spark_partition_id()))
    earlier = _before(_chunk_sums(rows, F.count(F.lit(1)).alias("n")), {"n_before": F.sum("n")})
    place = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "c1", "c2"))
    placed = _with(rows.withColumn("place", place.cast("long")), earlier)
    return placed.select("conv_id", "chunk", (F.col("place") + F.col("n_before")).alias("place"), "c1", "c2", "words")


def rebuilt(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, with their depth, and (conv_id, length) of each conversation."""
    counts = turned.groupBy(F.col("conv_id").alias("id")).agg(F.count(F.lit(1)).alias("n_own"))
    shared = F.crc32(F.col("id").cast("string").cast("binary")) % SHARED_TURNS
    convs = counts.select("id", "n_own", shared.alias("h"), (F.col("id") - F.col("id") % FAMILY).alias("base"))
    bases = counts.select(F.col("id").alias("base_id"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, F.col("base") == F.col("base_id"), "left").withColumn("n_lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.select("id", "base", "h", "n_lead", (F.col("n_lead") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")))
    own = turned.join(convs, F.col("conv_id") == F.col("id")).where("place > h")
    own = own.select("conv_id", "chunk", (F.col("n_lead") + F.col("place") - F.col("h")).alias("depth"), "c1", "c2", "words", "length")
    starts = turned.where((F.col("place") < SHARED_TURNS) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "from_id")
    lead = starts.join(convs, F.col("from_id") == F.col("base")).where("place <= h")
    lead = lead.select(F.col("id").alias("conv_id"), F.lit(-1).alias("chunk"), F.col("place").alias("depth"), "c1", "c2", "words", "length")
    return own.unionByName(lead), convs.select(F.col("id").alias("conv_id"), "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """Every turn with the digests of the prefix it ends (k1, k2) and of the one before (p1, p2)."""
    salted = cut(rows.select("conv_id", "chunk", "depth", "words", "length", *[F.xxhash64(F.lit(i), "depth", "c1", "c2").alias(f"s{i}") for i in (1, 2)]))
    xor = lambda c: F.bit_xor(c)
    earlier = _before(_chunk_sums(salted, xor("s1").alias("x1"), xor("s2").alias("x2")), {"b1": xor("x1"), "b2": xor("x2")})
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = _with(salted.withColumn("r1", xor("s1").over(within)).withColumn("r2", xor("s2").over(within)), earlier)
    k = [F.col(f"r{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    return running.select("conv_id", "chunk", "depth", "words", "length", k[0].alias("k1"), k[1].alias("k2"), k[0].bitwiseXOR(F.col("s1")).alias("p1"), k[1].bitwiseXOR(F.col("s2")).alias("p2"))


# Count-min screening


def cells(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each digest in each row of the sketch: (row of the sketch, digest)."""
    shift = np.uint64(64 - bits)
    a, b = k1.view(np.uint64), k2.view(np.uint64)
    return np.stack([((a + np.uint64(r) * b) * np.uint64(0x9E3779B97F4A7C15)) >> shift for r in range(ROWS_OF_SKETCH)]).astype(np.int64)


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """For each row of the sketch and cell whether it counts two or more, as packed bits."""
    width = 1 << bits
    part = ROWS_OF_SKETCH * width // SLICES

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = cells(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), bits)
            at += np.arange(ROWS_OF_SKETCH)[:, None] * width
            at, times = np.unique(at, return_counts=True)
            slice_ = at // part
            for s, first in zip(*np.unique(slice_, return_index=True), strict=True):
                stop = np.searchsorted(slice_, s, side="right")
                inside = (at[first:stop] - s * part).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"slice": pa.array([int(s)], pa.int32()), "cells": [inside.tobytes()], "twice": [np.packbits(times[first:stop] > 1).tobytes()]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(part, bool), np.zeros(part, bool)
        for batch in batches:
            for c, t in zip(batch.column("cells"), batch.column("twice"), strict=True):
                at = np.frombuffer(c.as_py(), np.uint32)
                twice[at] |= once[at] | np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(at)).astype(bool)
                once[at] = True
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(twice).tobytes()]})

    counted = rows.select("k1", "k2").mapInArrow(count, "slice int, cells binary, twice binary")
    merged = counted.groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    out = np.zeros(ROWS_OF_SKETCH * width // 8, np.uint8)
    for r in merged.collect():  # at most MOST_CELLS bits in all
        out[r.slice * part // 8 : (r.slice + 1) * part // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def screened(rows: DataFrame, n_turns: int) -> DataFrame:
    """``rows`` with ``alone`` and ``parent_alone``: the estimate proves that the prefix, or the one before, has one member."""
    wanted = min(max(LEAST_CELLS, CELLS_PER_TURN * n_turns), MOST_CELLS)
    bits = int(np.log2(wanted // ROWS_OF_SKETCH))
    table = rows.sparkSession.sparkContext.broadcast(sketch(rows, bits))

    def proven(k1, k2):
        at = cells(k1, k2, bits) + np.arange(ROWS_OF_SKETCH)[:, None] * (1 << bits)
        return ((table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0).any(axis=0)

    def screen(batches):
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy()  # noqa: E731, B023
            alone, parent = proven(column("k1"), column("k2")), proven(column("p1"), column("p2"))
            parent &= column("depth") > 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(alone), pa.array(parent)], names=[*batch.schema.names, "alone", "parent_alone"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(screen, f"{kinds}, alone boolean, parent_alone boolean")


# Nodes


def ends_digests(ends: DataFrame) -> DataFrame:
    """(end_depth, e1, e2, ends_sha256): SHA-256 of the ascending decimal ids of each prefix's ``ends``.

    Ids are sorted within their prefix and streamed, so no list is held; the digest
    itself asks for one task for each prefix.
    """

    def digest(batches):
        key, state = None, None
        row = lambda: pa.RecordBatch.from_pydict({"end_depth": [key[0]], "e1": [key[1]], "e2": [key[2]], "ends_sha256": [state.hexdigest()]})
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in KEY], axis=1)
            ids = batch.column("conv_id").to_pylist()
            heads = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(keys) else []
            for start, stop in zip(heads, [*heads[1:], len(keys)], strict=True):
                here = tuple(keys[start].tolist())
                if here != key:
                    if key is not None:
                        yield row()
                    key, state, gap = here, hashlib.sha256(), b""
                state.update(gap + ",".join(map(str, ids[start:stop])).encode())
                gap = b","
        if key is not None:
            yield row()

    sorted_ = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return sorted_.mapInArrow(digest, "end_depth long, e1 long, e2 long, ends_sha256 string")


def _suffix_sums(values: DataFrame) -> DataFrame:
    """Prefixes with what their conversation holds at their depth or deeper (leaves, saved)."""
    later = _before(_chunk_sums(values, F.sum("leaf").alias("l"), F.sum("worth").alias("w")), {"later_leaf": F.sum("l"), "later_worth": F.sum("w")}, latest_first=True)
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    both = _with(values.withColumn("leaves", F.sum("leaf").over(within)).withColumn("saved", F.sum("worth").over(within)), later)
    return both.where("k1 IS NOT NULL").select(*KEY, (F.col("leaves") + F.col("later_leaf")).alias("leaves"), (F.col("saved") + F.col("later_worth")).alias("saved"))


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    rows, lengths = rebuilt(cut(turns(conversations)))
    top = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum("length").alias("turns")).first()
    known = cut(screened(cut(prefixes(rows)), top.turns or 0))
    first = known.where("alone").groupBy(F.col("conv_id").alias("of")).agg(F.min("depth").alias("first_alone"))
    front = known.where("NOT (alone AND parent_alone)").join(first, F.col("conv_id") == F.col("of"), "left")
    front = cut(front.drop("of", "alone", "parent_alone"))
    shared = front.where("first_alone IS NULL OR depth < first_alone").drop("first_alone")
    heads = front.where("depth = first_alone")
    tails = known.where("alone AND parent_alone").unionByName(front.where("depth > first_alone"), allowMissingColumns=True)

    groups = cut(
        shared.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"), F.max("length").alias("longest"), F.min("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
        )
    )
    of = lambda names: [F.col(c).alias(f"g_{c}") for c in names]
    at_group = (F.col("depth") == F.col("g_depth")) & (F.col("k1") == F.col("g_k1")) & (F.col("k2") == F.col("g_k2"))
    member = shared.join(groups.select(*of([*KEY, "n_convs", "rep", "longest"])), at_group)
    stands = F.col("conv_id") == F.col("g_rep")
    leaf = stands & (F.col("length") == F.col("depth")) & (F.col("g_longest") == F.col("depth"))
    values = member.select("conv_id", "chunk", *KEY, F.when(leaf, 1).otherwise(0).alias("leaf"), F.when(stands, (F.col("g_n_convs") - 1) * F.col("words")).otherwise(F.lit(0)).alias("worth"))
    # A conversation with a tail ends in one leaf of its own, below all of its shared prefixes.
    none = F.lit(None).cast("long")
    ending = heads.select("conv_id", "chunk", "depth", none.alias("k1"), none.alias("k2"), F.lit(1).alias("leaf"), F.lit(0).cast("long").alias("worth"))
    sums = _suffix_sums(cut(values.unionByName(ending))).groupBy(*[F.col(c).alias(f"s_{c}") for c in KEY]).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    step = [(F.col("depth") - 1).alias("c_depth"), F.col("p1").alias("c1"), F.col("p2").alias("c2")]
    children = groups.select(*step).unionByName(heads.select(*step)).groupBy("c_depth", "c1", "c2").agg(F.count(F.lit(1)).alias("n_children"))
    ends = ends_digests(shared.where("depth = length"))

    parents = groups.select(*of([*KEY, "rep"]))
    at_parent = (F.col("depth") - 1 == F.col("g_depth")) & (F.col("p1") == F.col("g_k1")) & (F.col("p2") == F.col("g_k2"))
    above = F.when(F.col("depth") == 1, F.lit(top.least)).otherwise(F.col("g_rep")).alias("parent_conv_id")
    empty = F.sha2(F.lit(""), 256)
    inner = (
        groups.join(parents, at_parent, "left")
        .select(*KEY, F.col("rep").alias("conv_id"), above, "n_convs")
        .join(sums, (F.col("depth") == F.col("s_depth")) & (F.col("k1") == F.col("s_k1")) & (F.col("k2") == F.col("s_k2")))
        .join(children, (F.col("depth") == F.col("c_depth")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
        .join(ends, (F.col("depth") == F.col("end_depth")) & (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2")), "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    )

    def single(rows: DataFrame, parent: Column) -> DataFrame:
        last = F.col("depth") == F.col("length")
        return rows.select(
            "conv_id", "depth", parent, F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
        )

    fringe = single(heads.join(parents, at_parent, "left"), above)
    rest = single(tails, F.col("conv_id").alias("parent_conv_id"))
    return root(lengths, groups, heads, top).unionByName(inner).unionByName(fringe).unionByName(rest)


def root(lengths: DataFrame, groups: DataFrame, heads: DataFrame, top) -> DataFrame:
    """The textless node above all conversations; none where there is no conversation."""
    sums = groups.agg(
        F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"),
        F.sum(F.when(F.col("longest") == F.col("depth"), 1).otherwise(0)).alias("n_leaves"),
        F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).first()
    tips = heads.agg(F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"), F.count(F.lit(1)).alias("n_leaves")).first()
    n_children = (sums.n_children or 0) + (tips.n_children or 0)
    n_leaves = (sums.n_leaves or 0) + tips.n_leaves if n_children else 1
    zero = F.lit(0).cast("long")
    ends = ends_digests(lengths.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")).select("ends_sha256")
    found = ends.agg(F.max("ends_sha256").alias("found")).first().found
    kinds = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    row = (top.least, 0, None, top.n, n_children, n_leaves, sums.saved or 0, found or hashlib.sha256().hexdigest())
    return lengths.sparkSession.createDataFrame([row] if top.n else [], kinds)

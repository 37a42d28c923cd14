"""Near duplicates: ProbMinHash signatures, banding and exact verification.

Shingles are ``SHINGLE`` words in a row.  Each is a Poisson process of its weight
as rate; every arrival falls into a random register, which keeps the first
arrival and the shingle it came from.  Links are judged by the sets of shingles,
so every distinct shingle has the same weight, however often it occurs.
All processes advance together and one stops once its next arrival is later
than every register of its document (early termination).  The share of equal
registers of two documents estimates their probability Jaccard similarity,
which for equal weights is the Jaccard similarity of the sets.

Registers are banded.  Documents that share a band are candidates; candidates
whose estimate is not hopeless (``SLACK``, four standard deviations) are
verified by the exact Jaccard similarity of their shingle sets.  Classes are
connected components of verified links between distinct texts; equal texts are
one node throughout, so copies never meet each other.

A band shared by up to ``SMALL`` texts gives all its pairs.  In a larger one
all texts are compared with two of them: the smallest, and the one that shares
the most large bands (the centre of a family of variants).  Where that does not
bring all of them into one class, they get ``FINE_BANDS`` narrower keys of more
registers, from which smaller groups come, and again so for groups that are
still large.  These rounds only join classes cheaply.  What is left of large
bands in more than one class then meets by an exact prefix filter: with the
shingles of each text ordered from rare to common, two texts of sizes m and n
can only be similar if they share one of their first m - c + 1 and n - c + 1,
where c is the overlap that the similarity asks of these sizes.  A shingle pairs
only texts for whose sizes it stands far enough in front, so boilerplate of a
crowd below the similarity pairs nobody.  Pairs of one class are left out.

Chance to miss a link of similarity 0.8: 7e-5 that no band is shared, and 2e-5
that the estimate looks hopeless.

Defined results: words are ASCII letters and digits (in lower case) and
non-ASCII characters; a text of fewer than five words is one shingle; texts
without words are linked only to equal texts; a NULL text is a class of its own
with class_id = doc_id; repeated rows share a class; class_id is the smallest
doc_id of the class, NULL if none has one; an empty table gives an empty result.
Equality of texts is judged by 64-bit hashes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_ledger.llm import words as W
from cohort_ledger.llm.components import components
from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
SLACK = 0.15
SMALL = 16
FINE_BANDS, FINE_ROWS = 80, (12, 24)
SIZE_STEP = 1.05  #: ratio of the sizes that share a bucket of the prefix filter


def shingles(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, times) of the distinct shingles of a slice, by document."""
    spans = W.words(texts, W.word_table("term"))
    hashed = W.hashes(texts, spans, lower=True)
    doc, per = spans.doc(), spans.per_doc
    at = W.window_starts(spans, SHINGLE)
    docs, names = [doc[at]], [W.window_hashes(hashed, SHINGLE)[at]]
    for size in range(1, SHINGLE):  # shorter texts whole
        short = np.flatnonzero(per == size)
        if len(short):
            docs.append(short)
            names.append(W.window_hashes(hashed, size)[spans.first[short]])
    doc, name = np.concatenate(docs), np.concatenate(names)
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    head = np.ones(len(name), bool)
    head[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    lead = np.flatnonzero(head)
    return doc[lead], name[lead], np.diff(np.append(lead, len(name)))


def registers(n_docs: int, doc: np.ndarray, name: np.ndarray, times: np.ndarray, k: int = REGISTERS) -> np.ndarray:
    """The shingle of the first arrival in each register: (document, register) of 64-bit hashes; the weight is 1 + ln(times)."""
    first, owner = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    rate = 1.0 + np.log(times)
    clock, step = np.zeros(len(name)), 0
    latest = np.full(n_docs, np.inf)
    while len(name):
        clock = clock - np.log(W.unit(W.seeded(name, 2 * step))) / rate
        alive = clock < latest[doc]
        doc, name, rate, clock = doc[alive], name[alive], rate[alive], clock[alive]
        slot = doc * k + ((W.seeded(name, 2 * step + 1) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, slot, clock)
        won = first[slot] == clock
        owner[slot[won]] = name[won]
        touched = np.unique(doc[won])
        latest[touched] = first.reshape(n_docs, k)[touched].max(axis=1)
        step += 1
    return owner.reshape(n_docs, k)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, signature) of every row: node is a hash of the text, a text without words has no signature."""

    def sign(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                doc, name, _ = shingles(texts)
                filled = np.bincount(doc, minlength=texts.n) > 0
                out = (registers(texts.n, doc, name, np.ones(len(name))) >> np.uint64(32)).astype("<u4")
                values = [out[i].tobytes() if filled[i] else None for i in range(texts.n)]
                cut_ = slice(texts.rows.start, texts.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column(c)[cut_] for c in ("doc_id", "node")] + [pa.array(values, pa.binary())], names=["doc_id", "node", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"))
    return rows.select("doc_id", "node", "text").mapInArrow(sign, "doc_id long, node long, signature binary")


def _coarse(signed: DataFrame) -> DataFrame:
    """(node, key) of each band."""
    keys = [F.xxhash64(F.lit(b), F.substring("signature", 1 + 4 * BAND_ROWS * b, 4 * BAND_ROWS)) for b in range(BANDS)]
    return signed.select("node", F.explode(F.array(*keys)).alias("key"))


def _fine(signed: DataFrame, rows: int) -> DataFrame:
    """(node, key) of ``FINE_BANDS`` drawn sets of ``rows`` registers."""
    draw = np.random.default_rng(rows)
    sets = np.stack([draw.permutation(REGISTERS)[:rows] for _ in range(FINE_BANDS)])

    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([np.frombuffer(x.as_py(), "<u4") for x in batch.column("signature")])
            out = np.zeros((batch.num_rows, FINE_BANDS), np.uint64)
            for i in range(rows):
                out = W.joined(out, values[:, sets[:, i]].astype(np.uint64))
            out = W.joined(out, np.arange(FINE_BANDS, dtype=np.uint64) + np.uint64(rows << 20))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), FINE_BANDS)), pa.array(out.ravel().view(np.int64))], names=["node", "key"])

    return signed.select("node", "signature").mapInArrow(keys, "node long, key long")


def _grouped(keys: DataFrame) -> DataFrame:
    """(node, key, n) of keys held by two nodes or more, written once."""
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut(keys.join(sizes, "key").select("node", "key", "n"))


def _pairs(grouped: DataFrame) -> DataFrame:
    """Candidate pairs: all of a small group, and each member of a large one with its two centres."""
    small = grouped.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("g"))
    inner = small.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    large = grouped.where(F.col("n") > SMALL)
    shared = large.groupBy(F.col("node").alias("member")).agg(F.sum("n").alias("weight"))
    centres = (
        large.join(shared, F.col("node") == F.col("member"))
        .groupBy(F.col("key").alias("at"))
        .agg(F.min("node").alias("least"), F.max(F.struct("weight", "node")).alias("top"))
        .select("at", F.explode(F.array_distinct(F.array("least", "top.node"))).alias("centre"))
    )
    outer = large.join(centres, F.col("key") == F.col("at")).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return inner.union(outer).where("a < b").distinct()


def hopeful(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs worth verifying, by the estimate of their signatures."""

    def estimate(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.stack([np.frombuffer(x.as_py(), "<u4") for x in batch.column(c)]) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).mean(axis=1) >= SIMILARITY - SLACK))

    a, b = (signed.select(F.col("node").alias(f"n{c}"), F.col("signature").alias(f"s{c}")).hint("merge") for c in "ab")
    both = pairs.join(a, F.col("a") == F.col("na")).join(b, F.col("b") == F.col("nb")).select("a", "b", "sa", "sb")
    return both.mapInArrow(estimate, "a long, b long")


def similarities(left: W.Texts, right: W.Texts) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of row i of both sides."""
    n = left.n
    doc_a, name_a, _ = shingles(left)
    doc_b, name_b, _ = shingles(right)
    doc, name = np.concatenate([doc_a, doc_b]), np.concatenate([name_a, name_b])
    order = np.lexsort((name, doc))
    doc, name = doc[order], name[order]
    both = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
    common = np.bincount(doc[1:][both], minlength=n)
    return common / np.maximum(np.bincount(doc, minlength=n) - common, 1)


def links(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose texts are as similar as asked; ``texts`` has (node, text), a row for each node."""

    def verify(batches):
        for batch in batches:
            a_text, b_text = batch.column("ta"), batch.column("tb")
            size = np.cumsum(np.asarray(pc.binary_length(a_text)) + np.asarray(pc.binary_length(b_text)))
            at = 0
            while at < batch.num_rows:
                done = size[at - 1] if at else 0
                stop = max(int(np.searchsorted(size, done + 4_000_000, side="right")), at + 1)
                whole = lambda c: next(W.slices(c.slice(at, stop - at), 1 << 62))  # noqa: E731, B023
                good = similarities(whole(a_text), whole(b_text)) >= similarity - 1e-12
                yield batch.slice(at, stop - at).select(["a", "b"]).filter(pa.array(good))
                at = stop

    b = texts.select(F.col("node").alias("nb"), F.col("text").alias("tb")).hint("merge")
    a = texts.select(F.col("node").alias("na"), F.col("text").alias("ta")).hint("merge")
    # The member's text first: the centre of a large group is the same for many pairs, which can be split on the left.
    both = pairs.join(b, F.col("b") == F.col("nb")).join(a, F.col("a") == F.col("na")).select("a", "b", "ta", "tb")
    return both.mapInArrow(verify, "a long, b long")


def _unfinished(grouped: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of large groups that are not yet in one class."""
    large = grouped.where(F.col("n") > SMALL).select(F.col("node").alias("member"), "key")
    known = labels.select("node", "label")
    classed = large.join(known, F.col("member") == F.col("node"), "left").select("member", "key", F.coalesce("label", "member").alias("class"))
    mixed = classed.groupBy(F.col("key").alias("open")).agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    return classed.join(mixed, F.col("key") == F.col("open"), "left_semi").select("member").distinct()


def _prefix_pairs(members: DataFrame, texts: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """All pairs of members of different classes that can be as similar as asked, by shared rare shingles."""

    def sets(batches):
        for batch in batches:
            for part in W.slices(batch.column("text")):
                doc, name, _ = shingles(part)
                node = batch.column("node").to_numpy()[part.rows.start : part.rows.stop]
                size = np.bincount(doc, minlength=part.n)
                yield pa.RecordBatch.from_arrays([pa.array(node[doc]), pa.array(size[doc]), pa.array(name.view(np.int64))], names=["node", "size", "name"])

    asked = texts.join(members, F.col("node") == F.col("member"), "left_semi").select("node", "text")
    rows = cut(asked.mapInArrow(sets, "node long, size long, name long"))
    often = rows.groupBy(F.col("name").alias("shared")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    times = rows.join(often, F.col("name") == F.col("shared"), "left").select("node", "size", "name", F.coalesce("n", F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "name")) - 1
    front = times.withColumn("place", place).where((F.col("n") > 1) & (F.col("place") <= F.col("size") * (1 - similarity) + 1e-6))
    # The largest partner for whose size the shingle is still in the prefix.
    reach = (F.col("size") - F.col("place")) * ((1 + similarity) / similarity) - F.col("size") + 1e-6
    known = labels.select(F.col("node").alias("classed"), "label")
    front = front.withColumn("reach", reach).join(known, F.col("node") == F.col("classed"), "left")
    front = cut(front.select("node", "size", "name", "reach", F.coalesce("label", "node").alias("class")))
    bucket = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / float(np.log(SIZE_STEP)) + 1e-9)
    size = F.col("size").cast("double")
    buckets = F.sequence(bucket(size * similarity - 1e-6), bucket(F.least(size, F.col("reach"))))
    wide = front.where(F.col("reach") >= size * similarity - 1e-6).withColumn("bucket", F.explode(buckets))
    small = front.where(F.col("reach") >= size).select(*[F.col(c).alias(f"{c}_b") for c in front.columns], bucket(size).alias("bucket_b"))
    fits = (
        (F.col("name") == F.col("name_b"))
        & (F.col("bucket") == F.col("bucket_b"))
        & (F.col("class") != F.col("class_b"))
        & (F.struct("size_b", "node_b") < F.struct("size", "node"))
        & (F.col("size_b") >= size * similarity - 1e-6)
        & (F.col("size_b") <= F.col("reach"))
        & (F.col("size") <= F.col("reach_b"))
    )
    return wide.join(small, fits).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def classes(signed: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of every node that has a verified link."""
    coarse = grouped = _grouped(_coarse(signed))
    nodes = grouped.select(F.col("node").alias("wanted")).distinct().hint("merge")
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("node"), "text")
    texts = cut(texts.join(nodes, F.col("node") == F.col("wanted"), "left_semi").dropDuplicates(["node"]))
    labels = components(links(cut(hopeful(_pairs(grouped), signed)), texts, similarity))

    def more(pairs: DataFrame) -> DataFrame:
        edges = links(cut(hopeful(pairs, signed)), texts, similarity)
        return components(edges.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    members = first = cut(_unfinished(coarse, labels))
    for rows in FINE_ROWS:
        if members.isEmpty():
            break
        grouped = _grouped(_fine(signed.join(members, F.col("node") == F.col("member"), "left_semi"), rows))
        labels = more(_pairs(grouped))
        members = cut(_unfinished(grouped, labels))
    if not first.isEmpty():
        members = cut(_unfinished(coarse, labels))
        if not members.isEmpty():
            labels = more(_prefix_pairs(members, texts, labels, similarity))
    return labels


def _classed(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, own, class) of every row: its text's node and the class of that."""
    signed_rows = cut(signatures(docs))
    signed = cut(signed_rows.where("signature IS NOT NULL").select("node", "signature").dropDuplicates(["node"]))
    labels = classes(signed, docs, similarity)
    rows = signed_rows.select("doc_id", F.col("node").alias("own")).join(labels, F.col("own") == F.col("node"), "left")
    return rows.select("doc_id", "own", F.coalesce("label", "own").alias("class"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size) of every row of ``docs``."""
    rows = _classed(docs, similarity).select("doc_id", "class")
    sizes = rows.where("class IS NOT NULL").groupBy(F.col("class").alias("of")).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    return rows.join(sizes, F.col("class") == F.col("of"), "left").select(
        "doc_id",
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("class_size"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one with the smallest doc_id; rows without a text or an id all stay.

    A row is known by its id and its text, so unlike texts that share an id stay too.
    """
    rows = _classed(docs, similarity).where("doc_id IS NOT NULL AND class IS NOT NULL")
    first = rows.groupBy("class").agg(F.min(F.struct("doc_id", "own")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.own").alias("kept_node"))
    named = docs.where("text IS NOT NULL").withColumn("node_of_row", F.xxhash64("text"))
    same = (named["doc_id"] == kept["kept_id"]) & (named["node_of_row"] == kept["kept_node"])
    chosen = named.join(kept, same, "left_semi").dropDuplicates(["doc_id", "node_of_row"]).drop("node_of_row")
    return chosen.union(docs.where("text IS NULL OR doc_id IS NULL"))

"""Substring dedup by level-wise doubling.

A window of 2L words can only repeat if the windows of L words inside it do.
So windows of a short length are looked at first, those that occur twice or
more survive, and only windows of twice the length that hold a survivor go to
the next level, until the wanted length is reached or nothing survives.  A
longer window adds nothing to what is removed: its words are covered by the
repeated windows of the wanted length in it.

Below the last level one window stands for each window of twice its length:
the one with the smallest hash of the L + 1 inside.  Equal windows pick alike,
so none is lost, and about one in L / 2 positions is shuffled.  The name of a
window of 2L words is a hash of the names of its two halves.

Hashes travel as packed arrays, a block for each Arrow batch and hash range.
Equal windows of one batch are merged before the shuffle, so a passage that
fills a third of the corpus sends one entry per batch.  Windows of the last
level are dealt by the hash of the window that stands for them, which keeps
neighbours together and runs of removed windows short to write.

A document is its ``doc_id`` and its text; unlike texts that share an id follow in
the order of a hash.  Defined results: NULL or empty texts have no words; texts shorter than the window lose nothing; repeated rows are one
occurrence and all stay or lose the same words; a NULL doc_id counts as the
smallest; an empty table gives an empty result; other columns are not read.
A name has 64 bits besides the range it is dealt by, so two different windows
among n candidates share one with a chance of about n * n / 2^65 / ranges.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_ledger.llm import words as W
from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SEED_WORDS = 20, 5
RANGE_BYTES = 128_000_000  #: text for which one hash range is planned
NULL_ID = -(2**63)
PACKED = "range_no int, names binary, ids binary, starts binary, sure_ids binary, sure_starts binary"
RUNS = "doc_id long, run_start int, run_stop int"
_TOP = np.uint64(2**64 - 1)


def _sliding(a: np.ndarray, width: int, pick, pad) -> np.ndarray:
    """``pick`` over a[i : i + width] for every i, with ``pad`` beyond the end."""
    out, have = a, 1

    def moved(x, by):
        return np.concatenate([x[by:], np.full(min(by, len(x)), pad, x.dtype)])

    while have * 2 <= width:
        out, have = pick(out, moved(out, have)), have * 2
    return pick(out, moved(out, width - have)) if have < width else out


class Level:
    """Names of all windows of some length in a slice, and those that stand for longer ones."""

    def __init__(self, texts: W.Texts, seed: int, length: int):
        spans = W.words(texts, W.word_table("blank"))
        self.first, self.n = spans.first, len(spans.start)
        self.doc = spans.doc()
        self.pos = np.arange(self.n) - self.first[self.doc]
        self.room = self.first[self.doc + 1] - np.arange(self.n)
        hashed = W.hashes(texts, spans)
        self.at = {seed: self._padded(W.window_hashes(hashed, seed), seed)}
        size = seed
        while size < length:
            a = self.at[size]
            self.at[2 * size] = self._padded(W.joined(a[:-size], a[size:]) if self.n > size else a[:0], 2 * size)
            size *= 2

    def _padded(self, names: np.ndarray, length: int) -> np.ndarray:
        out = np.full(self.n, _TOP)
        out[: len(names)] = names
        out[self.room < length] = _TOP
        return out

    def smallest(self, length: int, among: np.ndarray | None = None) -> np.ndarray:
        """For each window of 2 * length words the smallest name of the windows of ``length`` in it."""
        names = self.at[length]
        return _sliding(names if among is None else np.where(among, names, _TOP), length + 1, np.minimum, _TOP)

    def standing(self, length: int) -> np.ndarray:
        """Does this window of ``length`` words stand for one of twice the length?"""
        low = np.where(self.room >= 2 * length, self.smallest(length), np.uint64(0))
        high = _sliding(low[::-1], length + 1, np.maximum, np.uint64(0))[::-1]
        return (high == self.at[length]) & (self.room >= length)


def _delta(a: np.ndarray) -> bytes:
    return np.diff(a, prepend=a.dtype.type(0)).tobytes()


def _undelta(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, kind), dtype=kind)


def _runs(ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct positions as runs of neighbours."""
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (starts[1:] > starts[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(ids)) - 1 if len(ids) else head
    return pa.RecordBatch.from_arrays([pa.array(ids[head], pa.int64()), pa.array(starts[head], pa.int32()), pa.array(starts[tail] + 1, pa.int32())], names=["doc_id", "run_start", "run_stop"])


def _entries(batch, seed: int, length: int, last: bool):
    """(names, dealt by, ids, starts) of the windows of one batch that may repeat."""
    ids_column = batch.column("doc_id").to_numpy(zero_copy_only=False)
    hits = batch.column("hits") if "hits" in batch.schema.names else None
    for texts in W.slices(batch.column("text")):
        level = Level(texts, seed, length)
        take = level.room >= length
        stands = level.at[length]
        if not last:
            take &= level.standing(length)
        elif length > seed:
            stands = level.smallest(length // 2)
        if hits is not None:
            mine = hits.slice(texts.rows.start, texts.n)
            per = np.asarray(mine.value_lengths())
            flat = mine.flatten()
            owner = np.repeat(np.arange(texts.n), per)
            edge = np.zeros(level.n + 1, np.int64)
            size = np.diff(level.first)[owner]
            for field, sign in (("run_start", 1), ("run_stop", -1)):
                np.add.at(edge, level.first[owner] + np.minimum(flat.field(field).to_numpy(), size), sign)
            alive = np.cumsum(edge[:-1]) > 0
            half = length // 2
            take &= level.smallest(half, alive) == level.smallest(half)
            take &= level.smallest(half) != _TOP
        at = np.flatnonzero(take)
        yield level.at[length][at], stands[at], ids_column[texts.rows][level.doc[at]], level.pos[at].astype(np.int32)


def _packed(seed: int, length: int, last: bool, ranges: int):
    def pack(batches):
        for batch in batches:
            got = list(_entries(batch, seed, length, last))
            if not got:
                continue
            names, stands, ids, starts = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((starts, ids, names))
            names, stands, ids, starts = names[order], stands[order], ids[order], starts[order]
            head = np.ones(len(names), bool)
            head[1:] = names[1:] != names[:-1]
            group = np.cumsum(head) - 1
            lead = np.flatnonzero(head)
            differs = (ids != ids[lead][group]) | (starts != starts[lead][group]) if len(lead) else head
            if last:  # every later one has an earlier one here
                sure = differs
            else:  # all of a repeated name survive; the one sent is marked as told
                again = np.zeros(len(lead), bool)
                again[group[differs]] = True
                sure = again[group] if len(lead) else head
            sent_starts = starts[lead].copy()
            if not last:
                sent_starts[again] = -1
            where = (W.seeded(stands[lead], 7) % np.uint64(ranges)).astype(np.int64)
            home = int(W.seeded(names[:1], 11)[0] % np.uint64(ranges)) if len(names) else 0
            s_ids, s_starts = ids[sure], starts[sure]
            by_place = np.lexsort((s_starts, s_ids))
            s_ids, s_starts = s_ids[by_place], s_starts[by_place]
            deal = np.lexsort((sent_starts, ids[lead], where))
            where, n, d, p = where[deal], names[lead][deal], ids[lead][deal], sent_starts[deal]
            held = np.unique(np.append(where, home)) if len(s_ids) else np.unique(where)
            rows = []
            for r, a, b in zip(held.tolist(), np.searchsorted(where, held), np.searchsorted(where, held, side="right")):
                mine = r == home and len(s_ids)
                name = n[a:b] if last else (n[a:b] >> np.uint64(32)).astype(np.uint32)
                rows.append([r, name.tobytes(), _delta(d[a:b]), _delta(p[a:b]), _delta(s_ids) if mine else b"", _delta(s_starts) if mine else b""])
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["range_no", "names", "ids", "starts", "sure_ids", "sure_starts"])

    return pack


def _compared(last: bool):
    kind = np.uint64 if last else np.uint32

    def compare(table: pa.Table) -> pa.Table:
        whole = lambda c, f: np.concatenate([f(x.as_py()) for x in table.column(c)])
        names = whole("names", lambda b: np.frombuffer(b, kind))
        ids, starts = whole("ids", lambda b: _undelta(b, np.int64)), whole("starts", lambda b: _undelta(b, np.int32))
        sure_ids, sure_starts = whole("sure_ids", lambda b: _undelta(b, np.int64)), whole("sure_starts", lambda b: _undelta(b, np.int32))
        order = np.lexsort((starts, ids, names))
        names, ids, starts = names[order], ids[order], starts[order]
        head = np.ones(len(names), bool)
        head[1:] = names[1:] != names[:-1]
        lead, group = np.flatnonzero(head), np.cumsum(head) - 1
        differs = (ids != ids[lead][group]) | (starts != starts[lead][group]) if len(lead) else head
        out = differs
        if not last and len(lead):
            again = np.zeros(len(lead), bool)
            again[group[differs]] = True
            out = again[group] & (starts >= 0)
        return pa.Table.from_batches([_runs(np.concatenate([ids[out], sure_ids]), np.concatenate([starts[out], sure_starts]))])

    return compare


def _by_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list(F.struct("run_start", "run_stop")).alias("hits"))


def _slim(docs: DataFrame) -> DataFrame:
    """(owner, doc_id, text): ``doc_id`` tells documents apart, ``owner`` is the id they came with.

    Both are the same where no two texts share an id.  Otherwise documents are
    numbered in the order of id and text hash, range by range.
    """
    text_hash = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).cast("long").alias("owner"), "text")
    hashed = rows.select("owner", text_hash.alias("h")).where("h IS NOT NULL")
    shared = hashed.groupBy("owner").agg((F.min("h") != F.max("h")).alias("several")).where("several")
    if shared.isEmpty():
        return rows.select("owner", F.col("owner").alias("doc_id"), "text")
    names = hashed.distinct().repartitionByRange("owner", "h").sortWithinPartitions("owner", "h")
    names = cut(names.withColumn("part", F.spark_partition_id()))
    sizes = names.groupBy(F.col("part").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    nth = F.row_number().over(Window.partitionBy("part").orderBy("owner", "h"))
    numbered = names.withColumn("nth", nth).join(sizes.select("of", before.alias("start")), F.col("part") == F.col("of"))
    numbered = cut(numbered.select(F.col("owner").alias("o"), F.col("h").alias("oh"), (F.col("start") + F.col("nth")).cast("long").alias("doc_id")))
    known = rows.withColumn("h", text_hash).join(numbered, (F.col("owner") == F.col("o")) & (F.col("h") == F.col("oh")), "left")
    return known.select("owner", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "text")  # 0: no text


def repeated(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, ranges: int | None = None) -> DataFrame:
    """Runs of starts of windows whose words also start earlier: (doc_id, run_start, run_stop)."""
    rows = _slim(docs)
    runs = _repeated(rows, window, seed, ranges).withColumnRenamed("doc_id", "hit_id")
    owners = rows.select("owner", "doc_id").distinct()
    back = owners.join(runs, F.col("doc_id") == F.col("hit_id"))
    return back.select(F.when(F.col("owner") != NULL_ID, F.col("owner")).alias("doc_id"), "run_start", "run_stop")


def _repeated(rows: DataFrame, window: int, seed: int, ranges: int | None = None) -> DataFrame:
    if window % seed or (window // seed) & (window // seed - 1):
        raise ValueError("the window must be the seed length doubled some times")
    spark = rows.sparkSession
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)
    rows = rows.select("doc_id", "text")
    length, runs = seed, None
    while True:
        last = length == window
        source = rows
        if runs is not None:
            source = rows.join(_by_document(runs), F.col("doc_id") == F.col("hit_id")).select("doc_id", "text", "hits")
        packed = source.mapInArrow(_packed(seed, length, last, ranges), PACKED)
        runs = packed.groupBy("range_no").applyInArrow(_compared(last), RUNS)
        if last:
            return runs
        runs = cut(runs)
        if runs.isEmpty():
            return runs
        length *= 2


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every document."""
    rows = _slim(docs)
    marked = rows.join(_by_document(_repeated(rows, window, seed)), F.col("doc_id") == F.col("hit_id"), "left").select("owner", "text", "hits")

    def remove(batches):
        for batch in batches:
            out = []
            for text, hits in zip(batch.column("text"), batch.column("hits")):
                parts = text.as_buffer().to_pybytes().split() if text.is_valid else []
                kept = parts
                if hits.is_valid:
                    edge = np.zeros(len(parts) + 1, np.int64)
                    for run in hits.as_py():
                        if run["run_start"] < len(parts):
                            edge[run["run_start"]] += 1
                            edge[min(run["run_stop"] - 1 + window, len(parts))] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(parts, gone.tolist()) if not g]
                out.append((len(parts), len(parts) - len(kept), b" ".join(kept)))
            n, r, k = zip(*out) if out else ([], [], [])
            ids = [None if x == NULL_ID else x for x in batch.column("owner").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return marked.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")

"""Quality rules: boosted trees over document statistics.

Statistics are counted over whole texts in numpy, one pass per Arrow batch.
The trees are grown on binned statistics of a bounded labelled sample
(``SAMPLE_ROWS``); splits on features with a declared direction are kept
monotonic by bounds on the leaf values.  A fitted model is three node arrays
of complete binary trees, so scoring is one gather per level for all rows.

Defined results: a NULL or empty text has zero counts and fails the base rule;
repeated rows are scored alike; an empty table gives an empty result; without
both classes among the labels every document that passes the base rule is
kept.  Other columns are passed on untouched by ``keep_good``.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_ledger.llm import words as W
from cohort_ledger.llm.samples import sample_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 8_000  #: labelled documents at most used to grow the trees
KEEP_FROM = 0.3  #: a document stays if its probability of good quality is this or more
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features and the direction in which the score may move with each (0: any).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "marks_per_word": -1, "distinct_share": 0, "same_as_last": -1, "digit_share": 0,
}


def _count(texts: W.Texts, mask: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[texts.bounds[1:]] - total[texts.bounds[:-1]]


def _again(doc: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: is it equal to another of its document, and to an earlier one?"""
    key = W.joined(doc.astype(np.uint64), hashed)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return any_other, later


def statistics(texts: W.Texts) -> dict[str, np.ndarray]:
    """Counts of each document of a slice."""
    n, data = texts.n, texts.data
    spans = W.words(texts, W.word_table("blank"))
    doc, per = spans.doc(), spans.per_doc
    hashed = W.hashes(texts, spans)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[spans.start] += 1
    inside[spans.end] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    by_doc = lambda mask: np.bincount(doc, mask, n).astype(np.int64)

    starts = W.window_starts(spans, 3)
    covered = np.zeros(len(doc), bool)
    if len(starts):
        repeated = starts[_again(doc[starts], W.window_hashes(hashed, 3)[starts])[0]]
        for k in range(3):
            covered[repeated + k] = True

    rows = W.lines(texts)
    line_doc = rows.doc()
    wordy = np.searchsorted(spans.start, rows.end) > np.searchsorted(spans.start, rows.start)
    repeated_lines = _again(line_doc, W.hashes(texts, rows))[1] & wordy

    same = np.zeros(len(doc), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    return {
        "n_words": per.astype(np.int64),
        "word_chars": _count(texts, inside & ((data & 0xC0) != 0x80)),
        "n_symbols": _count(texts, np.isin(data, np.frombuffer(SYMBOLS, np.uint8))),
        "n_dup_lines": np.bincount(line_doc, repeated_lines, n).astype(np.int64),
        "n_repeat_words": by_doc(covered),
        "n_lines": rows.per_doc.astype(np.int64),
        "n_upper": _count(texts, (data >= 65) & (data <= 90)),
        "n_marks": _count(texts, (data == 33) | (data == 63)),
        "n_digits": _count(texts, (data >= 48) & (data <= 57)),
        "n_distinct": per - by_doc(_again(doc, hashed)[1]),
        "n_same": by_doc(same),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of features for each document; shares of nothing are 0."""
    w, c = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / w, s["n_symbols"] / w, s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / w, s["n_upper"] / c, s["n_marks"] / w, s["n_distinct"] / w, s["n_same"] / w, s["n_digits"] / c,
    ])


@dataclass
class Trees:
    """Complete binary trees of one depth: (tree, node) arrays in heap order."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the upper class for each row."""
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            while inner and (at < inner).all() and len(at):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - inner]
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 2.0, least: float = 3.0) -> Trees:
    """Boosted trees for 0/1 targets ``y``; each feature's direction is held in every tree."""
    inner = 2**depth - 1
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        model.leaf[:] = 0
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    margin = np.full(len(y), model.prior)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
            found = _split(code[mine], slope[mine], curve[mine], cuts, direction, low[at], high[at], ridge, least)
            right = np.zeros(len(mine), bool)
            if found:
                f, k, middle = found
                model.feature[t, at], model.threshold[t, at] = f, cuts[f][k]
                right = code[mine, f] > k
                if direction[f]:
                    upper, lower = (2 * at + 2, 2 * at + 1) if direction[f] > 0 else (2 * at + 1, 2 * at + 2)
                    low[upper], high[lower] = max(low[upper], middle), min(high[lower], middle)
            node[mine] = 2 * at + 1 + right
        g, h = np.bincount(node - inner, slope, inner + 1), np.bincount(node - inner, curve, inner + 1)
        model.leaf[t] = rate * np.clip(-g / (h + ridge), low[inner:], high[inner:])
        margin += model.leaf[t][node - inner]
    return model


def _split(code, slope, curve, cuts, direction, low, high, ridge, least):
    """The best allowed split of a node as (feature, bin, middle of both values), or None."""
    best, found = 1e-6, None
    total_g, total_h = slope.sum(), curve.sum()
    value = lambda g, h: np.clip(-g / (h + ridge), low, high)
    gain = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
    whole = gain(total_g, total_h, value(total_g, total_h))
    for f, cut in enumerate(cuts):
        if not len(cut) or not len(code):
            continue
        g = np.cumsum(np.bincount(code[:, f], slope, len(cut) + 1))[:-1]
        h = np.cumsum(np.bincount(code[:, f], curve, len(cut) + 1))[:-1]
        left, right = value(g, h), value(total_g - g, total_h - h)
        better = gain(g, h, left) + gain(total_g - g, total_h - h, right) - whole
        better[(h < least) | (total_h - h < least) | (direction[f] * (right - left) < 0)] = 0
        k = int(np.argmax(better))
        if better[k] > best:
            best, found = better[k], (f, k, (left[k] + right[k]) / 2)
    return found


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Trees:
    """Grow the trees on at most ``bound`` labelled documents outside fold 0."""
    names = [f"f{i}" for i in range(len(FEATURES))]

    def measure(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                x = features(statistics(texts))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(texts.rows.start, texts.n), batch.column("doc_id").slice(texts.rows.start, texts.n), *map(pa.array, x.T)], names=["label", "doc_id", *names])

    sample = sample_of(docs, labels, F.col("quality").cast("int"), bound)
    got = sample.mapInArrow(measure, "label int, doc_id long, " + ", ".join(f"{n} double" for n in names)).toPandas().sort_values(["doc_id", *names])
    return grow(got[names].to_numpy(), got["label"].to_numpy(float), list(FEATURES.values()))


def judge(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, base counts, base_failed, score, kept) of every document."""

    def measure(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                s = statistics(texts)
                failed, score = base_failed(s), model.score(features(s))
                columns = [batch.column("doc_id").slice(texts.rows.start, texts.n), *(pa.array(s[n], pa.int64()) for n in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_from))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, model: Trees, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    at = docs.columns.index("text")

    def choose(batches):
        for batch in batches:
            kept = []
            for texts in W.slices(batch.column(at)):
                s = statistics(texts)
                kept.append(~base_failed(s) & (model.score(features(s)) >= keep_from))
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(choose, docs.schema)

"""Mixing to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on at most ``SAMPLE_ROWS`` rows
of a labelled table, gives every document its posterior over the domains.  A
document of n words adds ``rate * n * posterior`` to the expected words of each
domain.  Rates of ``least`` or more are fitted by projected-gradient least
squares, so that these totals meet the targets, starting from 1 for all.  They
have no upper bound unless ``most`` is given: a scarce domain is repeated as
often as its target asks.  ``balance`` lists the wanted and the reached words.

A step moves each rate against the gradient, ``posterior . g``, and projects it
back; rates of long and short documents move alike.  Steps are scaled by the
inverse of the domains' Gram matrix over the documents whose rates are free to
move.  Some fractions of such a step and a plain gradient step are tried in one
job, and the closest is taken, so that a step never leads away, and targets that
no rates can meet are come closest to by the sum of squares.  Only sums for each
domain and pair of domains reach the driver, and a rate is a function of the
posterior and of the g of all steps, so no rates are written between steps.

A rate becomes whole copies: its integer part, and one more with its fraction
as probability, drawn by a hash of the id.

Defined results: a NULL or empty text has no words, the posterior of the empty
text, no part in the totals, and the rate 1 (or the bound next to it); without labels the posterior is even; targets
are scaled to sum to 1; repeated rows get equal rates and equal draws; an empty
table gives an empty result; ``mixed`` passes all columns on.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_ledger.llm import words as W
from cohort_ledger.llm.samples import sample_of
from cohort_ledger.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
SAMPLE_ROWS = 4_000  #: labelled documents at most used to fit the classifier
STEPS, CLOSE = 40, 1e-7
SCALES = (1.0, 0.25, 0.0625)
SEED = 20_260_102


def word_counts(texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document, and (document, bucket, times) of its distinct hashed words."""
    spans = W.words(texts, W.word_table("blank"))
    bucket = (W.hashes(texts, spans) % np.uint64(BUCKETS)).astype(np.int64)
    key, times = np.unique(spans.doc() * BUCKETS + bucket, return_counts=True)
    return spans.per_doc, key // BUCKETS, key % BUCKETS, times


def _weights(n_docs: int, doc: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Damped counts, scaled by the fourth root of a document's distinct words."""
    size = np.bincount(doc, minlength=n_docs)
    return (1 + np.log(times)) / np.maximum(size, 1)[doc] ** 0.25


@dataclass
class Softmax:
    weight: np.ndarray  #: (bucket, domain)
    offset: np.ndarray

    def posteriors(self, n_docs: int, doc: np.ndarray, bucket: np.ndarray, times: np.ndarray) -> np.ndarray:
        x = _weights(n_docs, doc, times)
        z = np.stack([np.bincount(doc, x * self.weight[bucket, d], n_docs) for d in range(len(self.offset))], axis=1) + self.offset
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(n_docs: int, doc: np.ndarray, bucket: np.ndarray, times: np.ndarray, domain: np.ndarray, domains: int, steps: int = 80, ridge: float = 2e-4) -> Softmax:
    """Softmax regression by Adam on all sample rows at once."""
    model = Softmax(np.zeros((BUCKETS, domains)), np.zeros(domains))
    if not n_docs:
        return model
    x, goal = _weights(n_docs, doc, times), np.eye(domains)[domain]
    model.offset = np.log(goal.mean(axis=0) + 1e-3)
    m = v = 0.0
    for step in range(1, steps + 1):
        error = (model.posteriors(n_docs, doc, bucket, times) - goal) / n_docs
        g = np.stack([np.bincount(bucket, x * error[doc, d], BUCKETS) for d in range(domains)], axis=1) + ridge * model.weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        model.weight -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        model.offset -= 0.5 * error.sum(axis=0)
    return model


def fit(docs: DataFrame, labels: DataFrame, domain: Column, domains: int, bound: int = SAMPLE_ROWS) -> Softmax:
    """Fit the classifier; ``domain`` is a column of ``labels``, 0 up to ``domains`` - 1."""

    def count(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                _, doc, bucket, times = word_counts(texts)
                cuts = np.searchsorted(doc, np.arange(texts.n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (bucket, times)]
                part = slice(texts.rows.start, texts.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("label")[part], *lists], names=["doc_id", "label", "bucket", "times"])

    sample = sample_of(docs, labels, domain.cast("int"), bound)
    got = sample.mapInArrow(count, "doc_id long, label int, bucket array<int>, times array<int>").toPandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)
    if not len(got):
        return train(0, *[np.zeros(0, np.int64)] * 4, domains)
    doc = np.repeat(np.arange(len(got)), got["bucket"].map(len))
    joined = lambda c: np.concatenate(got[c].to_list()).astype(np.int64)
    return train(len(got), doc, joined("bucket"), joined("times"), got["label"].to_numpy(), domains)


def posteriors(docs: DataFrame, model: Softmax, *keep: str) -> DataFrame:
    """(doc_id, kept columns, n_words, posterior) of every document."""
    columns = ["doc_id", *keep]

    def run(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                n, *found = word_counts(texts)
                p = model.posteriors(texts.n, *found)
                part = slice(texts.rows.start, texts.rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[part] for c in columns), pa.array(n.astype(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))],
                    names=[*columns, "n_words", "posterior"],
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, "text").mapInArrow(run, f"{kept}, n_words long, posterior array<double>")


def _dot(p: Column, g: Column, k: int) -> Column:
    total = F.lit(0.0)
    for d in range(k):
        total = total + F.get(p, F.lit(d)) * F.get(g, F.lit(d))
    return total


def _table(rows: list[list[float]]) -> Column:
    """A constant list of lists.

    Walked by a lambda, it is not spelled out in the generated code, so every
    step's jobs share their code, and a rate of many steps is no longer to write
    down than one of few.
    """
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


def fit_rates(soft: DataFrame, targets: list[float], total: float | None = None, least: float = 0.0, most: float | None = None, steps: int = STEPS) -> Column:
    """The rate of each row of (n_words, posterior) as a column.

    ``targets`` are the shares of the domains and ``total`` the expected words
    of the mixture: those of the input if not given, and the fewest that need
    no rate below 1 if ``least`` is 1 or more.  Where no rates within the bounds
    meet the targets, those that come closest are found.
    """
    share = np.asarray(targets, float) / sum(targets)
    k = len(share)
    words = lambda d: F.col("n_words") * F.col("posterior")[d]
    bounded = lambda rate: rate if most is None else F.least(F.lit(float(most)), rate)
    row = soft.agg(*[F.sum(words(d)) for d in range(k)], *[F.sum(words(d) * F.col("posterior")[e]) for d in range(k) for e in range(k)]).first()
    have = np.array([x or 0.0 for x in row[:k]])
    gram = np.array([x or 0.0 for x in row[k:]]).reshape(k, k)
    if total is None:
        total = have.sum()
        if least >= 1:
            total = max([total, *(h / s for h, s in zip(have, share) if s > 0)])
    goal = share * total
    held = lambda rate: bounded(F.greatest(F.lit(float(least)), rate))
    moved = lambda rate, g: held(rate - _dot(F.col("posterior"), g, k))
    taken, sums = [], have

    def rate() -> Column:
        return F.aggregate(_table(taken), F.lit(1.0), moved) if taken else F.lit(1.0)

    for step in range(steps):
        off = sums - goal
        if np.abs(off).max() <= CLOSE * max(total, 1.0):
            break
        if step or least >= 1 or (most is not None and most <= 1):
            at = soft.select("n_words", "posterior", rate().alias("at"), F.transform(_table([off.tolist()]), lambda g: _dot(F.col("posterior"), g, k))[0].alias("down"))
            free = (F.col("at") > float(least)) | (F.col("down") < 0)
            if most is not None:
                free = free & ((F.col("at") < float(most)) | (F.col("down") > 0))
            pairs = [F.sum(words(d) * F.col("posterior")[e]) for d in range(k) for e in range(k)]
            loose = np.array([x or 0.0 for x in at.where(free).agg(*pairs).first()]).reshape(k, k)
        else:
            loose = gram
        moves = [scale * np.linalg.pinv(loose, rcond=1e-9) @ off for scale in SCALES] + [off / np.linalg.eigvalsh(gram)[-1]]
        moves = [[float(f"{x:.9g}") for x in g] for g in moves]  # rounded, so that the order of sums does not show
        at = soft.select("n_words", "posterior", rate().alias("at"))
        tried = at.select("n_words", "posterior", F.transform(_table(moves), lambda g: moved(F.col("at"), g)).alias("tried"))
        row = tried.agg(*[F.sum(words(d) * F.col("tried")[i]) for i in range(len(moves)) for d in range(k)]).first()
        found = np.array([x or 0.0 for x in row]).reshape(len(moves), k)
        left = np.linalg.norm(found - goal, axis=1)
        best = int(np.argmin(left))
        if left[best] > (1 - CLOSE) * np.linalg.norm(off):
            break
        taken.append(moves[best])
        sums = found[best]
    return F.when(F.col("n_words") > 0, rate()).otherwise(held(F.lit(1.0)))


def balance(rated: DataFrame, targets: list[float]) -> DataFrame:
    """(domain, wanted, reached, drawn): shares of the words in rows of ``rates``, by rate and by whole copies."""
    each = rated.select("n_words", F.posexplode("posterior").alias("domain", "p"), "rate", "copies")
    words = lambda times: F.sum(F.col("n_words") * F.col("p") * F.col(times))
    sums = each.groupBy("domain").agg(words("rate").alias("by_rate"), words("copies").alias("by_copies"))
    wanted = F.get(F.array(*[F.lit(float(t) / sum(targets)) for t in targets]), F.col("domain"))
    whole = lambda part: F.sum(part).over(Window.partitionBy(F.lit(0)))  # noqa: E731; a row for each domain
    share = lambda part: F.when(whole(part) > 0, F.col(part) / whole(part))
    return sums.select("domain", wanted.alias("wanted"), share("by_rate").alias("reached"), share("by_copies").alias("drawn"))


def copies(rate: Column, seed: int = SEED) -> Column:
    """Whole copies of a rate: the fraction decides by a hash of doc_id."""
    even = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) * F.lit(2.0**-53)
    return F.floor(rate + even).cast("int")


def rates(docs: DataFrame, model: Softmax, targets: list[float], total: float | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """(doc_id, n_words, posterior, rate, copies) of every document."""
    soft = cut(posteriors(docs, model))
    rate = fit_rates(soft, targets, total, least, most)
    return soft.withColumn("rate", rate).withColumn("copies", copies(F.col("rate")))


def mixed(docs: DataFrame, model: Softmax, targets: list[float], total: float | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """The rows of ``docs`` as often as their copies say, with all their columns."""
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id"), F.col("text"))
    soft = cut(posteriors(plain, model, *[f"c{i}" for i in range(len(docs.columns))]))
    times = copies(fit_rates(soft, targets, total, least, most))
    repeated = soft.withColumn("again", F.explode(F.sequence(F.lit(1), times))) if least >= 1 else soft.withColumn("again", F.explode(F.array_repeat(F.lit(0), times)))
    return repeated.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])

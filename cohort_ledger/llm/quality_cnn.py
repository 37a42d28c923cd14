"""Quality classifier: a byte-level convolutional network in numpy.

Each byte has a learned vector; ``FILTERS`` filters of ``WIDTH`` bytes slide
over the whole document.  A document is cut into overlapping chunks of
``CHUNK`` bytes, one every half chunk.  In each chunk every filter keeps its
largest response (max-pooling); a document's features are the mean and the
largest of its chunks' values, and a logistic layer combines them into one
probability.  Embedding and filter are multiplied out beforehand, so a response
is the sum of ``WIDTH`` table look-ups.

Trained by Adam on at most ``SAMPLE_ROWS`` labelled documents outside fold 0,
of which a training step sees up to ``TRAIN_CHUNKS`` chunks each, drawn anew
from the whole text; scoring always reads every byte.  Only the position that
won a pool passes on a gradient.

Defined results: a NULL or empty text has one chunk without bytes and the score
that the output layer gives to it; texts shorter than a filter are padded with
zero bytes; repeated rows get equal scores; without both classes among the
labels every score is their share (0.5 without labels); an empty table gives an
empty result; other columns are not read.
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
from cohort_ledger.llm.samples import fold, sample_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, FILTERS, VECTOR = 8, 16, 8
CHUNK = 512
LONG_BYTES = 1 << 18  #: positions whose responses are held at a time in a long document
SAMPLE_ROWS, SAMPLE_BYTES, TRAIN_CHUNKS = 3_000, 16_384, 4
EPOCHS, BATCH, RATE = 14, 64, 0.01
CUT = 0.3


@dataclass
class Network:
    table: np.ndarray  #: (WIDTH, 256, FILTERS): what a byte at a place of the filter adds
    bias: np.ndarray
    output: np.ndarray  #: for mean and largest of the chunks
    offset: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at each position of bytes padded by ``WIDTH - 1``."""
        n = len(data) - WIDTH + 1
        out = np.repeat(self.bias[None, :], n, axis=0)
        for k in range(WIDTH):
            out += self.table[k].take(data[k : k + n], axis=0)
        return np.maximum(out, 0, out=out)

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Largest responses in each half chunk of one document, worked out ``LONG_BYTES`` at a time."""
        half, n = CHUNK // 2, len(data)
        out = []
        for start in range(0, n, LONG_BYTES):
            stop = start + LONG_BYTES if start + LONG_BYTES < n else n + 1
            part = data[start : stop + WIDTH - 1]
            part = np.concatenate([part, np.zeros(stop - start + WIDTH - 1 - len(part), np.uint8)])
            blocks = -(-(min(stop, n) - start) // half)
            out.append(np.maximum.reduceat(self.responses(part), np.arange(blocks) * half, axis=0))
        return np.concatenate(out)

    def features(self, texts: W.Texts) -> np.ndarray:
        """Mean and largest chunk value of each filter for every document of a slice."""
        half = CHUNK // 2
        size = np.diff(texts.bounds)
        blocks = np.maximum(-(-size // half), 1)
        first = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(texts.n), blocks)
        if texts.n == 1 and size[0] > LONG_BYTES:
            return self._combined(self.pooled(texts.data), first, owner, blocks)
        # Every document is followed by zero bytes, so that filters do not reach into the next.
        padded = np.zeros(len(texts.data) + texts.n * (WIDTH - 1) + texts.n, np.uint8)
        starts = texts.bounds[:-1] + np.arange(texts.n) * WIDTH
        doc = np.repeat(np.arange(texts.n), size)
        padded[np.arange(len(texts.data)) + doc * WIDTH] = texts.data
        response = self.responses(np.concatenate([padded, np.zeros(WIDTH - 1, np.uint8)]))
        beyond = (starts + size)[:, None] + np.arange(1, WIDTH)  # these would see the next document
        response[beyond.ravel()] = 0
        at = starts[owner] + (np.arange(len(owner)) - first[owner]) * half
        return self._combined(np.maximum.reduceat(response, at, axis=0), first, owner, blocks)

    @staticmethod
    def _combined(pooled: np.ndarray, first: np.ndarray, owner: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        last = np.zeros(len(owner), bool)
        last[first[1:] - 1] = True
        chunk = np.where(last[:, None], pooled, np.maximum(pooled, np.concatenate([pooled[1:], pooled[-1:]])))
        lone = blocks > 1  # the last half chunk is within the one before
        counted = ~(last & lone[owner])
        mean = np.add.reduceat(np.where(counted[:, None], chunk, 0), first[:-1], axis=0) / (blocks - lone)[:, None]
        return np.concatenate([mean, np.maximum.reduceat(chunk, first[:-1], axis=0)], axis=1)

    def score(self, texts: W.Texts) -> np.ndarray:
        z = self.features(texts) @ self.output + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Network:
    """Fit the network to 0/1 labels."""
    draw = np.random.default_rng(seed)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    p = {
        "vector": draw.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
        "filter": draw.normal(0, (WIDTH * VECTOR) ** -0.5 * 2, (WIDTH, VECTOR, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "output": draw.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "offset": np.full(1, np.log(share / (1 - share)), np.float32),
    }
    closed = lambda: Network(np.einsum("bv,kvf->kbf", p["vector"], p["filter"]), p["bias"], p["output"], float(p["offset"][0]))
    if not len(labels) or labels.min() == labels.max():
        p["output"][:] = 0
        return closed()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    reach = CHUNK + WIDTH - 1
    for epoch in range(EPOCHS):
        for rows in np.array_split(draw.permutation(len(texts)), max(1, len(texts) // BATCH)):
            step += 1
            chunks, owner = [], []
            for i, r in enumerate(rows):
                n = max(1, -(-(len(texts[r]) - CHUNK) // (CHUNK // 2)) + 1)
                for c in draw.permutation(n)[:TRAIN_CHUNKS]:
                    part = texts[r][c * CHUNK // 2 : c * CHUNK // 2 + CHUNK]
                    chunks.append(np.frombuffer(part.ljust(reach, b"\0"), np.uint8))
                    owner.append(i)
            data, owner = np.stack(chunks), np.asarray(owner)
            net = closed()
            out = np.repeat(net.bias[None, None, :], CHUNK, axis=1) + net.table[0].take(data[:, :CHUNK], axis=0)
            for k in range(1, WIDTH):
                out += net.table[k].take(data[:, k : k + CHUNK], axis=0)
            best = out.argmax(axis=1)  # (chunk, filter)
            value = np.maximum(np.take_along_axis(out, best[:, None, :], axis=1)[:, 0], 0)
            count = np.bincount(owner, minlength=len(rows))
            first_of = np.concatenate([[0], np.cumsum(count)[:-1]])
            mean = np.add.reduceat(value, first_of, axis=0) / count[:, None]
            top = np.maximum.reduceat(value, first_of, axis=0)
            features = np.concatenate([mean, top], axis=1)
            z = features @ p["output"] + p["offset"][0]
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g = {"output": features.T @ error + 1e-4 * p["output"], "offset": error.sum(keepdims=True)}
            back = error[:, None] * p["output"][None, :]
            d_value = back[owner, :FILTERS] / count[owner][:, None] + back[owner, FILTERS:] * (value == top[owner])
            d_value = np.where(value > 0, d_value, 0).astype(np.float32)
            g["bias"] = d_value.sum(axis=0)
            g["vector"], g["filter"] = np.zeros_like(p["vector"]), np.zeros_like(p["filter"])
            for k in range(WIDTH):
                seen = np.take_along_axis(data, best + k, axis=1)  # (chunk, filter): the winning byte at place k
                g["filter"][k] = np.einsum("cfv,cf->vf", p["vector"][seen], d_value)
                np.add.at(g["vector"], seen, d_value[:, :, None] * p["filter"][k].T[None])
            for name in p:
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.99 * second[name] + 0.01 * g[name] ** 2
                rate = RATE * (1 - epoch / EPOCHS) + 1e-4
                p[name] = (p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    # Weighted classes shift the odds; undo it so that the score is a probability.
    p["offset"] = p["offset"] + np.float32(np.log(share / (1 - share)))
    return closed()


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Network:
    """Train on at most ``bound`` labelled documents outside fold 0.

    Of a sample text longer than ``SAMPLE_BYTES`` only pieces are sent to the
    driver: ``SAMPLE_BYTES`` in all, spread evenly over the text.
    """
    sample = sample_of(docs, labels, F.col("quality").cast("int"), bound)

    def thinned(batches):
        for batch in batches:
            out = []
            for x in batch.column("text"):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                if len(raw) > SAMPLE_BYTES:
                    n = SAMPLE_BYTES // CHUNK
                    raw = b"".join(raw[int(s) : int(s) + CHUNK] for s in np.linspace(0, len(raw) - CHUNK, n))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(out, pa.binary())], names=["doc_id", "label", "raw"])

    rows = sorted((r.doc_id, r.label, bytes(r.raw)) for r in sample.mapInArrow(thinned, "doc_id long, label int, raw binary").collect())
    return train([r[2] for r in rows], np.array([r[1] for r in rows], float))


def score(docs: DataFrame, network: Network, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text"), 500_000):
                value = network.score(texts)
                part = slice(texts.rows.start, texts.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[part], batch.column("held_out")[part], pa.array(value), pa.array((value >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (fold() == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

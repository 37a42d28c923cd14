"""Words, lines and windows of Arrow text columns as numpy arrays.

Functions here run inside tasks, on the Arrow batches that Spark hands out.
Texts are cut into slices of a few MB, and every step is one numpy call over
all documents of a slice.  A word is known by a 64-bit hash of its bytes: a
random value for each byte, weighted by a power of an odd number, summed and
mixed.  A document is never split, so memory is bounded by the slice or, where
one document is longer, by that document (about 60 bytes for each of its own).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 2_000_000

#: White space that ends a word, and ASCII characters that are no part of a term.
BLANKS = b" \t\n\x0b\x0c\r"
_LETTER = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))

#: The same two kinds of word as patterns for Spark's functions.
BLANK_PATTERN = r"[\x20\x09-\x0D]+"
TERM_GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all its bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """Another spread of the values for each seed."""
    with np.errstate(over="ignore"):
        return mixed(x + _STEP * np.uint64(2 * seed + 1))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit values as numbers above 0 and up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def word_table(kind: str) -> np.ndarray:
    """256 booleans: the bytes that belong to a word; ``blank`` (split at white space) or ``term``."""
    table = np.zeros(256, bool)
    if kind == "term":
        table[list(_LETTER)] = True
    else:
        table[:] = True
        table[list(BLANKS)] = False
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@dataclass
class Texts:
    """Bytes of some documents in a row; ``bounds[i]:bounds[i + 1]`` is document i."""

    data: np.ndarray
    bounds: np.ndarray
    rows: slice  #: their rows in the batch
    valid: np.ndarray  #: False where the text is NULL

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of all documents of a slice; ``first[i]:first[i + 1]`` are those of document i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)


def slices(column, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """A string or binary Arrow column in slices of about ``limit`` bytes; NULL is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from slices(chunk, limit)
        return
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    valid = np.asarray(column.is_valid())
    if not valid.all():  # a NULL may cover bytes
        column = pa.array([x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()], pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[: n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(max(stop, at + 1), n)
        yield Texts(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], slice(at, stop), valid[at:stop])
        at = stop


def words(texts: Texts, inside: np.ndarray) -> Words:
    """Longest runs of bytes for which ``inside`` holds, within one document."""
    mask = inside[texts.data]
    n = len(mask)
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    cuts = texts.bounds[:-1]
    before[cuts[cuts < n]] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    ends = texts.bounds[1:]
    after[ends[ends > 0] - 1] = False
    end = np.flatnonzero(mask & ~after) + 1
    return Words(start, end, np.searchsorted(start, texts.bounds))


def lines(texts: Texts) -> Words:
    """Lines between newlines: a document of n newlines has n + 1, and NULL has none."""
    breaks = np.flatnonzero(texts.data == 10)
    live = texts.valid
    start = np.sort(np.concatenate([breaks + 1, texts.bounds[:-1][live]]), kind="stable")
    end = np.sort(np.concatenate([breaks, texts.bounds[1:][live]]), kind="stable")
    count = np.searchsorted(breaks, texts.bounds[1:]) - np.searchsorted(breaks, texts.bounds[:-1]) + live
    return Words(start, end, np.concatenate([[0], np.cumsum(np.where(live, count, 0))]))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base = 0xD1342543DE82EF95
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n + 1, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def hashes(texts: Texts, spans: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)
    if lower:
        values = values[_lower_table()]
    power, inverse = _powers(len(texts.data))
    total = np.zeros(len(texts.data) + 1, np.uint64)
    np.cumsum(values[texts.data] * power[:-1], dtype=np.uint64, out=total[1:])
    return mixed((total[spans.end] - total[spans.start]) * inverse[spans.start])


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash for each pair of hashes, in which order counts."""
    return mixed(a * np.uint64(0xA24BAED4963EE407) + b * np.uint64(0x9FB21C651E98DF25) + _STEP)


def window_starts(spans: Words, size: int) -> np.ndarray:
    """Indexes of the words at which a window of ``size`` words of one document starts."""
    if not len(spans.start):
        return np.zeros(0, np.int64)
    left = np.repeat(spans.first[1:], spans.per_doc) - np.arange(len(spans.start))
    return np.flatnonzero(left >= size)


def window_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` hashes from each index on; the last ``size - 1`` indexes have none."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0xA24BAED4963EE407)
    for k in range(size):
        out = out * factor + hashed[k : k + n]
    return mixed(out)

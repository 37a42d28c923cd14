"""Token-id output: one compressed frame per document with a shared dictionary.

Format.  A block is one row of a Parquet table: ``part`` and ``block`` give its
place, ``first_id`` and ``last_id`` the ids it covers, ``n_docs``,
``n_tokens`` and ``start_in_part`` its counts, and ``payload`` its bytes::

    magic "IDZB0001" | SHA-256 of the dictionary, 32 bytes | bytes per id, u4 | documents n, u4
    | doc_id, i8 x n | frame offsets, u8 x (n + 1) | token counts, u8 x n | frames

Each frame is one document's ids, little-endian, compressed by zstandard with
the dictionary, so a short document is read by one offset and one frame.  The
dictionary is a table of one row beside the blocks.  It is trained on ids of a
bounded sample (``DICTIONARY_DOCS`` ids with a text of up to ``DICTIONARY_CHARS``
characters each, ``PIECE_IDS`` ids a piece).

Documents stand in ascending doc_id order: ranges of ids are sorted in
parallel, and ``start`` is the sum of earlier ranges (one row each) plus the
count within the range.  Encoding looks words up in a bounded table of words
seen; that gives the ids of the whole text, for the tokenizer never joins what
white space parts.

Defined results: a NULL or empty text is the end id alone; repeated rows are
written as often as they come, equal ids in the order of their texts, each with
its own start; a NULL doc_id stands first; an empty table gives no block.
"""

from __future__ import annotations

import gc
import hashlib
import operator
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_ledger.session import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"IDZB0001"
DICTIONARY_DOCS, DICTIONARY_CHARS, DICTIONARY_BYTES, PIECE_IDS = 400, 32_768, 65_536, 2_048
BLOCK_IDS = 1_000_000  #: a block ends at this many ids
BATCH_BYTES = 8_000_000  #: text whose new words are encoded in one call
KNOWN_WORDS = 1_000_000  #: a worker that remembers more begins anew with its next batch
LEVEL = 3
NO_ID = -(2**63)  #: stands for a NULL doc_id in the index
BLOCKS = "part int, block int, first_id long, last_id long, n_docs long, n_tokens long, start_in_part long, payload binary"


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Known(dict):
    """Ids by word; a word that is not there gets an empty place, noted in ``missed``, to be filled later."""

    def __init__(self):
        self.missed: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        place = self[word] = self.missed[word] = bytearray()
        return place


class _Worker:
    """The tokenizer of this process and the ids of words it has seen, as bytes; kept between tasks.

    A word of Latin letters with marks behind it is two pieces for a tokenizer
    that ends each with ``</w>``; letters then are encoded many at a time, and
    the ids are parted at those ends.  All other words are encoded one by one.
    """

    def __init__(self, tokenizer: str, width: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.key, self.kind = (tokenizer, width), f"<u{width}"
        self.tool = Tokenizer.from_file(tokenizer)
        self.known = _Known()
        self.parts: dict[str, bytes] = {}
        size = self.tool.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tool.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        lower = self.tool.encode("Ab", add_special_tokens=False).ids == self.tool.encode("ab", add_special_tokens=False).ids
        self.parts_words = bool(self.ends.any()) and lower

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4_096):
            part = texts[at : at + 4_096]
            groups = [part[i : i + 64] for i in range(0, len(part), 64)]
            for group, e in zip(groups, self.tool.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.asarray(e.ids, self.kind)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(group):
                    out += self._plain(group)
                    continue
                raw, w, a = ids.tobytes(), ids.itemsize, 0
                for b in cuts.tolist():
                    out.append(raw[a * w : b * w])
                    a = b
        return out

    def learn(self, words: list[bytes]) -> None:
        """Ids of words not seen before."""
        from unicodedata import is_normalized

        odd, whole, cores, tails = [], [], [], []
        for w in words:
            if self.parts_words and w.isalpha():  # ASCII letters alone
                whole.append(w)
                cores.append(w.decode().lower())
                tails.append("")
                continue
            text = w.decode().lower() if self.parts_words else ""
            core = text.rstrip(_MARKS)
            if core and core.isalpha() and (core.isascii() or max(core) < "\u0250" and is_normalized("NFC", core)):
                whole.append(w)
                cores.append(core)
                tails.append(text[len(core) :])
            else:
                odd.append(w)
        fresh = list(set(cores) - self.parts.keys())
        self.parts.update(zip(fresh, self._letters(fresh)))
        marks = [t for t in set(tails) - self.parts.keys() if t]
        self.parts.update(zip(marks, self._plain(marks)))
        self.parts[""] = b""
        find = self.parts.__getitem__
        self.known.update(zip(whole, map(operator.add, map(find, cores), map(find, tails))))
        self.known.update(zip(odd, self._plain([w.decode() for w in odd])))

    def encode(self, texts: list[bytes | None], end: int) -> list[bytes]:
        last = int(end).to_bytes(self.key[1], "little")
        if len(self.known) > KNOWN_WORDS:
            self.known, self.parts = _Known(), {}
        find = self.known.__getitem__  # looks every word up once; places of new ones are filled before all are joined
        each = [list(map(find, (t or b"").split())) for t in texts]
        places, self.known.missed = self.known.missed, {}
        try:
            self.learn(list(places))
        except BaseException:
            self.known = _Known()  # no place may stay empty
            raise
        for word, place in places.items():
            place[:] = find(word)
        return [b"".join(p) + last for p in each]


def encoded(texts: list[bytes | None], tokenizer: str, width: int, end: int) -> list[bytes]:
    """Ids of each text with the end id, as little-endian bytes of ``width`` each."""
    home = sys.modules.setdefault("_token_files_worker", types.ModuleType("_token_files_worker"))
    if getattr(home, "worker", None) is None or home.worker.key != (tokenizer, width):
        home.worker = _Worker(tokenizer, width)
    gc.disable()  # millions of words are listed here, and none refers to another
    try:
        return home.worker.encode(texts, end)
    finally:
        gc.enable()


def _pieces(column, limit: int):
    """Row ranges of about ``limit`` bytes, and their texts."""
    rows, held, at = [], 0, 0
    for i, x in enumerate(column):
        rows.append(x.as_buffer().to_pybytes() if x.is_valid else None)
        held += len(rows[-1] or b"")
        if held >= limit:
            yield at, rows
            rows, held, at = [], 0, i + 1
    if rows:
        yield at, rows


def train_dictionary(docs: DataFrame, tokenizer: str, width: int, end: int) -> bytes:
    """A zstandard dictionary from a bounded sample of documents; empty if there is too little text."""
    import zstandard

    docs = docs.select("doc_id", "text")
    draw = F.xxhash64(F.lit("dictionary"), "doc_id")
    picked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(draw.alias("draw"), F.col("doc_id").alias("id")).distinct().orderBy("draw", "id").limit(DICTIONARY_DOCS)
    # One text of each id, cut to a bounded length before anything is gathered.
    text = F.min(F.substring("text", 1, DICTIONARY_CHARS)).alias("text")
    sample = docs.join(F.broadcast(picked), F.col("doc_id") == F.col("id")).groupBy("draw", "id").agg(text)
    rows = sample.select("draw", F.col("text").cast("binary").alias("text")).collect()
    ids = encoded([bytes(r.text) for r in sorted(rows)], tokenizer, width, end)
    pieces = [x[i : i + PIECE_IDS * width] for x in ids for i in range(0, len(x), PIECE_IDS * width)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for a dictionary
        return b""


def pack(doc_ids: np.ndarray, frames: list[bytes], counts: np.ndarray, width: int, digest: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    head = MAGIC + digest + width.to_bytes(4, "little") + len(frames).to_bytes(4, "little")
    return b"".join([head, doc_ids.astype("<i8").tobytes(), offsets.tobytes(), counts.astype("<u8").tobytes(), *frames])


class Block:
    """A payload opened for reading; frames are decompressed one by one."""

    def __init__(self, payload: bytes, dictionary: bytes):
        import zstandard

        if payload[:8] != MAGIC:
            raise ValueError("this is no block of token ids")
        if payload[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.width, n = (int.from_bytes(payload[i : i + 4], "little") for i in (40, 44))
        self.doc_ids = np.frombuffer(payload, "<i8", n, 48)
        self.offsets = np.frombuffer(payload, "<u8", n + 1, 48 + 8 * n)
        self.counts = np.frombuffer(payload, "<u8", n, 56 + 16 * n)
        self.frames, self.base = memoryview(payload), 56 + 24 * n
        self.tool = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the block."""
        a, b = self.base + int(self.offsets[k]), self.base + int(self.offsets[k + 1])
        return np.frombuffer(self.tool.decompress(self.frames[a:b]), f"<u{self.width}")


def write(docs: DataFrame, tokenizer: str, path: str, end: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode every document and write ``path``/blocks and ``path``/dictionary."""
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end + 1) <= 65_536 else 4
    dictionary = train_dictionary(docs, tokenizer, width, end)
    digest = hashlib.sha256(dictionary).digest()
    spark = docs.sparkSession

    def encode(batches):
        import zstandard
        from pyspark import TaskContext

        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, frames, counts, held = [], [], [], 0

        def closed():
            nonlocal block, start, ids, frames, counts, held
            body = pack(np.asarray(ids, np.int64), frames, np.asarray(counts), width, digest)
            known = [x for x in ids if x != NO_ID]
            row = [part, block, known[0] if known else None, known[-1] if known else None, len(ids), held, start, body]
            block, start = block + 1, start + held
            ids, frames, counts, held = [], [], [], 0
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            types_ = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types_)], names=names)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in _pieces(batch.column("text"), BATCH_BYTES):
                for k, raw in enumerate(encoded(texts, tokenizer, width, end)):
                    ids.append(NO_ID if doc_ids[at + k] is None else doc_ids[at + k])
                    frames.append(tool.compress(raw))
                    counts.append(len(raw) // width)
                    held += counts[-1]
                    if held >= block_ids:
                        yield closed()
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files."""
    dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each written range
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decode(batches):
        for batch in batches:
            for payload, begin in zip(batch.column("payload"), batch.column("begin").to_pylist()):
                block = Block(payload.as_py(), dictionary)
                each = [block.ids(k) for k in range(len(block.doc_ids))]
                sizes = np.array([len(x) for x in each], np.int64)
                columns = [
                    pa.array([None if x == NO_ID else x for x in block.doc_ids.tolist()], pa.int64()),
                    pa.array(begin + np.cumsum(sizes) - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    placed = blocks.join(F.broadcast(bases), "part").select("payload", (F.col("base") + F.col("start_in_part")).alias("begin"))
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the listed documents: only blocks that may hold one, only their frames."""
    dictionary = _dictionary(spark, path)
    asked = set(doc_ids)

    def decode(batches):
        for batch in batches:
            for payload in batch.column("payload"):
                block = Block(payload.as_py(), dictionary)
                at = np.flatnonzero(np.isin(block.doc_ids, list(asked)))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[at]), pa.array([block.ids(k).astype(np.int64) for k in at], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = F.lit(False)
    for x in sorted(asked):
        near = near | ((F.col("first_id") <= x) & (F.col("last_id") >= x))
    return spark.read.parquet(f"{path}/blocks").where(near).select("payload").mapInArrow(decode, "doc_id long, ids array<long>")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Write all documents below the shared folder and read the files back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-ids")
    write(docs, tokenizer, path, end)
    return read(spark, path)

"""Operators over documents: rules, classifier, substrings, token files, sharding."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, awkward, clashing, prose

from cohort_ledger.llm import quality_cnn, quality_gbt, sharding, substring_dedup, token_files
from cohort_ledger.llm import words as W

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(prose() + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awkward()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = awkward() + [(None, "a row without an id " * 30, "en", "a", 1), (None, None, None, None, None)]
    return clashing(spark.createDataFrame(rows, SCHEMA)).cache()


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    words = blank_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(blank_words(line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


# Quality rules


def test_base_counts(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality_gbt.judge(docs, quality_gbt.grow(np.zeros((0, 10)), np.zeros(0), [0] * 10)).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_counts(texts[r.doc_id])
        assert tuple(r[n] for n in quality_gbt.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def walked(model, x):
    """The trees, node by node."""
    total = model.prior
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + int(x[feature[at]] > threshold[at])
        total += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_keep_their_direction():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(1500, 3))
    y = ((x[:, 0] - x[:, 1] + 0.5 * np.sin(4 * x[:, 2]) + draw.normal(0, 0.3, 1500)) > 0).astype(float)
    model = quality_gbt.grow(x, y, [1, -1, 0], trees=40, depth=3)
    score = model.score(x)
    assert np.mean((score > 0.5) == y) > 0.9
    assert np.allclose(score[:50], [walked(model, row) for row in x[:50]])
    for feature, sign in ((0, 1), (1, -1)):
        line = np.repeat(x[:40], 60, axis=0).reshape(40, 60, 3)
        line[:, :, feature] = np.linspace(-3, 3, 60)
        steps = np.diff(model.score(line.reshape(-1, 3)).reshape(40, 60), axis=1) * sign
        assert steps.min() >= -1e-12


def test_keep_good_passes_rows_on(spark, odd):
    model = quality_gbt.grow(np.zeros((0, 10)), np.zeros(0), [0] * 10)
    kept = quality_gbt.keep_good(odd, model)
    assert kept.columns == odd.columns
    assert sorted(r.text[:3] for r in kept.collect()) == sorted(r.text[:3] for r in odd.collect() if not (base_counts(r.text)[0] < 50 or 2 * base_counts(r.text)[4] > base_counts(r.text)[0]))
    assert quality_gbt.judge(odd, model).count() == odd.count()
    assert quality_gbt.keep_good(odd.limit(0), model).count() == 0


def test_rules_learn_from_labels(spark):
    good = [(i, " ".join(f"w{(i * 37 + k * 11) % 501}" for k in range(80)), "en", "a", 1) for i in range(300)]
    bad = [(1000 + i, " ".join(f"W{(i * 37 + k * 11) % 501}!!" for k in range(80)), "en", "a", 1) for i in range(300)]
    frame = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good + bad] + [(None, 1, 0), (5, None, 0), (7, 1, 0)], LABELS)
    got = quality_gbt.judge(frame, quality_gbt.fit(frame, labels)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


# Classifier


def test_classifier_on_held_out_documents(spark):
    draw = np.random.default_rng(5)
    words = ["".join(draw.choice(list("abcdeiou"), 4)) for _ in range(300)]
    rows = [(i, " ".join(draw.choice(words, 60)), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%" if k % 3 else w.upper() + "!!" for k, w in enumerate(draw.choice(words, 60))), "en", "a", 1) for i in range(150)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows], LABELS)
    got = quality_cnn.score(frame, quality_cnn.fit(frame, labels)).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_every_byte_is_read_in_overlapping_chunks():
    draw = np.random.default_rng(1)
    net = quality_cnn.Network(draw.normal(size=(quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS, np.float32), draw.normal(size=2 * quality_cnn.FILTERS), 0.1)
    lengths = [0, 1, 5, 255, 256, 257, 511, 512, 513, 2000, 5000]
    raw = [bytes(draw.integers(1, 256, n, dtype=np.uint8)) for n in lengths]
    got = np.concatenate([net.features(t) for t in W.slices(pa.array(raw, pa.binary()), 700)])
    half = quality_cnn.CHUNK // 2
    for x, row in zip(raw, got):
        data = np.frombuffer(x + b"\0" * quality_cnn.WIDTH, np.uint8)
        n = max(len(x), 1)
        response = np.array([np.maximum(sum(net.table[k][data[i + k]] if i + k < len(data) else net.table[k][0] for k in range(quality_cnn.WIDTH)), 0) for i in range(len(x) + 1)])
        chunks = max(-(-len(x) // half) - 1, 1)
        tops = []
        for c in range(chunks):
            end = len(x) + 1 if c == chunks - 1 else (c + 2) * half
            tops.append(response[c * half : end].max(axis=0))
        assert np.allclose(row, np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]), atol=1e-4), n


def test_long_documents_are_walked_in_parts(monkeypatch):
    import tracemalloc

    draw = np.random.default_rng(2)
    net = quality_cnn.Network(draw.normal(size=(quality_cnn.WIDTH, 256, quality_cnn.FILTERS)).astype(np.float32), draw.normal(size=quality_cnn.FILTERS).astype(np.float32), draw.normal(size=2 * quality_cnn.FILTERS), 0.1)
    raw = [bytes(draw.integers(1, 256, n, dtype=np.uint8)) for n in (1023, 1024, 1025, 1279, 1280, 1281, 5000, 2048)]
    each = lambda: np.concatenate([net.features(t) for x in raw for t in W.slices(pa.array([x], pa.binary()))])
    at_once = each()
    monkeypatch.setattr(quality_cnn, "LONG_BYTES", 512)
    assert np.array_equal(each(), at_once)
    monkeypatch.undo()
    column = pa.array([bytes(draw.integers(1, 256, 12_000_000, dtype=np.uint8))], pa.binary())
    tracemalloc.start()
    [found] = [net.features(t) for t in W.slices(column, 500_000)]
    assert found.shape == (1, 2 * quality_cnn.FILTERS) and tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_classifier_without_labels(spark, odd):
    network = quality_cnn.fit(odd, spark.createDataFrame([], LABELS))
    got = quality_cnn.score(odd, network).collect()
    assert len(got) == odd.count() and all(abs(r.score - 0.5) < 1e-6 for r in got)
    assert quality_cnn.score(odd.limit(0), network).count() == 0


# Substrings


def brute_substrings(rows, size):
    texts = sorted({(i, t) for i, t, *_ in rows}, key=lambda r: r[0])
    first = {}
    for i, t in texts:
        w = blank_words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), (i, k))
    out = {}
    for i, t in texts:
        w = blank_words(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != (i, k) for j in range(size)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("size,seed", [(20, 10), (8, 2), (4, 4)])
def test_substrings_against_brute_force(spark, size, seed):
    rows = prose(80, seed=size) + [(900, "x " * 50, "en", "a", 1), (901, "x " * 30 + "y", "en", "a", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.without_repeats(frame, size, seed).collect()}
    assert got == brute_substrings(rows, size)


def test_substrings_of_odd_rows(spark, odd):
    got = substring_dedup.without_repeats(odd).collect()
    want = brute_substrings(awkward(), 20)
    assert len(got) == odd.count()
    assert all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert substring_dedup.without_repeats(odd.limit(0)).count() == 0


# Token files


def test_token_files_round_trip(spark, docs, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    for n, frame in enumerate((docs, odd)):
        token_files.write(frame, path, str(tmp_path / f"ids{n}"), block_ids=500)
        got = token_files.read(spark, str(tmp_path / f"ids{n}"), with_ids=True).collect()
        rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        start = 0
        for r, (i, text) in zip(sorted(got, key=lambda r: r.start), rows, strict=True):
            ids = tool.encode(text or "", add_special_tokens=False).ids + [2]
            assert (r.doc_id, r.start, r.ids) == (i, start, ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and r.n_tokens == len(ids)
            start += len(ids)
    few = {r.doc_id: r.ids for r in token_files.fetch(spark, str(tmp_path / "ids0"), [3, 1006, 77_777]).collect()}
    assert sorted(few) == [3, 1006] and few[3] == tool.encode(docs.where("doc_id = 3").first().text, add_special_tokens=False).ids + [2]
    token_files.write(odd.limit(0), path, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_dictionary_sample_is_bounded(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, " ".join(f"word{(i * 31 + k) % 97} of text" for k in range(300))) for i in range(60)]
    plain = token_files.train_dictionary(spark.createDataFrame(rows, "doc_id long, text string"), path, 2, 2)
    # Further texts under the same ids, and the part of a text beyond the bound, change nothing and are not gathered.
    more = [(i, "~" + "z" * 50_000) for i, _ in rows for _ in range(3)] + [(5, None), (None, "no id")]
    assert plain and plain == token_files.train_dictionary(spark.createDataFrame(rows + more, "doc_id long, text string"), path, 2, 2)


def test_words_are_encoded_as_in_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tool = Tokenizer.from_file(path)
    texts = ["İstanbul ΣΑΣ don't it's x'y'll 12ab a1. ÅNGSTRÖM <|endoftext|>  'S ''s word's' \x1c a\x85b ẞ ﬁ 日本語。 emoji😀! ... -- a-b", "", " ", "́a b"] + [r[1] for r in prose()]
    got = token_files.encoded([t.encode() for t in texts], path, 2, 2)
    assert got == [np.asarray(tool.encode(t, add_special_tokens=False).ids + [2], "<u2").tobytes() for t in texts]


def test_a_block_knows_its_dictionary():
    import zstandard

    body = token_files.pack(np.array([7]), [zstandard.ZstdCompressor().compress(b"\1\0")], np.array([1]), 2, hashlib.sha256(b"").digest())
    assert token_files.Block(body, b"").ids(0).tolist() == [1]
    with pytest.raises(ValueError):
        token_files.Block(body, b"another")


# Sharding


def shards_of(frame, **options):
    return sharding.interleave(frame, carry=("source",), **options).collect()


@pytest.mark.parametrize("n,options", [(1000, {}), (1000, {"bucket_rows": 5, "shards": 7}), (5, {"shards": 16})])
def test_shards_hold_the_mixture(spark, n, options):
    rows = [(i, f"text {i % 50}" if i % 9 else None, "en", ["hot", "hot", "b", None, "c"][i % 5] if i % 7 else f"rare{i}", 1) for i in range(n)]
    got = shards_of(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    k = options.get("shards", 16)
    assert sorted(r.doc_id for r in got) == list(range(n))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min([sizes[s] for s in range(k)]) <= 1
    for s in range(k):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for source, total in Counter(r.source for r in got).items():
        share = Counter(r.shard for r in got if r.source == source)
        assert all(abs(share[s] - total / k) <= 3 for s in range(k))
    texts = {r[0]: r[1] for r in rows}
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)


def test_shards_do_not_depend_on_row_order(spark, odd):
    frame = spark.createDataFrame(prose(), SCHEMA)
    assert sorted(shards_of(frame.repartition(5))) == sorted(shards_of(frame.coalesce(1)))
    assert len(shards_of(odd)) == odd.count() and not shards_of(odd.limit(0))


def test_written_shards(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame(prose(), SCHEMA), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(60)) and {r.shard for r in back.collect()} == {0, 1, 2, 3}


def test_each_word_is_looked_up_once_and_learned_once(monkeypatch):
    """New words get places that are filled before the texts are joined; a full memory begins anew."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tool = Tokenizer.from_file(path)
    texts = ["new words, new WORDS\tnew", None, "", "words again été 42 x=1", "new", "zebra " * 3]
    want = [np.asarray([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes() for t in texts]
    for most in (token_files.KNOWN_WORDS, 3):
        monkeypatch.setattr(token_files, "KNOWN_WORDS", most)
        worker = token_files._Worker(path, 2)
        learned, learn = [], worker.learn
        worker.learn = lambda words: (learned.extend(words), learn(words))[1]
        for _ in range(2):
            assert worker.encode([None if t is None else t.encode() for t in texts], 2) == want
        assert not worker.known.missed and all(type(x) is bytes for x in worker.known.values())
        assert len(learned) == len(set(learned)) * (1 if most > 3 else 2)

"""SimHash classes, hard negatives and the prefix trie against brute force."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from cases import SCHEMA, awkward, clashing, prose
from pyspark.sql import functions as F
from test_pairs import WITHOUT_ID, family, joined

from cohort_ledger.llm import hard_negatives, prefix_trie, simhash

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text):
    for c in BLANKS:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


# SimHash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t, *_ in rows]
    label = joined([(a, b) for a, b in combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 3], set(prints))
    least = {}
    for (i, *_), f in zip(rows, prints, strict=True):
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(((i, f"{f:016x}", least.get(label[f])) for (i, *_), f in zip(rows, prints, strict=True)), key=str)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_simhash_classes(spark, shards):
    rows = prose(150, seed=11) + awkward() + WITHOUT_ID + [(5000 + i, t, "en", "a", 0) for i, t in enumerate(family(60, 3))]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    got = simhash.near_duplicates(docs, shards=shards, task_rows=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_simhash_of_long_texts_and_pieces(monkeypatch):
    draw = random.Random(5)
    text = "".join(draw.choice("abcDÉ \n\t ") for _ in range(40_000)) + " " + "x" * 5000 + " end"
    whole = simhash.fingerprint(text.encode())
    assert whole == brute_fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 997)
    assert simhash.fingerprint(text.encode()) == whole
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0


def test_simhash_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_search_finds_all_components_of_crowds():
    """Random points, a dense ball and a long chain of neighbours, in trees with many branches."""
    draw = np.random.default_rng(7)
    loose = draw.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64)
    ball = np.array([loose[0] ^ np.uint64(sum(1 << int(b) for b in draw.choice(64, 4, replace=False))) for _ in range(1500)], np.uint64)
    chain = [int(loose[1])]
    for _ in range(400):
        chain.append(chain[-1] ^ sum(1 << int(b) for b in draw.choice(64, 3, replace=False)))
    points = np.unique(np.concatenate([loose, ball, np.array(chain, np.uint64)]))
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    a, b = np.nonzero(np.triu(near, 1))
    want = joined(zip(a.tolist(), b.tolist(), strict=True), set(range(len(points))))
    forest = simhash.Forest(len(points))
    every = np.arange(len(points))
    simhash.search(points, every, every, forest, draw)
    assert forest.label.tolist() == [want[i] for i in range(len(points))]

    tree = simhash.fit(points[draw.permutation(len(points))[:2000]], 30)
    rows, shard, home = simhash.route(points, tree)
    assert sorted(rows[home].tolist()) == list(range(len(points)))
    at_home = dict(zip(rows[home].tolist(), shard[home].tolist(), strict=True))
    there = set(zip(rows.tolist(), shard.tolist(), strict=True))
    assert all((x, at_home[y]) in there or (y, at_home[x]) in there for x, y in zip(a.tolist(), b.tolist(), strict=True))


# Hard negatives


def brute_negatives(rows):
    live = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(e is None or not np.isfinite(e) or abs(e) > 2**20 for e in x):
            continue
        live[(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * e)) for e in x))] = True
    live = sorted(live)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for i, label, v in (r for r in live if r[0] % 100 == 0):
        ranked = sorted(((-dot(v, w), j, other) for j, other, w in live if (j, other, w) != (i, label, v)), key=lambda t: t[:2])
        for ps, p, _ in [r for r in ranked if r[2] == label][:5]:
            window = [(j, -s) for s, j, other in ranked if other != label and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(i, p, n, j, -ps, s) for n, (j, s) in enumerate(window, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims, block", [(8, 40), (3, 1000)])
def test_hard_negatives(spark, dims, block):
    draw = np.random.default_rng(dims)
    rows = [(i * 10 + int(draw.integers(0, 2)), (np.round(draw.normal(size=dims), 1) / 2).tolist(), int(draw.integers(0, 3))) for i in range(300)]
    rows += [(9001, [0.5] * dims, 1)] * 3 + [(9003 + i, [0.5] * dims, i % 3) for i in range(9)]
    rows += [(None, [1.0] * dims, 1), (9100, None, 1), (9200, [None] + [1.0] * (dims - 1), 1), (9300, [float("nan")] * dims, 2), (9400, [float("inf")] * dims, 2)]
    rows += [(9500, [1.0] * dims, None), (9600, [0.0] * dims, 1), (9700, [], 2), (9800, [1e30] * dims, 1), (-100, [0.3] * dims, 2)]
    frame = clashing(spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "own")).drop("label").withColumnRenamed("own", "label")
    got = hard_negatives.mine(frame, block_rows=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_empty_table(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_walk_stops_before_the_end():
    """With one long component the threshold falls below the kth score after a few places."""
    values = np.zeros((5000, 4), np.int64)
    values[:, 0] = np.arange(5000)
    seen = []
    block = hard_negatives.Block.of(np.arange(5000), np.zeros(5000, int), np.zeros(5000, int), values)
    wanted = lambda at: seen.extend(at.tolist()) or np.ones(len(at), bool)
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    [(at, scores)] = hard_negatives.walk(block, np.array([3, 0, 0, 0]), wanted, np.array([lowest]), np.array([highest]), 5)
    assert at.tolist() == [4999, 4998, 4997, 4996, 4995] and scores[0] == 3 * 4999 and len(seen) < 50


# Prefix trie


def brute_trie(rows):
    order = lambda t: (t[1] is not None, t[1] or 0)
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    below = {}
    for k in members:
        for d in range(len(k) + 1):
            below.setdefault(k[:d], []).append(k)
    out = []
    for k, who in members.items():
        children = [m for m in below[k] if len(m) == len(k) + 1]
        leaves = [m for m in below[k] if not any(len(x) == len(m) + 1 for x in below[m])]
        saved = sum((len(members[m]) - 1) * len(words_of(m[-1][1])) for m in below[k] if m)
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(k)))
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def talks(n, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        same = draw.random() < 0.4
        for t in range(draw.randrange(0, 7)):
            text = "the same start of all" if t == 0 and same else f"choice {draw.randrange(3)} of {t}" if same else f"own {draw.random()}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    return rows


ODD_TURNS = [
    (500, None, "user", "a turn without a number"), (500, 3, None, "no role"), (500, 7, "user", None), (501, 0, None, None), (None, 0, "user", "no conversation"),
    (-3, 1, "user", "below zero"), (-40, 0, "user", "x y"), (-43, 0, "user", "x y"), (2**40, 0, "user", " \t "), (521, 0, "u", "one"), (540, 0, "u", "one two"),
]


@pytest.mark.parametrize("seed, cells", [(1, 1 << 20), (2, 64), (3, 1 << 9)])
def test_trie(spark, monkeypatch, seed, cells):
    """A sketch that is too small proves less, and changes nothing."""
    monkeypatch.setattr(prefix_trie, "LEAST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "MOST_CELLS", cells)
    monkeypatch.setattr(prefix_trie, "SLICES", 4)
    rows = talks(120, seed) + ODD_TURNS + [(600 + i, t, "user", f"copied {t}") for i in range(30) for t in range(5)]
    rows += [(700, t, "user", f"long {t % 9}") for t in range(300)] + [(701, t, "user", f"long {t % 9}") for t in range(300)]
    random.Random(seed).shuffle(rows)
    frame = clashing(spark.createDataFrame(rows, TURNS)).repartition(5)
    got = prefix_trie.trie(frame)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_few_and_none(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(1, 0, "user", "only")]
    got = prefix_trie.trie(spark.createDataFrame(rows, TURNS))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    gone = [(c, 0, "user", "a")]  # the whole conversation is taken from an absent one
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(gone, TURNS)).collect()), key=str) == brute_trie(gone)


def test_long_conversation_spans_chunks(spark):
    turned = prefix_trie.turns(spark.createDataFrame([(5, t, "user", str(t)) for t in range(400)] + [(6, 0, "u", "x")], TURNS).repartition(8))
    places = [r.place for r in turned.where("conv_id = 5").orderBy("place").collect()]
    assert places == list(range(1, 401))
    assert turned.where("conv_id = 5").select("chunk").distinct().count() >= 1
    assert turned.select(F.max("words")).first()[0] == 1

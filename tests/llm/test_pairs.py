"""Near duplicates, line dedup, components and decontamination against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from cases import SCHEMA, awkward, clashing, prose
from pyspark.sql import functions as F

from cohort_ledger.llm import decontaminate, line_dedup, prob_minhash
from cohort_ledger.llm.components import components

WITHOUT_ID = [(None, "a row without an id " * 30, "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(awkward() + WITHOUT_ID, SCHEMA)).cache()


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def joined(pairs, nodes):
    """Least member of each node's component."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {n: top(n) for n in nodes}


def test_components(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 101 + i) for i in range(40)]
    rest = [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(120)]
    edges = chain + star + rest + [(7, 7)]
    draw.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in components(frame).collect()}
    want = joined(edges, {n for e in edges if e[0] != e[1] for n in e})
    assert got == want
    assert components(frame.limit(0)).count() == 0


def test_stars_are_not_walked_again(spark, monkeypatch):
    from cohort_ledger.llm import components as module

    written = []
    cut = module.cut
    monkeypatch.setattr(module, "cut", lambda rows: written.append(rows) or cut(rows))
    stars = [(1, 2), (3, 1), (1, 4), (10, 12), (12, 10), (5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 12: 10} and len(written) == 1
    for unfinished in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        got = {r.node: r.label for r in components(spark.createDataFrame(unfinished, "a long, b long")).collect()}
        assert got == {1: 1, 2: 1, 3: 1}


# Near duplicates


def brute_classes(rows):
    texts = {t for _, t, *_ in rows if t is not None}
    sets = {}
    for t in texts:
        w = terms(t)
        sets[t] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    label = joined(near, texts)
    least = {}
    for i, t, *_ in rows:
        if t is not None and i is not None:
            least[label[t]] = min(i, least.get(label[t], i))
    return sorted(((i, i if t is None else least.get(label[t])) for i, t, *_ in rows), key=str)


def family(n, seed, base_too=True):
    """A base of 150 words and variants with two words changed."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    out = [" ".join(base)] if base_too else []
    for _ in range(n):
        parts = list(base)
        for _ in range(2):
            parts[draw.randrange(150)] = f"v{draw.randrange(10**6)}"
        out.append(" ".join(parts))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = prose(120, seed=9) + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(family(60, 1) + family(12, 2, False))]
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)


def test_near_duplicates_hidden_in_a_crowd(spark):
    """Texts at 0.77 to 0.79 of each other by shared boilerplate; some have a partner just above 0.8."""
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(10**7)}"
    base = [word() for _ in range(100)]
    texts = []
    for i in range(900):
        parts = base + [word() for _ in range(13 + i % 2)]
        texts.append(" ".join(parts))
        if i % 9 == 0:
            texts.append(" ".join(parts[:-12] + [word() for _ in range(12)]))
    draw.shuffle(texts)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    want = brute_classes(rows)
    assert sum(i != c for i, c in want) == 100
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got = sorted(((r.doc_id, r.class_id) for r in got), key=str)
    assert sum(x != y for x, y in zip(got, want)) == 0


def test_near_duplicates_with_a_repeated_passage(spark):
    """A passage stands once in one text and 100 times in its near copy: the sets of shingles hardly differ."""
    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(10**7)}"
    rows = []
    for i in range(20):
        body, line = [word() for _ in range(60)], [word() for _ in range(10)]
        for j, times in enumerate((1, 100)):
            text = " ".join(body + line * times)
            rows.append((2 * i + j, text, "en", "a", 1))
    want = brute_classes(rows)
    assert [c for _, c in sorted(want)] == [i - i % 2 for i in range(40)]
    got = prob_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == want


def test_near_duplicates_of_odd_rows(spark, odd):
    got = prob_minhash.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(awkward() + WITHOUT_ID)
    kept = prob_minhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([None, None, -3, 1, 2, 3, 4, 6, 8, 9, 10, 2**40], key=str)
    assert prob_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    draw = np.random.default_rng(2)
    names = draw.integers(0, 2**63, 400).astype(np.uint64)
    times = draw.integers(1, 9, 400)
    doc = np.repeat([0, 1], 300)
    name, time = np.concatenate([names[:300], names[100:]]), np.concatenate([times[:300], times[100:]])
    k = 4000
    got = prob_minhash.registers(2, doc, name, time, k)
    a, b = ({n: 1 + np.log(t) for n, t in zip(name[doc == d].tolist(), time[doc == d])} for d in (0, 1))
    exact = sum(1 / sum(max(a[y] / a[x] if y in a else 0, b[y] / b[x] if y in b else 0) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
    assert abs((got[0] == got[1]).mean() - exact) < 4 * (exact * (1 - exact) / k) ** 0.5
    alone = prob_minhash.registers(1, np.zeros(1, np.int64), names[:1], times[:1], 8)
    assert (alone == names[0]).all()


# Lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(draw, text, n, letters="xyzñ"):
    out = list(text)
    for _ in range(n):
        i, kind = draw.randrange(len(out) + 1), draw.randrange(3)
        if kind == 0:
            out.insert(i, draw.choice(letters))
        elif i < len(out):
            out[i : i + 1] = [draw.choice(letters)] if kind == 1 else []
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_bit_parallel_distance(spark, edits):
    draw = random.Random(edits)
    pairs = []
    for i in range(1500):
        a = "".join(draw.choice("abcñ😀") for _ in range(draw.randrange(25)))
        longer, shorter = sorted((a, edited(draw, a, draw.randrange(6), "abcñ😀")), key=len, reverse=True)
        pairs.append((i, longer, shorter))
    got = {r.id: r.distance for r in line_dedup.within(spark.createDataFrame(pairs, "id int, longer string, shorter string"), edits).collect()}
    want = {i: d for i, a, b in pairs if (d := distance(a, b)) <= edits}
    assert got == want


def line_documents(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab cde") for _ in range(draw.randint(14, 34))) for _ in range(12)]
    rows = [(i, "\n".join([edited(draw, draw.choice(base), draw.randrange(4)) for _ in range(4)] + draw.choice([[], ["ok"], ["", "ok"]]))) for i in range(60)]
    template = "a heading that many lines have in common, entry "
    return rows + [(100 + i, template + f"{i * 7919 % 10**5:05d} of 12") for i in range(40)]


def brute_lines(rows, edits=2, least=16):
    first, links = {}, {}
    for i, text in sorted({r[:2] for r in rows if r[0] is not None}, key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n") if text is not None else []):
            if re.search(r"[^\x00-\x20]", line):
                first.setdefault(line, (i, n))
    long = sorted(x for x in first if len(x) >= least)
    for a, b in combinations(long, 2):
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
    out = {}
    for i, text in rows:
        lines = text.split("\n") if text is not None else []
        equal = [n for n, x in enumerate(lines) if x in first and first[x] != (i, n)]
        near = [n for n, x in enumerate(lines) if x in first and n not in equal and any(first[y] < (i, n) for y in links.get(x, []))]
        out[i] = (len(lines), len(equal), len(near), sum(len(links.get(x, [])) for x in lines), sorted(equal + near))
    return out


@pytest.mark.parametrize("hot", [8, 0.2])
def test_lines_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # at 0.2 nearly every key is refined
    rows = line_documents(5)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.n_links, r.removed_lines) for r in line_dedup.duplicate_lines(frame).collect()}
    assert got == brute_lines(rows)


def test_lines_of_odd_rows(spark, odd):
    rows = [r[:2] for r in awkward()]
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_near, r.n_links, r.removed_lines) for r in line_dedup.duplicate_lines(odd).collect()}
    want = brute_lines(rows)
    for i in want:
        if i != 9:  # given twice: its lines count twice
            assert got[i] == want[i], i
    assert got[9][0] == 2 * want[9][0]
    kept = {r.doc_id: r.kept_text for r in line_dedup.without_duplicates(odd).collect()}
    assert kept[1] is None and kept[4] == "one" and kept[5] == ""  # its line first stands in -3
    assert line_dedup.duplicate_lines(odd.limit(0)).count() == 0


# Decontamination


def brute_hits(rows, items, size=10):
    windows = [(i, w[k : k + size]) for i, t in items for w in [terms(t)] if w for k in range(max(1, len(w) - size + 1))]
    out = []
    for i, text, *_ in rows:
        w = terms(text)
        hit, found = set(), set()
        for item, words in windows:
            for k in range(len(w) - len(words) + 1):
                if w[k : k + len(words)] == words:
                    hit |= set(range(k, k + len(words)))
                    found.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(found - {None}))))
    return sorted(out, key=str)


def items_from(rows):
    texts = [terms(r[1]) for r in rows if r[1]]
    out = [(n, " ".join(t[5:25]).upper()) for n, t in enumerate(texts[::7])]
    out += [(900, None), (901, ""), (902, "one TWO"), (903, "nowhere to be found in any of these documents at all"), (904, out[0][1]), (None, "one two three")]
    return out + [(905, "and ".join(out[1][1].split()[:12]))]


def test_hits_against_brute_force(spark, odd):
    rows = prose(70, seed=12)
    items = items_from(rows)
    benchmark = clashing(spark.createDataFrame(items, "item_id long, text string"))
    for frame, given in ((spark.createDataFrame(rows, SCHEMA).repartition(3), rows), (odd, awkward() + WITHOUT_ID)):
        got = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in decontaminate.hits(frame, benchmark).collect()]
        assert [g for g in sorted(got, key=str) if g[0] is not None] == [b for b in brute_hits(given, items) if b[0] is not None]
        assert len(got) == len(given)
    clean = decontaminate.clean(odd, benchmark)
    assert clean.columns == odd.columns and {r.doc_id for r in clean.collect()} == {b[0] for b in brute_hits(awkward() + WITHOUT_ID, items) if not b[2]} | {None}


def test_no_benchmark_and_no_documents(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontaminate.hits(odd, none).collect())
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.hits(odd.limit(0), some).count() == 0


def test_proximity(spark):
    rows = [(1, "alpha x beta y gamma z"), (2, "gamma " + "x " * 8 + "beta alpha"), (3, "alpha " + "x " * 30 + "beta gamma"), (4, "alpha beta"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "alpha, beta; gamma"), (2, "alpha beta")], "item_id long, text string")
    vocabulary = decontaminate.phrases(benchmark).select(F.explode("words").alias("term")).distinct()
    got = decontaminate.proximity(decontaminate.index(docs, vocabulary), benchmark)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2)]


def test_a_part_of_a_long_item_is_near(spark):
    words = [f"w{k * 37 % 1009}" for k in range(60)]
    item = " ".join(words)
    shuffled = words[10:30]
    random.Random(3).shuffle(shuffled)
    rows = [(1, "before it " + item), (2, "only a part " + " ".join(words[20:45])), (3, "in disorder " + " ".join(shuffled)), (4, " ".join(words[::9])), (None, item), (5, None)]
    docs = spark.createDataFrame(rows + [(10 + i, f"other text {i}") for i in range(20)], "doc_id long, text string")
    benchmark = spark.createDataFrame([("a", item), ("b", item), ("c", "of no use"), (None, None)], "item_id string, text string")
    vocabulary = decontaminate.phrases(benchmark).select(F.explode("words").alias("term")).distinct()
    got = {tuple(r) for r in decontaminate.proximity(decontaminate.index(docs, vocabulary), benchmark).collect()}
    assert got == {(i, d) for i in "ab" for d in (1, 2, 3, None)}
    hits = {r.doc_id: r["items"] for r in decontaminate.hits(docs, benchmark).collect()}
    assert sorted(hits[1]) == sorted(hits[2]) == sorted(hits[None]) == ["a", "b"] and hits[3] == []


def shuffled_rows(spark):
    """Rows that all stages of the session have written to shuffles so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
    total = 0
    while found.hasNext():
        total += found.next().shuffleWriteRecords()
    return total


def test_lists_are_not_dealt_out_to_meet_few_anchors(spark):
    """The postings are far more than the anchors, which are small enough to be sent to them."""
    draw = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    item = " ".join(words)
    docs = [(i, " ".join(draw.choice(words) for _ in range(80))) for i in range(2000)] + [(3000, item[10:400])]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    windows = decontaminate.phrases(spark.createDataFrame([(1, item)], "item_id long, text string"))
    postings = decontaminate.index(docs, windows.select(F.explode("words").alias("term")).distinct())
    rare = decontaminate.anchors(windows, postings)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")  # between the two
    try:
        start = shuffled_rows(spark)
        found = decontaminate.starts(postings, rare).collect()
        assert shuffled_rows(spark) - start < postings.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 3000 in {r.doc_id for r in found}


def test_unlike_texts_under_one_id_are_judged_apart(spark):
    phrase = " ".join(f"p{k}" for k in range(12))
    rows = [(1, "start " + phrase), (1, "a clean text"), (1, None), (None, phrase), (None, "clean too"), (2, phrase + " " + phrase), (2, phrase + " " + phrase), (2, "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame([(7, phrase)], "item_id int, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.hits(docs, benchmark).collect()), key=str)
    assert got == sorted([(1, 13, 12, [7]), (1, 3, 0, []), (1, 0, 0, []), (None, 12, 12, [7]), (None, 2, 0, []), (2, 24, 24, [7]), (2, 24, 24, [7]), (2, 0, 0, [])], key=str)
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[7]], key=str)


def test_unlike_texts_under_one_id_stay(spark):
    """Two different texts under one id, and under NULL: no document and no word of a clean one is lost."""
    from cohort_ledger.llm import substring_dedup

    draw = random.Random(8)
    text = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    copied, clean, other, third = text(60), text(60), text(60), text(45)
    rows = [(1, copied), (2, copied), (2, clean), (3, other), (3, third), (None, copied), (None, clean[:200]), (None, text(40)), (4, None), (4, third), (4, third)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = sorted(((r.doc_id, r.text) for r in prob_minhash.keep_one(docs).select("doc_id", "text").collect()), key=str)
    without = [r for r in rows if r[0] is None or r[1] is None]
    assert kept == sorted([(1, copied), (2, clean), (3, other), (3, third), *without], key=str)

    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.without_repeats(docs).collect()), key=str)
    # In the order of id (NULL first) and text, a window is removed where it stands earlier.
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: (r[:2], spark_hash(spark, r[2])))
    seen, removed = set(), {}
    for known, i, t in order:
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if window in seen else set()
            seen.add(window)
        removed[(i if known else None, t)] = len(gone)
    assert got == sorted(((i, len(t.split()) if t else 0, removed.get((i, t), 0)) for i, t in rows), key=str)


def spark_hash(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]

"""URL filter, mixing and the pipeline."""

import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SCHEMA, awkward, clashing, prose
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_ledger.llm import mixing, queries, url_filter

RULES = queries.RULES


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    tail = url.split("://", 1)[1]
    host = tail
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = tail[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def whole_url(url):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    if url is None or "://" not in url:
        return url or ""
    scheme, tail = url.split("://", 1)
    host = re.split("[/?#]", tail, maxsplit=1)[0]
    return lower(scheme) + "://" + lower(host) + tail[len(host) :]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name)) if fits else None


def urls():
    out = []
    for i in range(260):
        out += [f"https://site{i % 40}.example.org/news/{i}.html", f"http://www.shop{i % 30}.example.com/de/{i}?x=1", f"http://a{i % 9}.example.net/{'news' if i % 2 else 'de'}/{i}"]
    return out + [None, "", "no scheme", "http://", "HTTP://ORG", "http://EXAMPLE.org/es/x", "x://example.org/en/1#a/b", "http://notexample.org/es/", "http://a.com/fr/?q", "http://com/de/", "http://ü.org/ñ", "http://org?/es/"]


def brute_scores(texts, trained):
    """Log-likelihood ratio per character, recursively."""
    order = url_filter.ORDER
    counts = [defaultdict(Counter), defaultdict(Counter)]
    for text, each in trained.items():
        padded = url_filter.START * order + text + url_filter.STOP
        for i in range(order, len(padded)):
            for side in (0, 1):
                if each[side]:
                    for k in range(order + 1):
                        counts[side][padded[i - k : i]][padded[i]] += each[side]

    def p(side, context, c):
        below = p(side, context[1:], c) if context else 1 / url_filter.ALPHABET
        seen = counts[side].get(context)
        return (seen[c] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below

    out = {}
    for text in texts:
        padded = url_filter.START * order + text + url_filter.STOP
        each = [math.log(p(0, padded[i - order : i], padded[i])) - math.log(p(1, padded[i - order : i], padded[i])) for i in range(order, len(padded))]
        out[text] = sum(each) / len(each)
    return out


def test_urls_against_brute_force(spark):
    given = urls()
    pages = clashing(spark.createDataFrame(list(enumerate(given)) + [(7, given[7])], "page_id long, url string").repartition(3))
    got = url_filter.judge(pages, RULES).collect()
    assert len(got) == len(given) + 1
    ruled = defaultdict(lambda: [0, 0])
    for r in got:
        host, path = split_url(given[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.name if rule else None)
        if rule:
            assert r.verdict == rule.verdict
            ruled[whole_url(given[r.page_id])][rule.verdict == "block"] += 1
    texts = spark.createDataFrame([(t,) for t in ruled], "text string")
    held = {r.text for r in texts.where(F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(5)) == 0).collect()}
    scores = brute_scores({whole_url(given[r.page_id]) for r in got if r.rule is None} | held, {t: n for t, n in ruled.items() if t not in held})
    open_rows = [r for r in got if r.rule is None]
    assert all(abs(r.score - scores[whole_url(given[r.page_id])]) < 1e-5 for r in open_rows)
    bins = {t: math.floor(s * url_filter.BINS) for t, s in scores.items()}
    a, b = (sum(ruled[t][k] for t in held) for k in (0, 1))

    def rate(cut):
        return sum(ruled[t][0] for t in held if bins[t] >= cut) / a + sum(ruled[t][1] for t in held if bins[t] < cut) / b

    top = max(rate(c) for c in range(min(bins.values()), max(bins.values()) + 2))
    lowest = min((r.score for r in open_rows if r.verdict == "allow"), default=None)
    highest = max((r.score for r in open_rows if r.verdict == "block"), default=None)
    assert lowest is not None and highest is not None and lowest > highest
    assert abs(rate(math.floor(lowest * url_filter.BINS)) - top) < 0.2
    sure = [r for r in open_rows if r.host.endswith("example.net")]
    assert sum((r.verdict == "block") == r.path.startswith("/de/") for r in sure) > 0.9 * len(sure)


def test_urls_without_examples(spark):
    pages = spark.createDataFrame([(1, None), (2, "http://x.net/a")], "page_id long, url string")
    assert [(r.rule, r.verdict, r.score) for r in url_filter.judge(pages, RULES).collect()] == [(None, "allow", 0.0)] * 2
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


# Mixing


def labelled(spark):
    vocabulary = {0: "alpha beta gamma delta", 1: "red green blue white"}
    rows = [(i, " ".join((vocabulary[i % 4 == 0] + f" w{i % 50}").split() * (3 + i % 5)), "en", "a", 1) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600, 2)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, SCHEMA).repartition(3), labels


def test_rates_meet_the_targets(spark):
    docs, labels = labelled(spark)
    model = mixing.fit(docs, labels, F.col("toxic"), 2)
    got = mixing.rates(docs, model, [0.5, 0.5]).collect()
    assert sum((r.posterior[1] > 0.5) == (r.doc_id % 4 == 0) for r in got) > 0.97 * 600
    sums = [sum(r.n_words * r.posterior[d] * r.rate for r in got) for d in (0, 1)]
    total = sum(r.n_words for r in got)
    assert all(abs(s - total / 2) < 1e-4 * total for s in sums) and all(r.rate >= 0 for r in got)
    drawn = [sum(r.n_words * r.posterior[d] * r.copies for r in got) for d in (0, 1)]
    assert all(abs(s - total / 2) < 0.1 * total for s in drawn)
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in got)


def test_rates_within_bounds_come_closest(spark):
    docs, labels = labelled(spark)
    model = mixing.fit(docs, labels, F.col("toxic"), 2)
    got = mixing.rates(docs, model, [0.05, 0.95], most=3.0).collect()  # more than these rates can give
    assert min(r.rate for r in got) >= 0 and max(r.rate for r in got) <= 3
    mixed = mixing.mixed(clashing(docs), model, [0.6, 0.4], least=1.0)
    assert mixed.columns == clashing(docs).columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == set(range(600)) and sum(times[i] for i in times if i % 4 == 0) > 1.2 * 150


def nonnegative_residual(a, b):
    """Least |a r - b| over r >= 0, by coordinate descent on the normal equations."""
    gram, goal, r = a.T @ a, a.T @ b, np.zeros(a.shape[1])
    for _ in range(200):
        before = r.copy()
        for i in range(len(r)):
            if gram[i, i] > 0:
                r[i] = max(0.0, r[i] + (goal[i] - gram[i] @ r) / gram[i, i])
        if np.abs(r - before).max() < 1e-10:
            break
    return np.linalg.norm(a @ r - b)


def rated(spark, rows, targets, **options):
    soft = spark.createDataFrame(rows, "doc_id long, n_words long, posterior array<double>").repartition(3)
    return soft.withColumn("rate", mixing.fit_rates(soft, targets, **options)).withColumn("copies", mixing.copies(F.col("rate")))


def test_rates_against_an_independent_solution(spark):
    draw = np.random.default_rng(3)
    for targets, sharp in (([0.2, 0.3, 0.5], 0.3), ([0.9, 0.05, 0.05], 3.0), ([1.0, 0.0, 0.0], 3.0)):
        posterior = draw.dirichlet([sharp] * 3, 40)
        n = draw.integers(1, 60, 40)
        rows = [(i, int(n[i]), posterior[i].tolist()) for i in range(40)]
        got = sorted(rated(spark, rows, targets).collect())
        a, goal = (posterior * n[:, None]).T, np.array(targets) * n.sum()
        rate = np.array([r.rate for r in got])
        assert (rate >= 0).all()
        assert np.linalg.norm(a @ rate - goal) <= nonnegative_residual(a, goal) + 0.02 * n.sum(), targets


def test_a_scarce_domain_is_repeated_as_often_as_asked(spark):
    rows = [(i, 10, [0.01, 0.99] if i == 0 else [1.0, 0.0]) for i in range(100)] + [(100, 0, [0.0, 1.0])]
    got = rated(spark, rows, [0.5, 0.5])
    shares = {r.domain: r for r in mixing.balance(got, [0.5, 0.5]).collect()}
    assert all(abs(shares[d].wanted - 0.5) < 1e-9 and abs(shares[d].reached - 0.5) < 1e-6 and abs(shares[d].drawn - 0.5) < 0.1 for d in (0, 1))
    by_id = {r.doc_id: r.rate for r in got.collect()}
    assert by_id[0] > 40 and by_id[100] == 1.0
    bound = rated(spark, rows, [0.5, 0.5], most=8.0)
    assert max(r.rate for r in bound.collect()) == 8.0
    assert {r.domain: round(r.reached, 2) for r in mixing.balance(bound, [0.5, 0.5]).collect()}[1] < 0.4
    assert mixing.balance(got.limit(0), [0.5, 0.5]).count() == 0


def test_mixing_of_odd_rows(spark):
    odd = clashing(spark.createDataFrame(awkward() + [(None, "no id", None, None, None)], SCHEMA))
    model = mixing.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"), F.col("toxic"), 2)
    got = mixing.rates(odd, model, [0.5, 0.5]).collect()
    assert len(got) == odd.count() and all(abs(r.rate - 1) < 1e-6 for r in got)
    assert mixing.mixed(odd, model, [0.5, 0.5], least=1.0).count() == odd.count()
    assert mixing.rates(odd.limit(0), model, [0.5, 0.5]).count() == 0


# Pipeline


def test_stages_take_effect(spark, tmp_path):
    words = " ".join(f"w{i * 7919 % 1009}" for i in range(90))
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(70 + i)), "en", f"s{i % 2}", 1) for i in range(60)]
    rows += [(100, words, "en", "s0", 1), (101, words + " end", "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None)]
    rows += [(104, " ".join(f"q{k}" for k in range(80)) + " benchmark words that must never be part of the training text", "en", "s0", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Benchmark words that must never be part of the training text!")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert seen["quality_rules"] == [*range(60), 100, 101, 104]
    assert seen["near_duplicates"] == [*range(60), 100, 104]
    assert seen["decontamination"] == [*range(60), 100]
    assert set(seen["mixing"]) == set(seen["decontamination"]) and seen["sharding"] == seen["mixing"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == seen["sharding"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_on_prose(spark, tmp_path, name):
    import duckdb

    spark.createDataFrame(prose(80, seed=20), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t[10:140]) for i, t, *_ in prose(80, seed=20)[::9]] + [(99, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    draw = np.random.default_rng(6)
    vectors = [(i, draw.normal(size=8).astype(np.float32).tolist(), i % 10) for i in range(400)] + [(400, None, 1), (500, [float("nan")] * 8, 1), (600, [1.0] * 8, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {c % (1 + 3 * t)} of {t}") for c in range(80) for t in range(1 + c % 5)] + [(81, None, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(map(json.dumps, map(list, result.fetchall()))) == sorted(json.dumps([r[c] for c in names]) for r in frame.collect())


def test_a_rate_of_many_steps_is_as_short_as_one_of_few(spark, capsys):
    """Steps are rows of a constant table, so the jobs of all steps share their generated code."""
    soft = spark.range(60).selectExpr("id AS doc_id", "id % 7 + 1 AS n_words", "array((id % 10) / 10D, 1 - (id % 10) / 10D) AS posterior")
    sizes = []
    for steps in (2, 40):
        rate = mixing.fit_rates(soft, [0.93, 0.07], least=1.0, steps=steps)
        soft.select(rate.alias("rate")).explain("codegen")
        sizes.append(len(capsys.readouterr().out))
    assert sizes[1] <= 1.2 * sizes[0]

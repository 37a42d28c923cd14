"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, doc_id, pos) of the training texts,
for every term of the benchmark, written once to the shared folder; each
document also has one posting of the empty term, at the number of its words,
with a hash of its text.

A phrase is found from its rarest terms: postings of the rarest term, each
moved back by the term's place, are the possible starts; they are intersected
with the moved postings of the second rarest.  What is left is compared word by
word with the texts of the documents concerned.  Frequencies are counted over
the whole index.

``proximity`` finds items of which a window's three rarest terms stand close
together in any order, which catches reworded passages.

Only built-in functions are used.  Hot terms stay on the left of every join,
where a partition can be split; each phrase has one row per rare term on the
right.  Per document only spans and item ids are gathered, bounded by its
length and by the benchmark.

Defined results: items without words match nothing; an item without an id marks
words but is not listed; a NULL document text has no words and is clean; an
item of fewer than ``SIZE`` words is one phrase; items with equal texts all
count; a document is known by its id and its text, so unlike texts under one id
(or under NULL) are judged apart, and repeated rows alike; ids of items may be of
any type; empty tables give no matches; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger.llm.words import LOWER, TERM_GAP_PATTERN, UPPER
from cohort_ledger.session import cut

SIZE = 10  #: words of a phrase
ANCHORS = 2  #: rarest terms of a window whose lists are intersected
NEAR_TERMS = 3  #: rarest terms of an item that a proximity match needs
NEAR_WORDS = 20  #: reach of a proximity match


def terms(text: Column) -> Column:
    """The words of a text, in lower case; NULL has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), TERM_GAP_PATTERN)
    return F.filter(parts, lambda w: w != "")


def phrases(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item_id, body, at, phrase, text, words) of every window of ``size`` words of every item.

    ``body`` stands for an item's words, so equal items are searched once; ``at`` counts from 0.
    """
    items = benchmark.select("item_id", terms(F.col("text")).alias("all")).where("size(all) > 0")
    last = F.greatest(F.size("all") - size, F.lit(0))
    at = items.select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    windows = at.select("item_id", F.xxhash64(F.array_join("all", " ")).alias("body"), "at", F.slice("all", F.col("at") + 1, size).alias("words"))
    return windows.withColumn("text", F.array_join("words", " ")).withColumn("phrase", F.xxhash64("text"))


def index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings (term, doc_id, pos) of the terms in ``vocabulary`` (term).

    The empty term's posting is a document's length, with ``text_hash``, its text's hash.
    """
    texts = docs.select("doc_id", terms(F.col("text")).alias("words"), F.xxhash64("text").alias("hashed"))
    listed = texts.select("doc_id", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"), "hashed")
    listed = listed.select("doc_id", "pos", "term", F.when(F.col("term") == "", F.col("hashed")).alias("text_hash"))
    return cut(listed.join(vocabulary, "term", "left_semi").select("term", "doc_id", "pos", "text_hash"))


def anchors(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """(body, phrase, at, n, anchors): places in the body and terms of each window's rarest words, rarest first.

    Windows with a word that no document has are left out.
    """
    frequency = postings.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    each = windows.select("body", "at", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("place", "term")).distinct()
    counted = each.join(frequency, "term", "left").groupBy("body", "at", "phrase", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), (F.col("at") + F.col("place")).alias("place"), "term"))).alias("anchors")
    )
    return counted.where("anchors[0].freq > 0").withColumn("anchors", F.slice("anchors", 1, ANCHORS))


def starts(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """Possible starts (phrase, doc_id, start, n): all rare terms of a window stand where they should.

    A posting of the rarest term puts the item's start at ``pos - place`` of the
    document.  Windows of an item with the same rare places share this start,
    so it is looked for once.  It stays if the next rarest terms have a posting
    at the same start plus their own place.
    """
    places = [F.coalesce(F.get("anchors", F.lit(k))["place"], F.lit(-1)).alias(f"place{k}") for k in range(ANCHORS)]
    words = [F.get("anchors", F.lit(k))["term"].alias(f"term{k}") for k in range(ANCHORS)]
    # Written, so that its size is known before the lists would be dealt out to meet it.
    rare = cut(rare.select("body", "at", "phrase", "n", *places, *words))
    keys = ["body", *[f"place{k}" for k in range(ANCHORS)]]
    sought = rare.select(*keys, *[f"term{k}" for k in range(ANCHORS)]).distinct()
    near = postings.join(sought, F.col("term") == F.col("term0")).select("doc_id", (F.col("pos") - F.col("place0")).alias("base"), *keys, *[f"term{k}" for k in range(1, ANCHORS)])
    for k in range(1, ANCHORS):
        used = postings.join(sought.select(F.col(f"term{k}").alias("used")).distinct(), F.col("term") == F.col("used"), "left_semi")
        moved = used.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("pos").alias("p"))
        same = (F.col(f"term{k}") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("base") + F.col(f"place{k}") == F.col("p"))
        near = cut(near.where(F.col(f"place{k}") >= 0).join(moved.hint("merge"), same, "left_semi").union(near.where(F.col(f"place{k}") < 0)))
    own = rare.select(*[F.col(c).alias(f"own_{c}") for c in keys], "at", "phrase", "n").distinct()
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"own_{c}"))
    return near.join(own, same).select("phrase", "doc_id", (F.col("base") + F.col("at")).alias("start"), "n").where("start >= 0").distinct()


def matches(docs: DataFrame, windows: DataFrame, possible: DataFrame) -> DataFrame:
    """Exact occurrences (doc_id, text_hash, start, n, phrase), compared with the documents' own words.

    The lists of an id hold the words of all texts under it; here each text is compared by itself.
    """
    wanted = windows.groupBy("phrase").agg(F.first("text").alias("wanted"))
    listed = possible.join(wanted, "phrase").groupBy(F.col("doc_id").alias("d")).agg(F.collect_set(F.struct("phrase", "wanted", "start", "n")).alias("spans"))
    texts = docs.select("doc_id", "text").join(listed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")))
    words = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), terms(F.col("text")).alias("words"), "spans")
    each = words.select("doc_id", "text_hash", F.explode(F.filter("spans", lambda s: F.array_join(F.slice("words", s["start"] + 1, s["n"]), " ") == s["wanted"])).alias("s"))
    return each.select("doc_id", "text_hash", "s.phrase", "s.start", "s.n").distinct()


def proximity(postings: DataFrame, benchmark: DataFrame, reach: int = NEAR_WORDS, count: int = NEAR_TERMS) -> DataFrame:
    """(item_id, doc_id) where the ``count`` rarest terms of one of the item's windows stand within ``reach`` words.

    A window is ``reach`` words of the item, one every half of that, so a part of an
    item that was taken over has windows of its own, however long the item is.
    Words that no document has do not count among the rarest.
    """
    items = benchmark.select("item_id", terms(F.col("text")).alias("words")).where("size(words) > 0")
    half = max(reach // 2, 1)
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.size("words") - reach) / half), F.lit(0).cast("long")))
    windows = items.select("item_id", "words", F.explode(at).alias("at"))
    each = windows.select("item_id", "at", F.explode(F.array_distinct(F.slice("words", (F.col("at") * half + 1).cast("int"), reach))).alias("term"))
    frequency = postings.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    counted = each.join(frequency, "term").groupBy("item_id", "at")
    rare = counted.agg(F.slice(F.sort_array(F.collect_list(F.struct("freq", "term"))), 1, count).alias("rare"))
    # Windows of an item with the same rare terms are looked for once.
    rare = rare.where(F.size("rare") == count).select("item_id", F.col("rare.term").alias("rare")).distinct()
    rare = rare.select(F.struct("item_id", "rare").alias("item_id"), "rare")
    near = None
    for k in range(count):
        these = rare.select("item_id", F.col("rare")[k].alias("term"))
        moved = postings.join(these, "term").select("item_id", "doc_id", "pos")
        if near is None:
            near = moved.select("item_id", "doc_id", F.col("pos").alias("low"), F.col("pos").alias("high"))
            continue
        step = moved.select(F.col("item_id").alias("i"), F.col("doc_id").alias("d"), F.col("pos").alias("p"), F.explode(F.array(*[F.floor(F.col("pos") / reach) + x for x in (-1, 0, 1)])).alias("cell"))
        joined = near.withColumn("at", F.floor(F.col("low") / reach)).join(step, (F.col("item_id") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("at") == F.col("cell")))
        near = joined.select("item_id", "doc_id", F.least("low", "p").alias("low"), F.greatest("high", "p").alias("high")).where(F.col("high") - F.col("low") < reach).distinct()
    return near.select("item_id.item_id", "doc_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) of every document; items are ids of items with a phrase in it."""
    windows = phrases(benchmark, size)
    vocabulary = windows.select(F.explode("words").alias("term")).union(windows.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    postings = index(docs, vocabulary)
    possible = starts(postings, anchors(windows, postings))
    found = cut(matches(docs, windows, possible))

    spans = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    # Spans in order of their start: each adds what lies beyond all before it.
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n_hit")),
        lambda s, x: F.struct(
            F.greatest(s["upto"], x["start"] + x["n"]).alias("upto"),
            (s["n_hit"] + F.greatest(x["start"] + x["n"] - F.greatest(s["upto"], x["start"]), F.lit(0))).alias("n_hit"),
        ),
        lambda s: s["n_hit"],
    )
    covered = spans.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("d_hash"), step.alias("n_hit"))
    owners = windows.where("item_id IS NOT NULL").select("item_id", F.col("phrase").alias("p")).distinct()
    named = found.select("doc_id", "text_hash", "phrase").distinct().join(owners, F.col("phrase") == F.col("p"))
    items = named.groupBy(F.col("doc_id").alias("e"), F.col("text_hash").alias("e_hash")).agg(F.collect_set("item_id").alias("items"))
    lengths = postings.where("term = ''").select("doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast(T.ArrayType(benchmark.schema["item_id"].dataType))
    return (
        lengths.join(covered, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("d_hash")), "left")
        .join(items, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("text_hash") == F.col("e_hash")), "left")
        .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` in which no phrase of the benchmark occurs."""
    found = hits(docs, benchmark, size).where("n_hit > 0")
    dirty = found.select(F.col("doc_id").alias("dirty_id"), F.col("text_hash").alias("dirty_text"))
    same = docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (F.xxhash64(docs["text"]) == dirty["dirty_text"])
    return docs.join(dirty, same, "left_anti")

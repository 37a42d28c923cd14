"""The registered queries of the package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.llm import (
    decontaminate,
    hard_negatives,
    line_dedup,
    mixing,
    prefix_trie,
    prob_minhash,
    quality_cnn,
    quality_gbt,
    sharding,
    simhash,
    substring_dedup,
    token_files,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_line_dedup")
def op1(spark, folder):
    found = line_dedup.duplicate_lines(table(spark, folder, "documents"))
    return found.withColumn("n_removed", F.col("n_equal") + F.col("n_near"))


RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query("op2_url_filter")
def op2(spark, folder):
    return url_filter.judge(table(spark, folder, "pages"), RULES)


DECONTAMINATE_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM item WHERE len(ws) > 0)
), spot AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(ws) >= n)
), hit AS (
  SELECT doc_id, item_id, i, n FROM spot JOIN phrase USING (n, k)
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words ON doc.doc_id = words.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
"""


@query("op3_decontaminate", DECONTAMINATE_SQL)
def op3(spark, folder):
    found = decontaminate.hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op4_quality_cnn")
def op4(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_cnn.score(docs, quality_cnn.fit(docs, labels))


#: Domains of the labelled table and the shares of words that the query asks for.
DOMAIN_SQL = "CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 END"
DOMAINS = ["low", "good", "toxic"]
TARGETS = [0.06, 0.88, 0.06]


@query("op5_mixing")
def op5(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = mixing.rates(docs, mixing.fit(docs, labels, F.expr(DOMAIN_SQL), len(DOMAINS)), TARGETS)
    return found.select("doc_id", "n_words", *[F.col("posterior")[d].alias(f"p_{n}") for d, n in enumerate(DOMAINS)], "rate", "copies")


@query("op6_prob_minhash")
def op6(spark, folder):
    return prob_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op7_quality_rules")
def op7(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality_gbt.judge(docs, quality_gbt.fit(docs, labels))


SUBSTRING_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM doc WHERE len(ws) >= 20)
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i
  FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), flat AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc
), kept AS (
  SELECT f.doc_id, string_agg(f.w, ' ' ORDER BY f.i) AS text, count(*) AS n
  FROM flat f ANTI JOIN removed r ON f.doc_id = r.doc_id AND f.i = r.i GROUP BY f.doc_id
)
SELECT doc.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""


@query("op8_substring_dedup", SUBSTRING_SQL)
def op8(spark, folder):
    cleaned = substring_dedup.without_repeats(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_token_files")
def op9(spark, folder):
    import public_tokenizers

    return token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op10_sharding")
def op10(spark, folder):
    placed = sharding.interleave(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_simhash")
def op11(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


HARD_NEGATIVE_SQL = """
WITH good AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER place AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW place AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER place <= 5
"""


@query("op12_hard_negatives", HARD_NEGATIVE_SQL)
def op12(spark, folder):
    return hard_negatives.mine(table(spark, folder, "embeddings"))


TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (  -- the polynomial of CRC-32, bit by bit over the bytes of the decimal id
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), made AS (
  SELECT c.conv_id, list({'r': t.role, 't': t.text} ORDER BY t.conv_id <> c.conv_id - c.conv_id % 20 OR t.place > h, t.place) FILTER (WHERE t.place IS NOT NULL) AS seq
  FROM crc c LEFT JOIN t ON (t.conv_id = c.conv_id - c.conv_id % 20 AND t.place <= h) OR (t.conv_id = c.conv_id AND t.place > h)
  GROUP BY c.conv_id
), member AS (
  SELECT conv_id, d, coalesce(seq, [])[1:d] AS path, d = len(coalesce(seq, [])) AS ends
  FROM (SELECT *, unnest(range(0, len(coalesce(seq, [])) + 1)) AS d FROM made)
), node AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM member GROUP BY path, d
), born AS (
  SELECT path[1:depth - 1] AS above, count(*) AS n FROM node WHERE depth > 0 GROUP BY above
), sized AS (
  SELECT node.*, coalesce(born.n, 0) AS n_children FROM node LEFT JOIN born ON node.path = born.above
), under AS (
  SELECT path[1:k] AS top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM sized) GROUP BY top
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children,
       CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
FROM sized s JOIN under u ON s.path = u.top LEFT JOIN node p ON s.depth > 0 AND p.path = s.path[1:s.depth - 1]
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark, folder):
    return prefix_trie.trie(table(spark, folder, "conversations"))

"""Sharding: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and get a fractional
rank there, ``(rank - phase) / rows of the source``, with a phase of its own
for each source.  In the order of that number every stretch of rows holds each
source in proportion, so equal cuts give shards with the mixture of the whole.
Law: ``rows`` - shard sizes differ by one row at most.

Ranks are exact and no source is ordered in one task: a source is split by the
high bits of the (even) hash, a rank is the rows of the lower buckets, summed
from small counts, plus the place within the bucket.  The same is done for the
fractional ranks, which are even by construction.

Defined results: a NULL source is a source of its own; a NULL text has size 1;
equal rows are neighbours in any order; with fewer rows than shards some shards
are empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
SEED = 20_260_101
BUCKET_ROWS = 2_000  #: rows for which a bucket is planned
MOST_BUCKETS = 65_536  #: their counts are summed in one task; beyond it buckets grow, results stay


def _even(value: Column) -> Column:
    """A hash as a number from 0 up to 1."""
    return F.shiftrightunsigned(value, 11) * F.lit(2.0**-53)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, carry: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, ``carry`` columns) of every document."""
    n = docs.count()
    buckets = max(64, min(n // bucket_rows, MOST_BUCKETS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)],
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    rows = rows.withColumn("bucket", F.floor(_even(F.col("draw")) * buckets))

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n_bucket"))
    whole = Window.partitionBy("stratum")
    below = counts.select(
        "stratum", "bucket",
        (F.sum("n_bucket").over(whole.orderBy("bucket")) - F.col("n_bucket")).alias("n_below"),
        F.sum("n_bucket").over(whole).alias("n_stratum"),
    )
    place = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("draw", "doc_id", "text_crc32", "size"))
    phase = _even(F.xxhash64(F.lit(seed), F.lit("phase"), "stratum"))
    ranked = (
        rows.withColumn("place", place)
        .join(below, ["stratum", "bucket"])
        .withColumn("part", (F.col("n_below") + F.col("place") - 1 + phase) / F.col("n_stratum"))
        .withColumn("cell", F.least(F.floor(F.col("part") * buckets), F.lit(buckets - 1).cast("long")))
    )
    cells = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n_cell"))
    before = cells.select("cell", (F.sum("n_cell").over(Window.orderBy("cell")) - F.col("n_cell")).alias("n_before"))
    turn = F.row_number().over(Window.partitionBy("cell").orderBy("part", "stratum", "draw", "doc_id", "text_crc32", "size"))
    index = F.col("n_before") + F.col("turn") - 1
    return (
        ranked.withColumn("turn", turn)
        .join(before, "cell")
        .withColumn("place", index)
        .withColumn("shard", F.expr(f"(place * {shards}L) DIV {max(n, 1)}L").cast("int"))
        .withColumn("slot", F.expr(f"place - (shard * {n}L + {shards - 1}L) DIV {shards}L"))
        .select("doc_id", "size", "text_crc32", "shard", "slot", *[F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)])
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """The documents as one folder per shard, rows in slot order within each file."""
    placed = interleave(docs, shards, seed, tuple(c for c in docs.columns if c != "doc_id"))
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Exact order statistics for groups of any size.

The built-in ``median`` merges every distinct value of a group in one task.
Here the input is a histogram (value, count), and the middle is selected in
rounds: approximate quantiles of the distinct values cut a group into buckets,
bucket totals tell where the middle ranks lie, and only those buckets go on.  They
are cut again until each holds ``FITS`` distinct values at most, which one task
sorts.  The result is exact for any cut, good or bad; each round leaves about one
value in ``BUCKETS``, so the rounds follow the logarithm of the largest group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohort_ledger.session import cut

BUCKETS = 32
FITS = 100_000  #: distinct values that one task sorts


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, count)`` of the non-NULL values; spreads a hot group over its values."""
    return (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _narrowed(rows: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """The rows of the buckets that hold a middle rank, each bucket a group of its own from here on."""
    level = [*keys, "_path"]
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    # Written once, because both passes over the rows must see the same cuts.
    cuts = cut(rows.groupBy(*level).agg(F.percentile_approx("value", shares, 2000).alias("_cuts")))
    above = [(F.col("value") > F.col("_cuts")[i]).cast("int") for i in range(len(shares))]
    placed = rows.join(cuts, level).withColumn("_bucket", reduce(lambda a, b: a + b, above))
    across = W.partitionBy(*level).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    wanted = (
        placed.groupBy(*level, "n", "_start", "_bucket")
        .agg(F.sum("count").alias("_in"))
        .withColumn("_end", F.col("_start") + F.sum("_in").over(across))
        .withColumn("_from", F.col("_end") - F.col("_in"))
        .filter(((F.col("_from") <= low) & (low < F.col("_end"))) | ((F.col("_from") <= high) & (high < F.col("_end"))))
        .select(*level, "_bucket", "_from")
    )
    kept = placed.join(wanted, [*level, "_bucket"])
    return cut(kept.select(*keys, (F.col("_path") * BUCKETS + F.col("_bucket")).alias("_path"), F.col("_from").alias("_start"), "n", "value", "count"))


def exact_middle(counts: DataFrame, keys: list[str], fits: int = FITS) -> DataFrame:
    """Per group: ``n``, and the exact ``lower`` and ``upper`` middle values.

    ``counts`` is a histogram.  ``lower`` and ``upper`` are the values at 0-based
    ranks ``(n-1) div 2`` and ``n div 2``; their mean is the median and
    ``upper`` the upper median.
    """
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    counts = cut(counts.select(*keys, "value", "count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    rows = counts.join(totals, keys).select(*keys, zero.alias("_path"), zero.alias("_start"), "n", "value", "count")
    while (rows.groupBy(*keys, "_path").count().agg(F.max("count")).first()[0] or 0) > fits:
        rows = _narrowed(rows, keys, low, high)
    inside = W.partitionBy(*keys, "_path").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = rows.withColumn("_rank", F.col("_start") + F.sum("count").over(inside))
    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("_rank") > low, F.col("value"))).alias("lower"),
        F.min(F.when(F.col("_rank") > high, F.col("value"))).alias("upper"),
    )


def exact_median(counts: DataFrame, keys: list[str], name: str = "median") -> DataFrame:
    """The exact median per group of a histogram: the mean of its middle values."""
    mid = exact_middle(counts, keys)
    return mid.select(*keys, ((F.col("lower") + F.col("upper")) / 2).cast("double").alias(name))

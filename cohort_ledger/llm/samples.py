"""Bounded labelled samples for fitting small models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS, F.lit(0))


def labelled(labels: DataFrame, value: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids outside fold 0, as (label_id, label).

    Rows without an id or a label are left out.  Of an id with several labels
    the smallest counts.  Where there are more ids, those with the smallest
    hash are taken, so the choice does not depend on row order.  ``bound`` is
    what makes it right to broadcast the result.
    """
    ids = (
        labels.select(F.col("doc_id").alias("label_id"), value.alias("label"))
        .where("label_id IS NOT NULL AND label IS NOT NULL")
        .where(fold("label_id") != 0)
        .groupBy("label_id")
        .agg(F.min("label").alias("label"))
    )
    return ids.orderBy(F.xxhash64(F.lit("sample"), "label_id"), "label_id").limit(bound)


def sample_of(docs: DataFrame, labels: DataFrame, value: Column, bound: int) -> DataFrame:
    """(doc_id, text, label) of the labelled sample, in one scan of the documents."""
    picked = F.broadcast(labelled(labels, value, bound))
    return docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")

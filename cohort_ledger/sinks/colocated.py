"""The three levels laid out so that joining them moves no rows.

Every row gets a ``place``, and each level is a bucketed table by it.  A place is a
patient, or a part of the specimens of a patient with more than ``PER_PLACE``
assays: such a patient has a row in each of its places, so no bucket holds more of
one patient than that.  Specimens and assays have one place.  Where a join's keys
include the place, the buckets of both sides meet as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.model import DEFAULT_SCHEMA, CohortSchema
from cohort_ledger.operators.views import joined
from cohort_ledger.session import cut

BUCKETS = 64
PER_PLACE = 100_000


def write_colocated(
    patients: DataFrame, specimens: DataFrame, assays: DataFrame, path: str, name: str,
    buckets: int = BUCKETS, per_place: int = PER_PLACE, schema: CohortSchema = DEFAULT_SCHEMA, counted: DataFrame | None = None,
) -> None:
    """Write the levels below ``path`` as the bucketed tables ``<name>_patient`` and so on.

    Rows whose parent is not there are kept, in a place of their own parent key.
    ``counted`` are the assays with no more than their specimen, where those can be
    read for less: they are only counted, before any row can be placed.
    """
    patient, specimen = schema.key("patient"), schema.key("specimen")
    per_specimen = (assays if counted is None else counted).groupBy(specimen).agg(F.count(F.lit(1)).alias("_n"))
    of = specimens.select(specimen, patient).join(per_specimen, specimen, "left")
    parts = of.groupBy(F.col(patient).alias("_patient")).agg(F.greatest(F.lit(1), F.ceil(F.sum("_n") / per_place)).cast("int").alias("_parts"))
    parts = cut(parts.filter(F.col("_patient").isNotNull()))

    def place(key, part):
        return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("#"), part.cast("string")).alias("place")

    part = F.pmod(F.xxhash64(specimen), F.coalesce("_parts", F.lit(1)).cast("long"))
    placed = cut(specimens.join(parts, F.col(patient) == F.col("_patient"), "left").select(*[specimens[c] for c in specimens.columns], place(specimens[patient], part)))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    spread = patients.join(parts, F.col(patient) == F.col("_patient"), "left").select(*[patients[c] for c in patients.columns], every)
    own = placed.select(F.col(specimen).alias("_specimen"), F.col("place").alias("_place")).distinct()
    carried = assays.join(own, F.col(specimen) == F.col("_specimen"), "left")
    lost = F.concat(F.lit("?"), F.coalesce(F.col(specimen).cast("string"), F.lit("")))
    levels = {
        "patient": spread.select(*patients.columns, place(F.col(patient), F.col("_part"))),
        "specimen": placed,
        "assay": carried.select(*assays.columns, F.coalesce("_place", lost).alias("place")),
    }
    for level, rows in levels.items():
        writer = rows.repartition(buckets, "place").write.mode("overwrite").option("path", f"{path}/{level}")
        writer.bucketBy(buckets, "place").sortBy("place").saveAsTable(f"{name}_{level}")


def read_colocated(spark: SparkSession, name: str) -> dict[str, DataFrame]:
    """The placed levels; joins of them by place and key need no exchange from here on."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return {level: spark.table(f"{name}_{level}") for level in ("patient", "specimen", "assay")}


def joined_colocated(levels: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """``joined`` of placed levels, bucket by bucket."""
    return joined(*levels.values(), schema, by=("place",)).drop("place")


def patients_of(levels: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """The patients once each, without their places."""
    return levels["patient"].dropDuplicates([schema.key("patient")]).drop("place")

"""The cohort model read from the star-schema tables.

Each property is a lazy DataFrame over the parquet files, so column pruning and
filters reach the scans.  ``snapshot`` writes the mapped tables once; reading
them back (``Model(spark, folder, mapped=True)``) is how a deployment would run,
with the model tables already on disk.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import cohort_node
from cohort_ledger.model import LOG_SCHEMA
from cohort_ledger.operators.qc import recompute_status, with_derived_status
from cohort_ledger.session import cut

MODEL_TABLES = (
    "patients",
    "specimens",
    "assays",
    "batches",
    "qc_events",
    "cohort_artifacts",
    "cohort_artifact_inputs",
    "reference_artifacts",
    "reference_usage",
    "artifact_derivation",
    "assay_sources",
    "sheet",
)
ROWS_PER_PART = 100_000
ASSAY_KEY = ["specimen_id", "l_linenumber", "l_partkey", "l_suppkey"]
AS_OF = "2024-06-01 00:00:00"


class Model:
    """Lazily mapped model tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str, mapped_folder: str | None = None):
        self.spark, self.folder, self.mapped_folder = spark, folder, mapped_folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _mapped(self, name: str) -> DataFrame | None:
        if self.mapped_folder:
            return self.spark.read.parquet(f"{self.mapped_folder}/{name}")
        return None

    def snapshot(self, path: str) -> None:
        for name in MODEL_TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @cached_property
    def assay_rows(self) -> DataFrame:
        """Assays without status: line items grouped by their full key.

        The rows are dealt by specimen before they are grouped, in parts whose number grows
        with the rows, so a task groups one small part, and what follows by specimen needs
        no further exchange.
        """
        if self.mapped_folder:
            return self._mapped("assays").drop("qc_status")
        return self._grouped(self._lines)

    @property
    def _lines(self) -> DataFrame:
        """The line items, with the specimen of each."""
        return self.raw("lineitem").withColumn("specimen_id", F.col("l_orderkey").cast("string"))

    def _grouped(self, lines: DataFrame, *more) -> DataFrame:
        """Assays of the lines, with ``more`` aggregates of each at the end."""
        parts = -(-self.raw("lineitem").count() // ROWS_PER_PART)
        grouped = (
            lines.repartition(max(parts, 1), "specimen_id")
            .groupBy(*ASSAY_KEY)
            .agg(
                F.min("l_returnflag").alias("flag"),
                F.min("l_linestatus").alias("line"),
                F.min("l_quantity").alias("qty"),
                F.min("l_shipdate").alias("ship"),
                *more,
            )
        )
        known = (*ASSAY_KEY, "flag", "line", "qty", "ship")
        return grouped.select(
            F.concat_ws("-", *ASSAY_KEY).alias("assay_id"),
            "specimen_id",
            F.col("flag").alias("assay_type"),
            F.col("l_suppkey").cast("string").alias("batch_id"),
            F.col("qty").alias("n_reads"),
            F.when(F.col("line") == "F", F.col("ship")).alias("flagstat_done"),
            F.when(F.col("qty") > 10, F.col("ship")).alias("modkit_done"),
            *[c for c in grouped.columns if c not in known],
        )

    @cached_property
    def assay_ids(self) -> DataFrame:
        """(specimen_id, assay_id) of every line item, repeats included, for what repeats do not change."""
        if self.mapped_folder:
            return self._mapped("assays").select("specimen_id", "assay_id")
        key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("string").alias("specimen_id"), F.concat_ws("-", *key).alias("assay_id")
        )

    @cached_property
    def patient_rows(self) -> DataFrame:
        """Patients without status."""
        if self.mapped_folder:
            return self._mapped("patients").drop("qc_status")
        turn = F.col("c_custkey") % 20
        status = (
            F.when(turn == 0, "revoked")
            .when(turn == 1, "pending")
            .when(turn == 2, "consented_limited_use")
            .when(turn == 3, "withdrawn")
            .otherwise("consented")
        )
        return self.raw("customer").select(
            F.col("c_custkey").cast("string").alias("patient_id"),
            F.col("c_mktsegment").alias("cohort"),
            F.col("c_nationkey").cast("string").alias("site"),
            status.alias("consent_status"),
            F.when(turn.isin(0, 3) & (F.col("c_custkey") % 60 != 0), F.lit("2024-05-01"))
            .cast("date")
            .alias("withdrawal_date"),
        )

    @cached_property
    def patients(self) -> DataFrame:
        mapped = self._mapped("patients")
        if mapped is not None:
            return mapped
        return recompute_status(self.patient_rows, self.qc_events, "patient")

    @cached_property
    def specimen_rows(self) -> DataFrame:
        """Specimens without status."""
        if self.mapped_folder:
            return self._mapped("specimens").drop("qc_status")
        return self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("specimen_id"),
            F.col("o_custkey").cast("string").alias("patient_id"),
            F.col("o_orderstatus").alias("tissue_site"),
            F.col("o_orderpriority").alias("timepoint"),
            F.col("o_orderdate").alias("collection_date"),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("merge_done"),
        )

    @cached_property
    def specimens(self) -> DataFrame:
        mapped = self._mapped("specimens")
        if mapped is not None:
            return mapped
        return recompute_status(self.specimen_rows, self.qc_events, "specimen")

    @cached_property
    def assays(self) -> DataFrame:
        """Assays with their status.

        A status finds the lines of its assay by narrow rows, and goes to them where they are
        grouped: so the whole rows are dealt out once, by specimen, and not again by assay.
        """
        mapped = self._mapped("assays")
        if mapped is not None:
            return mapped
        keys = self._lines.select(*ASSAY_KEY)
        found = with_derived_status(keys, F.concat_ws("-", *ASSAY_KEY), self.qc_events, "assay")
        # A found line holds nothing but its key and status, so the least values are those of the lines.
        lines = self._lines.select(*ASSAY_KEY, "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate")
        return self._grouped(
            lines.unionByName(found, allowMissingColumns=True), F.coalesce(F.max("qc_status"), F.lit("pass")).alias("qc_status")
        )

    @cached_property
    def input_assays(self) -> DataFrame:
        """(assay_id, specimen_id, qc_status) of the assays that are inputs of an artifact.

        Line items are dealt out once, by assay; all that is joined by assay then stays
        where it is, and only inputs go on.
        """
        wanted = self.cohort_artifact_inputs.select("assay_id")
        if self.mapped_folder:
            return self.assays.select("assay_id", "specimen_id", "qc_status").join(wanted, "assay_id", "left_semi")
        named = self.assay_ids.join(wanted, "assay_id", "left_semi").distinct()
        return recompute_status(named.select("assay_id", "specimen_id"), self.qc_events, "assay")

    @cached_property
    def batches(self) -> DataFrame:
        mapped = self._mapped("batches")
        if mapped is not None:
            return mapped
        return self.raw("supplier").select(
            F.col("s_suppkey").cast("string").alias("batch_id"), F.col("s_name").alias("operator")
        )

    @cached_property
    def qc_events(self) -> DataFrame:
        mapped = self._mapped("qc_events")
        if mapped is not None:
            return mapped
        turn = F.col("event_id") % 3
        events = self.raw("events")

        # The level is a literal in each branch, so a filter on it prunes the others.
        def branch(n: int, level: str) -> DataFrame:
            return events.filter(turn == n).withColumn("level", F.lit(level))

        on_patients = branch(0, "patient").withColumn("entity_id", F.col("user_id").cast("string"))
        on_specimens = branch(1, "specimen").withColumn(
            "entity_id", F.col("event_id").cast("string")
        )
        first_assay = self.assay_ids.groupBy("specimen_id").agg(F.min("assay_id").alias("entity_id"))
        on_assays = (
            branch(2, "assay")
            .withColumn("specimen_id", F.col("event_id").cast("string"))
            .join(first_assay, "specimen_id")
            .drop("specimen_id")
        )
        patient, kind_of = F.col("level") == "patient", F.col("event_type")
        kind = (
            F.when(kind_of == "error", F.when(patient, "consent_revoked").otherwise("qc_fail"))
            .when(kind_of == "purchase", "qc_warn")
            .when(kind_of == "signup", "other")
            .when(kind_of == "click", F.when(patient, "qc_fail").otherwise("protocol_deviation"))
            .when(kind_of == "view", "batch_effect_flagged")
        )
        resolved = F.col("event_id") % 10 != 0
        return on_patients.unionByName(on_specimens).unionByName(on_assays).select(
            F.col("event_id").cast("string").alias("id"),
            "level",
            "entity_id",
            kind.alias("kind"),
            F.concat(F.lit("reported as "), F.col("event_type")).alias("reason"),
            F.lit("import").alias("source"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("created_by"),
            F.when(resolved, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("resolved_at"),
            F.when(resolved, F.lit("reviewer")).alias("resolved_by"),
            F.when(resolved, F.lit("reviewed")).alias("resolved_reason"),
            F.concat(F.lit("txn"), F.col("event_id").cast("string")).alias("transaction_id"),
        )

    @cached_property
    def cohort_artifacts(self) -> DataFrame:
        mapped = self._mapped("cohort_artifacts")
        if mapped is not None:
            return mapped
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("artifact_id"),
            F.col("p_brand").alias("analysis"),
            F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("run_tag"),
            F.col("p_type").alias("region_scope"),
        )

    @cached_property
    def cohort_artifact_inputs(self) -> DataFrame:
        mapped = self._mapped("cohort_artifact_inputs")
        if mapped is not None:
            return mapped
        return (
            self.raw("lineitem")
            .filter("l_linenumber = 1")
            .groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .agg(F.min("l_quantity").alias("qty"))
            .filter("qty > 25")
            .select(
                F.col("l_partkey").cast("string").alias("artifact_id"),
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias(
                    "assay_id"
                ),
            )
        )

    @cached_property
    def reference_artifacts(self) -> DataFrame:
        mapped = self._mapped("reference_artifacts")
        if mapped is not None:
            return mapped
        return self.raw("nation").select(
            F.col("n_name").alias("ref_key"),
            F.concat(F.lit("v"), F.col("n_regionkey").cast("string")).alias("version"),
        )

    @cached_property
    def reference_usage(self) -> DataFrame:
        mapped = self._mapped("reference_usage")
        if mapped is not None:
            return mapped
        refs = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        current = F.concat(F.lit("v"), F.coalesce("n_regionkey", F.lit(0)).cast("string"))
        none = F.lit(None).cast("string")
        return (
            self.raw("part")
            .select("p_partkey", "p_brand", (F.col("p_size") % 27).alias("n_nationkey"))
            .join(refs, "n_nationkey", "left")
            .select(
                F.lit("cohort").alias("scope"),
                none.alias("entity_level"),
                none.alias("entity_id"),
                F.col("p_brand").alias("analysis"),
                F.col("p_partkey").cast("string").alias("artifact_id"),
                F.coalesce("n_name", F.lit("REMOVED")).alias("ref_key"),
                F.when(F.col("p_partkey") % 10 == 0, F.lit("v_old"))
                .otherwise(current)
                .alias("version_used"),
            )
        )

    @cached_property
    def artifact_derivation(self) -> DataFrame:
        mapped = self._mapped("artifact_derivation")
        if mapped is not None:
            return mapped
        parts = self.raw("part").select("p_partkey", "p_brand")

        def node(frame, key, out):
            tag = F.concat(F.lit("r"), F.col("p_partkey").cast("string"))
            return frame.select(
                F.col("p_partkey").alias(key), cohort_node(F.col("p_brand"), tag).alias(out)
            )

        down = node(parts.filter("p_partkey > 0 AND p_partkey % 4 <> 0"), "down", "down_node")
        up = node(parts, "up", "up_node")
        return (
            down.withColumn("up", F.expr("down div 2"))
            .join(up, "up")
            .select("down_node", "up_node")
        )

    @cached_property
    def assay_sources(self) -> DataFrame:
        mapped = self._mapped("assay_sources")
        if mapped is not None:
            return mapped
        lines = self.assay_rows.select(
            "assay_id", "specimen_id", F.split_part("assay_id", F.lit("-"), F.lit(2)).cast("int").alias("line")
        )
        none = F.lit(None).cast("string")
        # The first assay of the line before, with one exchange by specimen.
        before = Window.partitionBy("specimen_id").orderBy("line").rangeBetween(-1, -1)
        merged = (
            lines.filter("specimen_id IS NOT NULL AND line IS NOT NULL")
            .withColumn("merged_assay_id", F.min("assay_id").over(before))
            .filter("merged_assay_id IS NOT NULL")
            .select(
                F.col("assay_id").alias("source_assay_id"),
                "merged_assay_id",
                none.alias("consumer_specimen_id"),
            )
        )
        consumers = lines.filter("line = 1").select(
            F.col("assay_id").alias("source_assay_id"),
            none.alias("merged_assay_id"),
            F.col("specimen_id").alias("consumer_specimen_id"),
        )
        return merged.unionByName(consumers)

    @cached_property
    def projects(self) -> DataFrame:
        """Project meta rows: one per nation, with a lifecycle state by region."""
        turn = F.col("n_regionkey") % 3
        return self.raw("nation").select(
            F.col("n_name").alias("project"),
            F.when(turn == 0, "active").when(turn == 1, "archived").otherwise("complete").alias("status"),
        )

    @cached_property
    def qc_log(self) -> DataFrame:
        """Provenance entries that would have led to the events.

        Every event has a censor entry; a resolved one also an uncensor entry,
        333 events later.
        """
        ev = self.qc_events.withColumn("_n", F.col("id").cast("bigint"))

        def entry(frame, action, seq, at, **values):
            row = {
                "seq": seq,
                "timestamp": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"),
                "action": F.lit(action),
                "level": F.col("level"),
                "entity_id": F.col("entity_id"),
                "kind": F.col("kind"),
                "qc_event_id": F.col("id"),
                "transaction_id": F.col("transaction_id"),
                **values,
            }
            return frame.select(
                *[
                    row.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in LOG_SCHEMA.fields
                ]
            )

        opened = entry(
            ev, "censor", F.col("_n") * 2, F.col("created_at"),
            reason=F.col("reason"), created_by=F.col("created_by"), source=F.col("source"),
            withdrawal_date=F.when(F.col("kind") == "consent_revoked", F.lit("2024-05-01")),
        )
        closed = entry(
            ev.filter(F.col("resolved_at").isNotNull()), "uncensor",
            (F.col("_n") + 333) * 2 + 1, F.col("resolved_at"),
            reason=F.col("resolved_reason"), resolved_by=F.col("resolved_by"),
        )
        return opened.unionByName(closed)

    @cached_property
    def sheet(self) -> DataFrame:
        """A wide sample sheet: assays with their specimen and patient columns."""
        if self.mapped_folder:
            return self._mapped("sheet")
        orders = self.raw("orders").select(
            F.col("o_orderkey").cast("string").alias("specimen_id"),
            "o_custkey",
            F.col("o_orderstatus").alias("tissue_site"),
            F.col("o_orderpriority").alias("timepoint"),
        )
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_custkey").cast("string").alias("patient_id"),
            F.col("c_mktsegment").alias("cohort"),
            F.col("c_nationkey").cast("string").alias("site"),
        )
        return (
            self.assay_rows.select("assay_id", "specimen_id", "assay_type", "batch_id")
            .join(orders.join(customers, "o_custkey"), "specimen_id")
            .select(
                "patient_id", "cohort", "site", "specimen_id", "tissue_site", "timepoint",
                "assay_id", "assay_type", "batch_id",
            )
        )

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {"patient": self.patients, "specimen": self.specimens, "assay": self.assays}

    @property
    def level_rows(self) -> dict[str, DataFrame]:
        """The levels without status, for plans that do not read it: the status costs a join for each level."""
        return {"patient": self.patient_rows, "specimen": self.specimen_rows, "assay": self.assay_rows}

    def written_levels(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The levels, worked out once and written to the shared folder, for plans that read them several times.

        The assay rows are then those of the written assays.
        """
        if self.mapped_folder:
            return self.levels
        self.patients, self.specimens, self.assays = (cut(t) for t in self.levels)
        self.assay_rows = self.assays.drop("qc_status")
        return self.levels

    @property
    def input_levels(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The levels, with no other assays than inputs of artifacts."""
        return self.patients, self.specimens, self.input_assays

    @property
    def levels(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.patients, self.specimens, self.assays

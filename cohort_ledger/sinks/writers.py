"""Table writers and the cohort exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohort_ledger.model import DEFAULT_SCHEMA, CohortSchema
from cohort_ledger.operators import views
from cohort_ledger.operators.active import active_level, exclusion_breakdown
from cohort_ledger.session import cut


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write as tsv, csv, json or parquet; nested columns become JSON text in flat formats."""
    writer = {"tsv": "csv", "csv": "csv", "json": "json", "parquet": "parquet"}.get(fmt)
    if writer is None:
        raise ValueError(f"unknown format {fmt!r}")
    if writer == "csv":
        nested = ("array", "map", "struct")
        df = df.select(
            *[
                F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c)
                for c, kind in df.dtypes
            ]
        )
        df.write.mode(mode).option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        getattr(df.write.mode(mode), writer)(path)


def export_plan(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    subset: DataFrame | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
    **side_tables: DataFrame,
) -> dict[str, DataFrame]:
    """The frames of a per-level export: active rows, optionally a subset of assays.

    With ``subset`` (a frame of assay keys) the levels above keep only what the
    chosen assays belong to; the chosen rows are written to the shared folder.  Artifacts among the side tables are marked by the
    staleness of their inputs where ``cohort_artifact_inputs`` is there too.
    """
    flags = (include_censored, include_consent_revoked)
    out = {
        lv.table: active_level(lv.name, patients, specimens, assays, *flags, schema)
        for lv in schema.levels
    }
    if subset is not None:
        child = None
        for lv in reversed(schema.levels):
            keys = (
                subset.select(lv.key)
                if child is None
                else out[child.table].select(F.col(child.parent_key).alias(lv.key))
            )
            # Distinct first: a parent of very many children is one row per task.
            # Cut: the levels above and the writer read the chosen rows, not the whole chain again.
            out[lv.table] = cut(out[lv.table].join(keys.distinct(), lv.key, "left_semi"))
            child = lv
    if {"cohort_artifacts", "cohort_artifact_inputs"} <= side_tables.keys():
        usable = None
        if subset is None and not any(flags):
            # Cut: the usable assays are what is exported, so the cascade is worked out once for both.
            finest = schema.levels[-1]
            out[finest.table] = cut(out[finest.table])
            usable = out[finest.table].select(finest.key)
        marked = views.with_input_staleness(
            side_tables["cohort_artifacts"], side_tables["cohort_artifact_inputs"], patients, specimens, assays, usable
        )
        side_tables = {**side_tables, "cohort_artifacts": marked}
    out.update(side_tables)
    return out


def export_tables(frames: dict[str, DataFrame], root: str, fmt: str = "tsv") -> dict[str, str]:
    """Write every frame of an export plan below ``root``."""
    paths = {name: f"{root}/{name}" for name in frames}
    for name, frame in frames.items():
        write_table(frame, paths[name], fmt)
    return paths


def export_joined(
    patients: DataFrame,
    specimens: DataFrame,
    assays: DataFrame,
    path: str,
    fmt: str = "parquet",
    include_censored: bool = False,
    include_consent_revoked: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """The joined view under the cascade, each flag honoured on its own."""
    frame = views.active(
        patients, specimens, assays, include_censored, include_consent_revoked, schema
    )
    write_table(frame, path, fmt)
    return frame


def export_sql(spark: SparkSession, sql: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Write the result of a query over the registered views."""
    frame = spark.sql(sql)
    write_table(frame, path, fmt)
    return frame


def export_audit(patients: DataFrame, specimens: DataFrame, assays: DataFrame) -> DataFrame:
    """Counts of what the cascade removed, by reason."""
    return (
        exclusion_breakdown(patients, specimens, assays)
        .groupBy("reason", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def collect_capped(df: DataFrame, row_limit: int = 10_000) -> tuple[list[Row], bool]:
    """At most ``row_limit`` rows for display, and whether there were more."""
    rows = df.limit(row_limit + 1).collect()
    return rows[:row_limit], len(rows) > row_limit

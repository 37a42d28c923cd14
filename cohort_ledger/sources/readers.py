"""File readers for manifests, sheets, result trees and the provenance log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger.functions.paths import path_fields
from cohort_ledger.model import DEFAULT_SCHEMA, LOG_SCHEMA, CohortSchema


def _delimited(spark: SparkSession, sep: str = "\t"):
    return spark.read.option("sep", sep).option("header", True)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _by_name(
    spark: SparkSession, path: str | list[str], schema: T.StructType, required: list[str] | None = None, sep: str = "\t"
) -> DataFrame:
    """Columns of a delimited file by their header names, in the schema's types.

    The file may hold the columns in any order, and others beside them.  Absent
    columns are NULL unless ``required`` (all, if not given); a cell that does
    not parse is NULL.  Files of a folder must agree in their header.
    """
    text = _delimited(spark, sep).option("enforceSchema", False).csv(path)
    missing = [n for n in (schema.names if required is None else required) if n not in text.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")

    def cell(f: T.StructField):
        value = F.col(f"`{f.name}`") if f.name in text.columns else F.lit(None).cast("string")
        return (value if f.dataType == T.StringType() else F.trim(value).try_cast(f.dataType)).alias(f.name)

    return text.select(*[cell(f) for f in schema.fields])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A flat manifest.  Without a schema the types are sniffed over the file."""
    return _by_name(spark, path, schema) if schema else _delimited(spark).option("inferSchema", True).csv(path)


def _headers(spark: SparkSession, root: str, pattern: str, max_depth: int) -> DataFrame:
    """``(path, header)`` of each matching file up to a depth, in one job.

    Folders are listed by Spark and first lines read in tasks, from the first
    block of each file.  Hidden and ``sandbox`` folders are left out.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    lines = reader.text(root).select(path.alias("path"), F.col("_metadata.file_block_start").alias("_start"), "value")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(place).toUri().getPath().rstrip("/")
    below = F.substring_index("path", base + "/", -1)
    folders = F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    kept = (F.size(folders) <= max_depth) & ~F.exists(folders, lambda x: x.startswith(".") | (x == "sandbox"))
    first = lines.filter((F.col("_start") == 0) & kept).withColumn("_at", F.monotonically_increasing_id())
    return first.groupBy("path").agg(F.min_by("value", "_at").alias("header"))


def read_manifests_union(
    spark: SparkSession, root: str, pattern: str = "*.tsv", max_depth: int = 3
) -> DataFrame:
    """All manifests below a root as one table, by column name, missing cells NULL.

    Adds ``project`` (the parent folder) and ``manifest_columns``.  Headers are read
    in tasks; the driver gets each file's name and header line.  Manifests with the
    same header share one scan, and every column stays text so that types cannot
    clash.  A file without a line has no rows.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(_headers(spark, root, pattern, max_depth).collect()):
        by_header.setdefault(tuple(row.header.split("\t")), []).append(row.path)
    if not by_header:
        raise FileNotFoundError(f"no {pattern!r} below {root}")
    parts = []
    for header, paths in by_header.items():
        frame = _delimited(spark).schema(_strings(list(header))).csv(paths)
        parts.append(
            frame.select(
                F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\z", 1).alias("project"),
                F.array(*[F.lit(c) for c in header]).alias("manifest_columns"),
                "*",
            )
        )
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_levels(
    spark: SparkSession, path: str, schema: CohortSchema = DEFAULT_SCHEMA
) -> dict[str, DataFrame]:
    """The level tables of a snapshot folder, also as temporary views."""
    tables = {lv.name: spark.read.parquet(f"{path}/{lv.table}") for lv in schema.levels}
    for lv in schema.levels:
        tables[lv.name].createOrReplaceTempView(lv.table)
    return tables


def read_sample_sheet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A wide sample sheet, every column text."""
    return _by_name(spark, path, _strings(columns)) if columns else _delimited(spark).csv(path)


def read_results(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None = None
) -> DataFrame:
    """Summary tables of an analysis; a folder of files is one job."""
    return _by_name(spark, path, schema) if schema else _delimited(spark).option("inferSchema", True).csv(path)


def infer_layout(
    frame: DataFrame, path: str, templates: dict[str, str], analyses: dict[str, dict]
) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether their path column maps to a declared analysis.

    Returns matched rows with the path's fields, and rejects with a reason.
    """
    levels = F.lit(None).cast("string")
    prefixes = F.lit(None).cast("string")
    for tool, spec in analyses.items():
        levels = F.when(F.col("_f.tool") == tool, F.lit(spec["level"])).otherwise(levels)
        prefixes = F.when(F.col("_f.tool") == tool, F.lit(spec.get("column_prefix"))).otherwise(prefixes)
    marked = frame.withColumn("_f", path_fields(F.col(path), templates))
    marked = marked.withColumn("_declared", levels).withColumn("column_prefix", prefixes)
    reason = (
        F.when(F.col("_f").isNull(), "no_template_matches")
        .when(F.col("_declared").isNull(), "tool_not_declared")
        .when(F.col("_declared") != F.col("_f.level"), "level_disagrees")
    )
    marked = marked.withColumn("reject", reason)
    taken = set(frame.columns)
    names = [n for n in ("level", "tool", "run_tag", "patient_id", "specimen_id", "assay_id")]
    fields = [F.col(f"_f.{n}").alias(n if n not in taken else f"path_{n}") for n in names]
    good = marked.filter(F.col("reject").isNull()).select(*frame.columns, *fields, "column_prefix")
    return good, marked.filter(F.col("reject").isNotNull()).select(*frame.columns, "reject")


def read_results_by_layout(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    templates: dict[str, str],
    analyses: dict[str, dict],
    glob: str = "*.tsv",
) -> tuple[DataFrame, DataFrame]:
    """A whole result tree in one scan, with entity keys taken from the paths."""
    frame = (
        _delimited(spark)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .schema(schema)
        .csv(root)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    marker = root.rstrip("/").split("://")[-1].removeprefix("file:")
    # Templates name folders, so the file name is left out.
    folder = F.regexp_replace(F.url_decode("_path"), r"/[^/]*\z", "/")
    relative = F.rtrim(F.substring_index(folder, marker + "/", -1), F.lit("/"))
    return infer_layout(frame.withColumn("_path", relative), "_path", templates, analyses)


def read_event_log(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """The provenance log as rows of the log schema.

    A line that is no JSON object is dropped, or fails the read when ``strict``.
    Each field is parsed by itself, so one odd field is NULL and the rest of its
    line stays, whatever columns are asked for.  Lines without ``seq`` are
    numbered through all files in the order of their names: by the place of the
    file, then of the line in it (files of up to a terabyte).
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    first = lines.groupBy("_file", "_block").agg(F.min("_id").alias("_first"))
    files = lines.select("_file").distinct()
    ranks = files.select("_file", (F.row_number().over(W.orderBy("_file")) - 1).cast("bigint").alias("_rank"))
    place = F.col("_rank") * (1 << 40) + F.col("_block") + F.col("_id") - F.col("_first")
    entry = F.parse_json("value") if strict else F.try_parse_json("value")
    rows = (
        lines.filter(F.trim("value") != "")
        .join(first, ["_file", "_block"])
        .join(ranks, "_file")
        .select(place.alias("_place"), entry.alias("_entry"))
        .filter(F.schema_of_variant("_entry").startswith("OBJECT"))
    )

    def field(f: T.StructField):
        return F.try_variant_get("_entry", f"$.{f.name}", f.dataType.simpleString()).alias(f.name)

    return rows.select("_place", *[field(f) for f in LOG_SCHEMA.fields]).withColumn("seq", F.coalesce("seq", "_place")).drop("_place")


def _required(frame: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    blank = [
        F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in names
    ]
    missing = F.array_compact(F.array(*blank))
    marked = frame.withColumn("reject", F.when(F.size(missing) > 0, F.concat(F.lit("blank: "), F.array_join(missing, ", "))))
    return (
        marked.filter(F.col("reject").isNull()).drop("reject"),
        marked.filter(F.col("reject").isNotNull()),
    )


def read_bulk_qc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bulk censor rows, and the rows with a blank required cell."""
    names = ["level", "entity_id", "kind", "reason"]
    return _required(_by_name(spark, path, _strings(names)), names)


def read_bulk_lineage(
    spark: SparkSession, path: str, kind: str = "links", sep: str = "\t"
) -> tuple[DataFrame, DataFrame]:
    """Bulk batches or links; the delimiter is explicit.

    Only the id column must be there, and for links one of the two targets.
    """
    if kind == "batches":
        names, required = ["batch_id", "prep_date", "reagent_lot", "operator", "notes"], ["batch_id"]
    else:
        names = ["source_assay_id", "merged_assay_id", "consumer_specimen_id"]
        required = ["source_assay_id"]
        header = _delimited(spark, sep).csv(path).columns
        if not set(names[1:]) & set(header):
            raise ValueError(f"{path} has neither of the columns {names[1:]}")
    return _required(_by_name(spark, path, _strings(names), required, sep), required)


def parse_artifact_inputs(frame: DataFrame, column: str) -> DataFrame:
    """``id:role,id:role`` lists as ``(…, assay_id, role)`` rows."""
    item = F.trim(F.col("_item"))
    return (
        frame.withColumn("_item", F.explode(F.split(F.col(column), ",")))
        .filter(item != "")
        .select(
            *[c for c in frame.columns if c != column],
            F.trim(F.substring_index(item, ":", 1)).alias("assay_id"),
            F.nullif(F.trim(F.regexp_extract(item, r":(.*)\z", 1)), F.lit("")).alias("role"),
        )
    )


def read_artifact_inputs(spark: SparkSession, path: str) -> DataFrame:
    """An inputs file: one id per line, or a table whose header names ``assay_id`` and maybe ``role``.

    The first cell is the id.  A role counts only under a header of that name.
    """
    lines = spark.read.text(path)
    top = lines.first()
    names = [c.strip().lower() for c in top.value.split("\t")] if top else []
    headed = bool(names) and names[0] == "assay_id"
    if headed:
        lines = lines.filter(F.col("value") != top.value)
    cells = F.split("value", "\t")
    role = F.trim(F.get(cells, F.lit(names.index("role")))) if headed and "role" in names else F.lit(None).cast("string")
    return lines.filter(F.trim("value") != "").select(
        F.trim(F.get(cells, F.lit(0))).alias("assay_id"),
        F.nullif(role, F.lit("")).alias("role"),
    )


def init_manifest(
    spark: SparkSession,
    samples: str,
    metadata: DataFrame | None = None,
    cols: list[str] = (),
    key: str = "sample_id",
) -> DataFrame:
    """A new manifest from an id list, optional metadata and empty columns."""
    ids = (
        spark.read.text(samples)
        .select(F.trim("value").alias(key))
        .filter((F.col(key) != "") & ~F.col(key).startswith("#"))
    )
    frame = ids if metadata is None else ids.join(metadata, key, "left")
    return frame.select("*", *[F.lit(None).cast("string").alias(c) for c in cols if c not in frame.columns])

"""Ingest transforms: merging results, upserting metadata, splitting wide sheets.

All merges go through one helper that first reduces the incoming rows to one per
key (combined before the shuffle, so a key repeated a billion times is one row
per task) and then joins once.  The reduction and the join share a partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger.functions.ids import id_rule
from cohort_ledger.functions.nodes import analysis_node
from cohort_ledger.functions.qc import to_boolean
from cohort_ledger.model import (
    AUTOFLAG_COLUMNS,
    DEFAULT_SCHEMA,
    DONE_SUFFIX,
    QC_EXCLUDED,
    QC_MANAGED_COLUMNS,
    SPARK_TYPES,
    CohortSchema,
)
from cohort_ledger.operators.artifacts import record_usage
from cohort_ledger.session import cut


def one_per_key(
    rows: DataFrame, key: str, order_col: str | None = None, keep: str = "first_value"
) -> DataFrame:
    """Reduce to one row per key.

    ``first_value`` takes each column's first non-NULL value, ``first_row`` and
    ``last_row`` take a whole row.  Rows have no order of their own: without
    ``order_col`` the smallest (for ``last_row`` the largest) value or row
    stands in, which is deterministic.
    """
    columns = [c for c in rows.columns if c not in (key, order_col)]
    grouped = rows.groupBy(key)
    if keep == "first_value":
        if order_col is None:
            picks = [F.min(c).alias(c) for c in columns]
        else:
            picks = [
                F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c)
                for c in columns
            ]
        return grouped.agg(*picks) if picks else rows.select(key).distinct()
    if not columns:
        return rows.select(key).distinct()
    whole = F.struct(*columns)
    if order_col is None:  # the rows are their own order, and are carried once
        picked = F.min(whole) if keep == "first_row" else F.max(whole)
    else:
        picked = (F.min_by if keep == "first_row" else F.max_by)(whole, F.col(order_col))
    return grouped.agg(picked.alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in columns]
    )


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys given more than once, with their number of copies."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _meeting(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds every value of both unchanged: numbers widen, text is the last resort."""
    if a == b:
        return a
    kinds = (a, b)
    if all(isinstance(t, T.IntegralType) for t in kinds):
        return T.LongType()
    if all(isinstance(t, (T.IntegralType, T.DecimalType)) for t in kinds):
        scale = max(getattr(t, "scale", 0) for t in kinds)
        whole = max(t.precision - t.scale if isinstance(t, T.DecimalType) else _DIGITS[type(t)] for t in kinds)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    exact = (T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType)
    return T.DoubleType() if all(isinstance(t, exact) for t in kinds) else T.StringType()


def plain_text(column: Column, kind: T.DataType) -> Column:
    """A value as text, equal numbers of all kinds alike: whole ones without a point or exponent."""
    text = column.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 2.0**63)
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(text)
    if isinstance(kind, T.DecimalType) and kind.scale:
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return text


def _as(column: Column, own: T.DataType, kind: T.DataType) -> Column:
    """A column of type ``own`` as ``kind``."""
    if own == kind:
        return column
    return plain_text(column, own) if isinstance(kind, T.StringType) else column.cast(kind)


def aligned(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with ``_key``, by which their keys are compared.

    Keys of different types meet in a type that holds both unchanged, so that
    comparing neither fails nor takes two keys for one.
    """
    types = [f.schema[key].dataType for f in (left, right)]
    kind = _meeting(*types)
    return tuple(f.withColumn("_key", _as(F.col(key), own, kind)) for f, own in zip((left, right), types, strict=True))


def merge_fill(
    left: DataFrame,
    right: DataFrame,
    key: str,
    overwrite: bool = False,
    allow_new: bool = False,
) -> DataFrame:
    """One join that fills or replaces columns of ``left`` from unique ``right`` rows.

    Columns only on one side are kept.  With ``overwrite`` matched rows take the
    right value even when it is NULL.  Where both sides differ in type, keys are
    compared and values kept in a type that holds both unchanged, text at the last.
    Keys of the left stay as they are.
    """
    own, others = ({c.name: c.dataType for c in f.schema.fields} for f in (left, right))
    columns = left.columns
    same = own[key] == others[key]
    if not same:
        left, right = aligned(left, right, key)
    incoming = [c for c in others if c != key]
    renamed = right.select(
        *([] if same else ["_key"]),
        F.lit(True).alias("_hit"),
        F.col(key).alias("_new_key"),
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(incoming)],
    )
    # Keys of one type are compared as they are: no second column of them is dealt out.
    on = left[key] == renamed["_new_key"] if same else "_key"
    merged = left.join(renamed, on, "full" if allow_new else "left")
    right_of = {c: F.col(f"_r{i}") for i, c in enumerate(incoming)}

    def value(c: str) -> Column:
        if c == key and allow_new:
            kind = _meeting(own[key], others[key])
            return F.coalesce(_as(F.col(key), own[key], kind), _as(F.col("_new_key"), others[key], kind)).alias(key)
        if c not in right_of:
            return F.col(c)
        if c not in own:
            return right_of[c].alias(c)
        kind = _meeting(own[c], others[c])
        old, new = _as(F.col(c), own[c], kind), _as(right_of[c], others[c], kind)
        if overwrite:
            return F.when(F.col("_hit"), new).otherwise(old).alias(c)
        return F.coalesce(old, new).alias(c)

    columns = columns + [c for c in incoming if c not in own]
    return merged.select(*[value(c) for c in columns])


def fill_only(
    manifest: DataFrame,
    results: DataFrame,
    key: str,
    cols: list[str] | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Fill NULL cells from results; existing values win, unknown keys are ignored."""
    usable = [c for c in (cols or results.columns) if c in results.columns and c in manifest.columns]
    usable = [c for c in usable if c not in (key, order_col)]
    extra = [order_col] if order_col else []
    keep = "first_row" if order_col else "first_value"
    one = one_per_key(results.select(key, *usable, *extra), key, order_col, keep)
    return merge_fill(manifest, one, key)


def stamp_done(results: DataFrame, analysis: str, as_of) -> DataFrame:
    """Add the done stamp unless the results bring their own."""
    done = f"{analysis}{DONE_SUFFIX}"
    return results if done in results.columns else results.withColumn(done, F.lit(as_of))


def append_flat(
    manifest: DataFrame,
    results: DataFrame,
    key: str,
    analysis: str,
    as_of,
    overwrite: bool = False,
    allow_new: bool = False,
    order_col: str | None = None,
) -> DataFrame:
    """Append an analysis to a flat manifest.

    Existing columns are filled, or replaced for every row with ``overwrite``;
    unknown keys are ignored unless ``allow_new``.
    """
    stamped = stamp_done(results, analysis, as_of)
    one = one_per_key(stamped, key, order_col, "first_row" if order_col else "first_value")
    if overwrite:
        manifest = manifest.drop(*[c for c in one.columns if c != key])
    return merge_fill(manifest, one, key, allow_new=allow_new)


def append_results(
    rows: DataFrame,
    results: DataFrame,
    level: str,
    analysis: str,
    as_of,
    overwrite: bool = False,
    order_col: str | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Append an analysis to a level table; flag columns are left out."""
    key = schema.key(level)
    stamped = stamp_done(results.drop(*AUTOFLAG_COLUMNS), analysis, as_of)
    keep = "last_row" if overwrite else "first_value"
    return merge_fill(rows, one_per_key(stamped, key, order_col, keep), key, overwrite)


def evolve_columns(
    existing: DataFrame, incoming: DataFrame, overrides: dict[str, str] | None = None
) -> DataFrame:
    """Add the columns that ``incoming`` has and ``existing`` lacks, all NULL."""
    overrides = overrides or {}
    unknown = set(overrides) - set(incoming.columns)
    if unknown:
        raise ValueError(f"type overrides name columns that are not there: {sorted(unknown)}")
    missing = [f for f in incoming.schema.fields if f.name not in existing.columns]

    def declared(f: T.StructField) -> T.DataType:
        return SPARK_TYPES[overrides[f.name]] if f.name in overrides else f.dataType

    return existing.select("*", *[F.lit(None).cast(declared(f)).alias(f.name) for f in missing])


def prefix_columns(results: DataFrame, prefix: str, key: str, analysis: str) -> DataFrame:
    """Prefix data columns; the key, flag columns and done stamp keep their names."""
    fixed = {key, f"{analysis}{DONE_SUFFIX}", *AUTOFLAG_COLUMNS}
    return results.withColumnsRenamed(
        {c: f"{prefix}_{c}" for c in results.columns if c not in fixed}
    )


def gate_missing_keys(results: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Result keys that the level table does not have; must be empty to load."""
    asked, known = aligned(results.select(key).distinct(), rows.select(key), key)
    return asked.join(known.select("_key"), "_key", "left_anti").select(key)


def gate_censored(results: DataFrame, rows: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Result keys whose own status forbids loading; empty when forced."""
    blocked = rows.filter(F.col("qc_status").isin(*QC_EXCLUDED)).select(key, "qc_status")
    blocked, asked = aligned(blocked, results.select(key).distinct(), key)
    hits = blocked.join(asked.select("_key"), "_key", "left_semi").select(key, "qc_status")
    return hits.limit(0) if force else hits


def capture_usage(
    entities: DataFrame,
    level: str,
    analysis: str,
    ref_keys: list[str],
    references: DataFrame,
    usage: DataFrame,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Record each entity's use of the declared references at their current version.

    ``ref_keys`` is the declaration of one analysis.  Each row is expanded by
    that fixed array; versions come from a join, and unknown keys drop out.
    """
    none = F.lit(None).cast("string")
    rows = entities.select(
        F.lit("analysis").alias("scope"),
        F.lit(level).alias("entity_level"),
        F.col(schema.key(level)).alias("entity_id"),
        F.lit(analysis).alias("analysis"),
        none.alias("artifact_id"),
        F.explode(F.array(*[F.lit(r) for r in ref_keys])).alias("ref_key"),
    )
    return record_usage(usage, _at_current_version(rows, references))


def capture_artifact_usage(
    artifacts: DataFrame, ref_keys: list[str], references: DataFrame, usage: DataFrame
) -> DataFrame:
    """Cohort-scope use: the declared references and a region scope that names one."""
    none = F.lit(None).cast("string")
    wanted = F.array(*[F.lit(r) for r in ref_keys], F.col("region_scope"))
    rows = artifacts.select(
        F.lit("cohort").alias("scope"),
        none.alias("entity_level"),
        none.alias("entity_id"),
        "analysis",
        "artifact_id",
        F.explode(F.array_distinct(F.array_compact(wanted))).alias("ref_key"),
    )
    return record_usage(usage, _at_current_version(rows, references))


def _at_current_version(rows: DataFrame, references: DataFrame) -> DataFrame:
    current = references.select("ref_key", F.col("version").alias("version_used"))
    return rows.join(current, "ref_key")


def capture_derivation(
    ids: DataFrame,
    level: str,
    analysis: str,
    upstreams: list[str],
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> DataFrame:
    """Candidate edges from each entity's analysis to the declared upstream nodes."""
    node = analysis_node(F.lit(level), F.col(schema.key(level)), F.lit(analysis))
    return ids.select(
        node.alias("down_node"),
        F.explode(F.array(*[F.lit(u) for u in upstreams])).alias("up_node"),
    )


def upsert_level(
    rows: DataFrame,
    frame: DataFrame,
    level: str,
    parents: DataFrame | None = None,
    allow_new: bool = False,
    overwrite: bool = False,
    order_col: str | None = None,
    schema: CohortSchema = DEFAULT_SCHEMA,
    exploded: bool = False,
) -> dict[str, DataFrame]:
    """Upsert metadata rows of one level.

    Existing rows are filled (or overwritten) from the last incoming row per
    key; new keys are inserted with ``allow_new`` when their parent exists, the
    identifier is well formed and no case variant is present.  ``exploded`` says that
    ``frame`` has one row per key; the rows of new keys are then written, and the
    tables are searched for their variants and parents only.
    """
    spec = schema.level(level)
    key, parent_key = spec.key, spec.parent_key
    declared = set(spec.column_names()) | set(QC_MANAGED_COLUMNS.get(level, ()))
    unknown = [c for c in frame.columns if c not in declared and c != order_col]
    if unknown:
        raise ValueError(f"columns not declared for level {level!r}: {unknown}")
    if allow_new and parent_key and parent_key not in frame.columns:
        raise ValueError(f"inserting new {level} rows needs the column {parent_key!r}")
    one = frame if exploded else one_per_key(frame, key, order_col, "last_row")
    existing = rows.select(key)
    known = one.join(existing, key, "left_semi")
    new = one.join(existing, key, "left_anti")
    # Rows of new keys meet no row, so they need not be parted from the known ones first.
    updated = merge_fill(rows, one, key, overwrite)
    if not allow_new:
        rejects = new.select(F.col(key).alias("id"), F.lit("unknown_key").alias("reject"))
        return {"rows": updated, "rejects": rejects, "inserted": new.limit(0), "updated": known}
    if exploded:
        new = cut(new)
        if new.isEmpty():  # nothing to look up, insert or refuse
            rejects = new.select(F.col(key).alias("id"), F.lit(None).cast("string").alias("reject"))
            return {"rows": updated, "rejects": rejects, "inserted": new, "updated": known}
    folded = rows.select(F.lower(key).alias("_folded"))
    checked = new.withColumn("_folded", F.lower(key))
    if exploded:
        folded = folded.join(checked.select("_folded"), "_folded", "left_semi")
        checked = checked.withColumn("_copies", F.lit(None).cast("boolean"))
    else:
        copies = duplicate_keys(frame, key).select(key, F.lit(True).alias("_copies"))
        checked = checked.join(copies, key, "left")
    checked = checked.join(folded.distinct().withColumn("_variant", F.lit(True)), "_folded", "left")
    reason = (
        F.when(F.col("_copies").isNotNull(), "duplicate_key")
        .when(id_rule(F.col(key), spec.id_pattern, schema.allow_unicode_ids).isNotNull(), "id_format")
        .when(F.col("_variant").isNotNull() & F.lit(not spec.allow_case_variants), "case_variant")
    )
    if parents is not None and parent_key:
        have = parents.select(
            F.col(schema.parent(level).key).alias(parent_key), F.lit(True).alias("_parent")
        )
        if exploded:
            have = have.join(new.select(parent_key), parent_key, "left_semi")
        checked = checked.join(have, parent_key, "left")
        reason = reason.when(F.col("_parent").isNull(), "missing_parent")
    checked = checked.withColumn("reject", reason)
    inserted = checked.filter(F.col("reject").isNull()).select(*one.columns)
    rejects = checked.filter(F.col("reject").isNotNull()).select(
        F.col(key).alias("id"), "reject"
    )
    defaults = {"qc_status": F.lit("pass"), "consent_status": F.lit("consented")}
    full = inserted.select(
        *[
            (F.col(c) if c in inserted.columns else defaults.get(c, F.lit(None)))
            .cast(updated.schema[c].dataType)
            .alias(c)
            for c in updated.columns
        ]
    )
    return {
        "rows": updated.unionByName(full),
        "rejects": rejects,
        "inserted": inserted,
        "updated": known,
    }


def register_rows(
    rows: DataFrame,
    new_rows: DataFrame,
    level: str,
    parents: DataFrame | None = None,
    allow_new_parent: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Insert rows, with stub parents on request (never above assays).

    QC-managed columns may not be given; they follow from events.
    """
    reserved = [c for c in new_rows.columns if c in QC_MANAGED_COLUMNS.get(level, ())]
    if reserved:
        raise ValueError(f"reserved columns cannot be registered: {reserved}")
    if allow_new_parent and level == "assay":
        raise ValueError("stub parents are not created for assays")
    spec = schema.level(level)
    stubs = None
    if parents is not None and spec.parent_key and allow_new_parent:
        parent = schema.parent(level)
        needed = new_rows.select(F.col(spec.parent_key).alias(parent.key)).distinct()
        outcome = upsert_level(
            parents.limit(0).select(parent.key),
            needed.join(parents.select(parent.key), parent.key, "left_anti"),
            parent.name,
            allow_new=True,
            schema=_without_parents(schema),
        )
        stubs = outcome["inserted"]
        parents = parents.unionByName(stubs, allowMissingColumns=True)
    taken = new_rows.join(rows.select(spec.key), spec.key, "left_semi").select(
        F.col(spec.key).alias("id"), F.lit("already_exists").alias("reject")
    )
    fresh = new_rows.join(rows.select(spec.key), spec.key, "left_anti")
    out = upsert_level(rows, fresh, level, parents, allow_new=True, schema=schema)
    return {
        "rows": out["rows"],
        "inserted": out["inserted"],
        "parents": parents,
        "stubs": stubs,
        "rejects": out["rejects"].unionByName(taken),
    }


def _without_parents(schema: CohortSchema) -> CohortSchema:
    from dataclasses import replace

    return replace(schema, levels=tuple(replace(lv, parent_key=None) for lv in schema.levels))


def route_columns(columns: list[str], schema: CohortSchema = DEFAULT_SCHEMA) -> dict[str, list[str]]:
    """Wide sheet columns per level; undeclared or ambiguous ones are an error."""
    linking = schema.linking_columns()
    owner: dict[str, str] = {}
    for level in schema.levels:
        for spec in level.columns:
            if spec.name in linking:
                continue
            if spec.name in owner:
                raise ValueError(
                    f"column {spec.name!r} is declared at {owner[spec.name]!r} and {level.name!r}"
                )
            owner[spec.name] = level.name
    stray = [c for c in columns if c not in linking and c not in owner]
    if stray:
        raise ValueError(f"columns not declared at any level: {stray}")
    return {
        lv.name: [c for c in (lv.key, lv.parent_key) if c in columns]
        + [c for c in columns if owner.get(c) == lv.name]
        for lv in schema.levels
    }


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string"), F.lit(" \t\r\n")) == "")


def validate_sheet(sheet: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Every problem of a wide sheet as ``(check, key, detail)`` rows.

    A missing key or required column raises at once.  Conflicts are keys whose
    rows differ in their attributes, seen from the least and largest 64-bit hash
    of them: numbers that a hash aggregate combines before the one shuffle of
    each level.
    """
    routed = route_columns(sheet.columns, schema)
    required = {lv.name: [lv.key] + [c.name for c in lv.columns if c.required] for lv in schema.levels}
    for level, names in required.items():
        absent = [c for c in names if c not in sheet.columns]
        if absent:
            raise ValueError(f"required columns of level {level!r} are missing: {absent}")
    must = list(dict.fromkeys(c for names in required.values() for c in names))
    finest = schema.levels[-1].key
    blanks = sheet.select(
        F.lit("blank_cell").alias("check"),
        F.col(finest).cast("string").alias("key"),
        F.explode(F.array_compact(F.array(*[F.when(_blank(c), F.lit(c)) for c in must]))).alias("detail"),
    )
    issues = [blanks]
    for lv in schema.levels:
        cols = [c for c in routed[lv.name] if c != lv.key]
        if not cols:
            continue
        attributes = [
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols
        ]
        parent = lv.parent_key if lv is not schema.levels[-1] and lv.parent_key in cols else None
        whole = F.xxhash64(*attributes)
        above = F.xxhash64(F.coalesce(F.col(parent).cast("string"), F.lit(""))) if parent else F.lit(0)
        spread = (
            sheet.filter(~_blank(lv.key))
            .groupBy(F.col(lv.key).cast("string").alias("key"))
            .agg((F.min(whole) < F.max(whole)).alias("_differ"), (F.min(above) < F.max(above)).alias("_parents"))
            .filter("_differ")
        )
        found = [(F.col("_differ"), f"{lv.name}_conflict", "attributes differ between rows")]
        if parent:
            found.append((F.col("_parents"), f"{lv.name}_with_several_parents", parent))
        each = [F.when(test, F.struct(F.lit(check).alias("check"), F.lit(detail).alias("detail"))) for test, check, detail in found]
        issues.append(
            spread.select("key", F.explode(F.array_compact(F.array(*each))).alias("_i")).select("_i.check", "key", "_i.detail")
        )
    return reduce(DataFrame.unionByName, issues)


def explode_sheet(sheet: DataFrame, schema: CohortSchema = DEFAULT_SCHEMA) -> dict[str, DataFrame]:
    """A validated wide sheet as one deduplicated frame per level."""
    routed = route_columns(sheet.columns, schema)
    frames = {}
    for lv in schema.levels:
        rows = sheet.select(*routed[lv.name])
        if lv is not schema.levels[-1]:
            rows = rows.distinct()  # many sheet rows per parent: collapse them in a hash aggregate
        frames[lv.name] = one_per_key(rows, lv.key, keep="first_row").select(*routed[lv.name])
    return frames


def dry_run_counts(
    frames: dict[str, DataFrame], tables: dict[str, DataFrame], schema: CohortSchema = DEFAULT_SCHEMA
) -> DataFrame:
    """New and existing keys per level."""
    out = []
    for level, frame in frames.items():
        key = schema.key(level)
        have = tables[level].select(key, F.lit(True).alias("_have"))
        out.append(
            frame.select(key)
            .distinct()
            .join(have, key, "left")
            .agg(
                F.count_if(F.col("_have").isNull()).alias("n_new"),
                F.count("_have").alias("n_existing"),
            )
            .select(F.lit(level).alias("level"), "n_new", "n_existing")
        )
    return reduce(DataFrame.unionByName, out)


def register_cohort(
    sheet: DataFrame,
    tables: dict[str, DataFrame],
    overwrite: bool = False,
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """Load a wide sheet into all levels, parents first.

    The sheet, the frames above the finest, the new rows of each level and the keys, which
    the next level needs, are written once; the finest frame is grouped by its key where
    it is joined by it, which costs less than to deal it out again.  Returns the new tables, ``issues`` of the sheet and
    ``rejects``.  A caller that wants all-or-nothing checks both before writing a snapshot.
    """
    sheet = cut(sheet)
    issues = validate_sheet(sheet, schema)
    finest = schema.levels[-1].name
    frames = {level: frame if level == finest else cut(frame) for level, frame in explode_sheet(sheet, schema).items()}
    out: dict[str, DataFrame] = {"issues": issues}
    rejects, parents = [], None
    for lv in schema.levels:
        done = upsert_level(
            tables[lv.name], frames[lv.name], lv.name, parents, True, overwrite, schema=schema, exploded=True
        )
        out[lv.name] = done["rows"]
        if lv is not schema.levels[-1]:
            # The keys there were and those that came in; no need to merge for them.
            parents = cut(tables[lv.name].select(lv.key).unionByName(done["inserted"].select(lv.key)))
        rejects.append(done["rejects"].withColumn("level", F.lit(lv.name)))
    out["rejects"] = reduce(DataFrame.unionByName, rejects)
    return out


def classify_columns(
    flat: DataFrame,
    patient: str = "patient_id",
    specimen: str = "specimen_id",
    assay: str = "assay_id",
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """``(column, level, reason)``: the coarsest level where a column is constant.

    Constant means the smallest and largest non-NULL value of every group agree,
    for all columns in one aggregate per level.
    """
    overrides = overrides or {}
    keys = (patient, specimen, assay)
    columns = [c for c in flat.columns if c not in keys]

    def constant(group: str, tag: str) -> DataFrame:
        per_group = flat.groupBy(group).agg(
            *[F.min(c).eqNullSafe(F.max(c)).alias(f"{tag}{i}") for i, c in enumerate(columns)]
        )
        return per_group.agg(*[F.min(f"{tag}{i}").alias(f"{tag}{i}") for i in range(len(columns))])

    def items(row: DataFrame, tag: str, name: str) -> DataFrame:
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(f"{tag}{i}").alias(name))
            for i, c in enumerate(columns)
        ]
        return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")

    both = items(constant(patient, "p"), "p", "by_patient").join(
        items(constant(specimen, "s"), "s", "by_specimen"), "column"
    )
    level = F.when(F.col("by_patient"), "patient").when(F.col("by_specimen"), "specimen").otherwise("assay")
    # Reason texts.
    reason = (
        F.when(F.col("by_patient"), "constant within every patient")
        .when(F.col("by_specimen"), "constant within every specimen")
        .otherwise("varies within specimens")
    )
    for column, forced in overrides.items():
        level = F.when(F.col("column") == column, forced).otherwise(level)
        reason = F.when(F.col("column") == column, "explicit override").otherwise(reason)
    return both.select("column", level.alias("level"), reason.alias("reason"))


def normalize_flat(
    flat: DataFrame,
    classes: dict[str, str],
    patient: str = "patient_id",
    specimen: str = "specimen_id",
    assay: str = "assay_id",
) -> dict[str, DataFrame]:
    """Split a flat table by column class; each group keeps one non-NULL value.

    Values are constant per group by classification, so the smallest is the
    value (and a fixed choice where an override says otherwise).
    """
    by_level = {lv: [c for c, x in classes.items() if x == lv] for lv in ("patient", "specimen", "assay")}
    patients = one_per_key(flat.select(patient, *by_level["patient"]), patient)
    groups = flat.groupBy(specimen, patient)
    picks = [F.min(c).alias(c) for c in by_level["specimen"]]
    specimens = groups.agg(*picks) if picks else flat.select(specimen, patient).distinct()
    assays = flat.select(assay, specimen, *by_level["assay"])
    return {"patient": patients, "specimen": specimens, "assay": assays}


def infer_types(frame: DataFrame) -> DataFrame:
    """``(column, type)``: the declared type each column would get.

    Text is sniffed over the whole column in one pass: all booleans, all whole
    numbers, or all numbers.  Whole numbers with NULLs become REAL.
    """
    # Boolean spellings of a sniffed file.
    spellings = ("True", "TRUE", "true", "False", "FALSE", "false")
    total = F.count(F.lit(1)).alias("_n")
    aggs, types = [total], []
    for i, f in enumerate(frame.schema.fields):
        c = F.col(f.name)
        nulls = F.count_if(c.isNull())
        if isinstance(f.dataType, T.StringType):
            integer = c.rlike(r"\A\s*[+-]?[0-9]+\s*\z")
            number = c.try_cast("double").isNotNull()
            aggs += [
                nulls.alias(f"_null{i}"),
                F.count_if(c.isin(*spellings)).alias(f"_bool{i}"),
                F.count_if(integer).alias(f"_int{i}"),
                F.count_if(number).alias(f"_num{i}"),
            ]
            filled = F.col("_n") - F.col(f"_null{i}")
            full = F.col(f"_null{i}") == 0
            kind = (
                F.when(filled == 0, "REAL")
                .when(full & (F.col(f"_bool{i}") == filled), "BOOLEAN")
                .when(full & (F.col(f"_int{i}") == filled), "INTEGER")
                .when(F.col(f"_num{i}") == filled, "REAL")
                .otherwise("TEXT")
            )
        elif isinstance(f.dataType, T.BooleanType):
            aggs.append(nulls.alias(f"_null{i}"))
            kind = F.when(F.col(f"_null{i}") == 0, "BOOLEAN").otherwise("TEXT")
        elif isinstance(f.dataType, T.IntegralType):
            aggs.append(nulls.alias(f"_null{i}"))
            kind = F.when(F.col(f"_null{i}") == 0, "INTEGER").otherwise("REAL")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kind = F.lit("DATE")
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            kind = F.lit("REAL")
        else:
            kind = F.lit("TEXT")
        types.append(F.struct(F.lit(f.name).alias("column"), kind.alias("type")))
    return frame.agg(*aggs).select(F.explode(F.array(*types)).alias("_t")).select("_t.*")


def migration_report(
    flat: DataFrame,
    patient: str = "patient_id",
    specimen: str = "specimen_id",
    assay: str = "assay_id",
    overrides: dict[str, str] | None = None,
) -> DataFrame:
    """Column, level, type and reason of a flat table's migration."""
    classes = classify_columns(flat, patient, specimen, assay, overrides)
    return classes.join(infer_types(flat), "column").select("column", "level", "type", "reason")


def coerce_columns(frame: DataFrame, spec: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Strings to declared types; rows with a bad value are returned apart."""
    unknown = [c for c in spec if c not in frame.columns]
    if unknown:
        raise ValueError(f"columns to coerce are not there: {unknown}")

    def cast(c: str, kind: str) -> Column:
        text = F.col(c).cast("string")
        if kind == "BOOLEAN":
            return to_boolean(text)
        if kind == "INTEGER":
            return text.try_cast("bigint")
        if kind == "REAL":
            return text.try_cast("double")
        if kind in ("TEXT", "DATE"):
            return text
        raise ValueError(f"unsupported type {kind!r}")

    failures = [
        F.when(F.col(c).isNotNull() & cast(c, k).isNull(), F.lit(f"{c}: expected {k}"))
        for c, k in spec.items()
    ]
    bad = F.array_compact(F.array(*failures))
    marked = frame.withColumn("reject", F.when(F.size(bad) > 0, F.array_join(bad, "; ")))
    good = marked.filter(F.col("reject").isNull()).select(
        *[cast(c, spec[c]).alias(c) if c in spec else F.col(c) for c in frame.columns]
    )
    return good, marked.filter(F.col("reject").isNotNull())


def seed_batches(assays: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches from flowcells, and assays pointed at them where unset."""
    wanted = (
        assays.filter(F.col("flowcell_id").isNotNull() & F.col("batch_id").isNull())
        .select(F.col("flowcell_id").alias("batch_id"))
        .distinct()
        .join(batches.select("batch_id"), "batch_id", "left_anti")
    )
    return (
        batches.unionByName(wanted, allowMissingColumns=True),
        assays.withColumn("batch_id", F.coalesce("batch_id", "flowcell_id")),
    )


def migrate_legacy_qc(
    assays: DataFrame,
    as_of,
    transaction_id: str,
    column: str = "qc_pass",
    key: str = "assay_id",
) -> tuple[DataFrame, DataFrame]:
    """Legacy pass flags as events: false fails, true and NULL pass.

    Returns ``(assays without the column, new events)``.
    """
    from cohort_ledger.operators.qc import new_events

    # Reason and author.
    flags = assays.filter(F.col(column).cast("string").isin("0", "false")).select(
        F.lit("assay").alias("level"),
        F.col(key).alias("entity_id"),
        F.lit("qc_fail").alias("kind"),
        F.lit("migrated from legacy qc_pass").alias("reason"),
    )
    return assays.drop(column), new_events(
        flags, as_of, transaction_id, "import:migrate-qc", "import"
    )


def derive_sheet_keys(
    sheet: DataFrame,
    patient: str = "patient",
    condition: str = "condition",
    sample: str = "sample",
    constants: dict[str, str] | None = None,
) -> DataFrame:
    """A narrow sheet as a wide one: specimen ids from patient and condition."""
    keep = [c for c in sheet.columns if c not in (patient, condition, sample)]
    return sheet.select(
        F.col(patient).cast("string").alias("patient_id"),
        F.concat_ws("_", patient, condition).alias("specimen_id"),
        F.col(sample).cast("string").alias("assay_id"),
        F.col(condition),
        *keep,
        *[F.lit(v).alias(k) for k, v in (constants or {}).items()],
    )


def append(
    rows: DataFrame,
    results: DataFrame,
    level: str,
    analysis: str,
    events: DataFrame,
    as_of,
    transaction_id: str,
    prefix: str | None = None,
    overwrite: bool = False,
    force: bool = False,
    references: DataFrame | None = None,
    usage: DataFrame | None = None,
    uses: list[str] = (),
    upstreams: list[str] = (),
    schema: CohortSchema = DEFAULT_SCHEMA,
) -> dict[str, DataFrame]:
    """The whole append: gates, merge, flags, reference use and derivation edges.

    Nothing is written; the caller checks ``missing_keys`` and ``censored`` and
    writes the returned tables as a new snapshot.
    """
    from cohort_ledger.operators.qc import autoflag_apply, autoflag_extract

    key = schema.key(level)
    flags = autoflag_extract(results, key)
    data = prefix_columns(results, prefix, key, analysis) if prefix else results
    merged = append_results(rows, data, level, analysis, as_of, overwrite, schema=schema)
    flagged = autoflag_apply(flags, level, merged, events, as_of, transaction_id, schema=schema)
    ids = results.select(key).distinct()
    out = {
        "missing_keys": gate_missing_keys(results, rows, key),
        "censored": gate_censored(results, rows, key, force),
        "rows": flagged["rows"],
        "events": flagged["events"],
        "new_events": flagged["new_events"],
    }
    if uses and references is not None and usage is not None:
        out["usage"] = capture_usage(ids, level, analysis, list(uses), references, usage, schema)
    if upstreams:
        out["candidate_edges"] = capture_derivation(ids, level, analysis, list(upstreams), schema)
    return out

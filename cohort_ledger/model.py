"""The cohort data model: levels, keys, enumerations and Spark schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# These must equal the reference's for results to agree.
DONE_SUFFIX = "_done"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
LEVELS = ("patient", "specimen", "assay")

QC_KINDS = (
    "qc_fail",
    "qc_warn",
    "consent_revoked",
    "protocol_deviation",
    "superseded",
    "library_prep_failed",
    "basecall_accuracy_low",
    "contamination",
    "batch_effect_flagged",
    "sequencing_run_failed",
    "other",
)
QC_KIND_LEVELS = {
    "consent_revoked": ("patient",),
    "library_prep_failed": ("assay",),
    "basecall_accuracy_low": ("assay",),
    "sequencing_run_failed": ("assay",),
    "protocol_deviation": ("specimen", "assay"),
    "contamination": ("specimen", "assay"),
}
QC_KIND_STATUS = {
    "consent_revoked": "consent_revoked",
    "qc_fail": "fail",
    "qc_warn": "warn",
    "library_prep_failed": "fail",
    "basecall_accuracy_low": "fail",
    "sequencing_run_failed": "fail",
    "contamination": "fail",
    "protocol_deviation": "fail",
    "batch_effect_flagged": "warn",
    "superseded": "censored",
    "other": "censored",
}
QC_SEVERITY = {"pass": 0, "warn": 1, "censored": 2, "fail": 3, "consent_revoked": 4}
QC_EXCLUDED = ("fail", "censored", "consent_revoked")
QC_SOURCES = ("manual", "slurm", "import")
CONSENT_STATUSES = (
    "consented",
    "consented_limited_use",
    "pending",
    "revoked",
    "withdrawn",
    "consent_expired",
    "deceased_pre_consent",
)
CONSENT_USABLE = ("consented", "consented_limited_use")
CONSENT_REVOKED = ("revoked", "withdrawn", "consent_expired")
AUTOFLAG_COLUMNS = ("qc_pass", "qc_fail_reason", "qc_warn")
QC_MANAGED_COLUMNS = {
    "patient": ("qc_status", "consent_status", "consent_date", "withdrawal_date"),
    "specimen": ("qc_status",),
    "assay": ("qc_status",),
}
TRUE_TOKENS = ("true", "t", "1", "yes", "y")
FALSE_TOKENS = ("false", "f", "0", "no", "n")
LIFECYCLE_STATUSES = ("active", "complete", "archived")
# End of fixed values.

SPARK_TYPES = {
    "TEXT": T.StringType(),
    "INTEGER": T.LongType(),
    "REAL": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
}


@dataclass(frozen=True)
class ColumnSpec:
    """One declared column of a level."""

    name: str
    type: str = "TEXT"
    required: bool = False
    unique: bool = False
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class Level:
    """One level of the hierarchy; ``parent_key`` is the key of the level above."""

    name: str
    key: str
    parent_key: str | None = None
    columns: tuple[ColumnSpec, ...] = ()
    id_pattern: str | None = None
    allow_case_variants: bool = False

    @property
    def table(self) -> str:
        return f"{self.name}s"

    def column_names(self) -> list[str]:
        keys = [self.key] + ([self.parent_key] if self.parent_key else [])
        return keys + [c.name for c in self.columns if c.name not in keys]

    def struct(self) -> T.StructType:
        types = {c.name: SPARK_TYPES[c.type] for c in self.columns}
        return T.StructType(
            [T.StructField(n, types.get(n, T.StringType())) for n in self.column_names()]
        )


@dataclass(frozen=True)
class CohortSchema:
    """Levels from coarsest to finest, plus project-wide switches."""

    levels: tuple[Level, ...]
    allow_unicode_ids: bool = False
    kinds: tuple[str, ...] = QC_KINDS
    kind_levels: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(QC_KIND_LEVELS)
    )

    def level(self, name: str) -> Level:
        for level in self.levels:
            if level.name == name:
                return level
        raise ValueError(f"unknown level {name!r}; known: {[x.name for x in self.levels]}")

    def key(self, name: str) -> str:
        return self.level(name).key

    def parent(self, name: str) -> Level | None:
        index = self.levels.index(self.level(name))
        return self.levels[index - 1] if index else None

    def linking_columns(self) -> set[str]:
        return {k for lv in self.levels for k in (lv.key, lv.parent_key) if k}


DEFAULT_SCHEMA = CohortSchema(
    levels=(
        Level("patient", "patient_id", None, (ColumnSpec("cohort"), ColumnSpec("site"))),
        Level(
            "specimen",
            "specimen_id",
            "patient_id",
            (ColumnSpec("tissue_site"), ColumnSpec("timepoint")),
        ),
        Level(
            "assay",
            "assay_id",
            "specimen_id",
            (ColumnSpec("assay_type"), ColumnSpec("batch_id")),
        ),
    )
)

QC_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("resolved_at", T.TimestampType()),
        T.StructField("resolved_by", T.StringType()),
        T.StructField("resolved_reason", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
    ]
)
EVENT_COLUMNS = QC_EVENT_SCHEMA.fieldNames()

_text = T.StringType()
LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("timestamp", _text),
        T.StructField("user", _text),
        T.StructField("action", _text),
        T.StructField("level", _text),
        T.StructField("analysis", _text),
        T.StructField("entity_id", _text),
        T.StructField("kind", _text),
        T.StructField("reason", _text),
        T.StructField("source", _text),
        T.StructField("created_by", _text),
        T.StructField("created_at", _text),
        T.StructField("resolved_by", _text),
        T.StructField("resolved_at", _text),
        T.StructField("qc_event_id", _text),
        T.StructField("withdrawal_date", _text),
        T.StructField("batch_id", _text),
        T.StructField("columns_added", T.ArrayType(_text)),
        T.StructField("censored_assays", T.ArrayType(_text)),
        T.StructField("warned_specimens", T.ArrayType(_text)),
        T.StructField("censored_derived_assays", T.ArrayType(_text)),
        T.StructField("resolved_assays", T.ArrayType(_text)),
        T.StructField("resolved_specimens", T.ArrayType(_text)),
        T.StructField("resolved_derived_assays", T.ArrayType(_text)),
        T.StructField("results_file", _text),
        T.StructField("results_checksum", _text),
        T.StructField("id", _text),
        T.StructField("parent", _text),
        T.StructField("meta", T.MapType(_text, _text)),
        T.StructField("migrated_rows", T.ArrayType(T.StructType([T.StructField("assay_id", _text)]))),
        T.StructField("project_id", _text),
        T.StructField("from_status", _text),
        T.StructField("to_status", _text),
        T.StructField("slurm_job_id", _text),
        T.StructField("transaction_id", _text),
    ]
)

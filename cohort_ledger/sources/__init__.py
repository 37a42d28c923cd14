"""Readers.  Schemas are explicit wherever the format has one."""

from cohort_ledger.sources.digests import file_digests
from cohort_ledger.sources.readers import (
    infer_layout,
    init_manifest,
    parse_artifact_inputs,
    read_artifact_inputs,
    read_bulk_lineage,
    read_bulk_qc,
    read_event_log,
    read_levels,
    read_manifest,
    read_manifests_union,
    read_results,
    read_results_by_layout,
    read_sample_sheet,
)

__all__ = [
    "file_digests",
    "infer_layout",
    "init_manifest",
    "parse_artifact_inputs",
    "read_artifact_inputs",
    "read_bulk_lineage",
    "read_bulk_qc",
    "read_event_log",
    "read_levels",
    "read_manifest",
    "read_manifests_union",
    "read_results",
    "read_results_by_layout",
    "read_sample_sheet",
]

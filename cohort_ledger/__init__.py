"""Cohort ledger: a Spark-native cohort, QC, lineage and staleness engine.

Every operator is a plain function from DataFrames to DataFrames.  Nothing is
collected on the driver except the row counts that end a graph fixpoint.
"""

from cohort_ledger.model import DEFAULT_SCHEMA, CohortSchema, ColumnSpec, Level

__all__ = ["CohortSchema", "ColumnSpec", "DEFAULT_SCHEMA", "Level"]

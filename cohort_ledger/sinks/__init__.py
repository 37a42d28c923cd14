"""Writers and exports."""

from cohort_ledger.sinks.files import write_files
from cohort_ledger.sinks.writers import (
    collect_capped,
    export_audit,
    export_joined,
    export_plan,
    export_sql,
    export_tables,
    write_table,
)

__all__ = [
    "collect_capped",
    "export_audit",
    "export_joined",
    "export_plan",
    "export_sql",
    "export_tables",
    "write_files",
    "write_table",
]

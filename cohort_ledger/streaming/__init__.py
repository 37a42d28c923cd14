"""Structured Streaming jobs over landing folders."""

from cohort_ledger.streaming.jobs import (
    current_events,
    current_flags,
    current_log,
    current_rows,
    stream_append,
    stream_qc_log,
)
from cohort_ledger.streaming.keyed import state_events, stream_qc_state

__all__ = ["current_events", "current_flags", "current_log", "current_rows", "state_events", "stream_append", "stream_qc_log", "stream_qc_state"]

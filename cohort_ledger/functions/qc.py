"""QC status, consent and flag-token expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_ledger.model import (
    CONSENT_USABLE,
    FALSE_TOKENS,
    QC_EXCLUDED,
    QC_KIND_STATUS,
    QC_SEVERITY,
    TRUE_TOKENS,
)


def _kinds_with_status(status: str) -> list[str]:
    return [kind for kind, s in QC_KIND_STATUS.items() if s == status]


def kind_severity(kind: Column, level: Column) -> Column:
    """Severity of the status that ``kind`` leads to at ``level``.

    An integer, so that the most severe kind is a plain ``max`` which Spark can
    combine before the shuffle in a hash aggregate.
    """
    censored = F.lit(QC_SEVERITY["censored"])
    return (
        F.when(kind.isin(_kinds_with_status("fail")), F.lit(QC_SEVERITY["fail"]))
        .when(kind.isin(_kinds_with_status("warn")), F.lit(QC_SEVERITY["warn"]))
        .when(
            (kind == "consent_revoked") & (level == "patient"),
            F.lit(QC_SEVERITY["consent_revoked"]),
        )
        .otherwise(censored)
    )


def status_severity(status: Column) -> Column:
    """Severity rank of a status; anything unknown, NULL included, ranks as pass."""
    rank = F.lit(0)
    for name, value in QC_SEVERITY.items():
        if value:
            rank = F.when(F.lower(status) == name, F.lit(value)).otherwise(rank)
    return rank


def severity_status(severity: Column) -> Column:
    """Inverse of the ranking; NULL (no event) is pass."""
    names = sorted(QC_SEVERITY, key=QC_SEVERITY.get)
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(severity, F.lit(0)) + 1)


def qc_usable(status: Column, include_censored: bool = False) -> Column:
    """The cascade's test on one level.  A NULL status is not usable."""
    if include_censored:
        return status != "consent_revoked"
    return ~status.isin(*QC_EXCLUDED)


def consent_usable(status: Column, include_consent_revoked: bool = False) -> Column:
    if include_consent_revoked:
        return F.lit(True)
    return status.isin(*CONSENT_USABLE)


#: Text that is read as a number where a flag is expected; words such as "infinity" are free text.
NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\z"


def _token(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"), F.lit(" \t\r\n\f\v")))


def is_true_token(value: Column) -> Column:
    """True only for an explicit truthy token; free text and NULL are false."""
    return F.coalesce(_token(value).isin(*TRUE_TOKENS), F.lit(False))


def is_false_token(value: Column) -> Column:
    """True only for an explicit false token."""
    return F.coalesce(_token(value).isin(*FALSE_TOKENS), F.lit(False))


def flag_value(rows: DataFrame, column: str) -> Column:
    """A flag column of any type as boolean: NULL where it says neither yes nor no.

    Booleans count as they are and numbers by being 0 or not, NaN as neither.
    Text counts by its token, else by the number it spells, for one blank cell
    turns a column of 0 and 1 into text like ``0.0``.
    """
    kind, value = rows.schema[column].dataType, F.col(column)
    by_number = lambda x: F.when(x.isNotNull() & ~F.isnan(x), x != 0)
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, T.NumericType):
        return by_number(value.cast("double"))
    spelled = F.when(_token(value).rlike(NUMBER), _token(value).try_cast("double"))
    return F.coalesce(to_boolean(value), by_number(spelled))


def to_boolean(value: Column) -> Column:
    """Declared-boolean coercion; anything outside the token sets is NULL."""
    return F.when(is_true_token(value), F.lit(True)).when(is_false_token(value), F.lit(False))


def ethics_reason_ok(reason: Column) -> Column:
    """Does the reason name a review board, a re-consent or an ISO date?"""
    # Accepted signals.
    board = r"(?i)\bIRB\b|\bERB\b|\bethics\s*committee\b"
    reconsent = r"(?i)\bre[-\s]?consent"
    iso_date = r"\b\d{4}-\d{2}-\d{2}\b"
    return F.coalesce(
        reason.rlike(board) | reason.rlike(reconsent) | reason.rlike(iso_date), F.lit(False)
    )


def event_id(level: Column, entity: Column, kind: Column, txn: Column) -> Column:
    """Deterministic surrogate id for an event, stable under task retries."""
    return F.sha2(F.concat_ws("|", level, entity, kind, txn), 256)

"""Identifier rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns.
DEFAULT_ID_PATTERN = r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}"
FORBIDDEN_UNICODE_CHARS = r"(?U)[\s/\\:;|&<>'\"`$*?!()\x00-\x1f\x7f]"
MAX_ID_LENGTH = 64


def id_rule(value: Column, pattern: str | None = None, allow_unicode: bool = False) -> Column:
    """Name of the first broken identifier rule, or NULL for a good identifier."""
    text = value.cast("string")
    stripped = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    rule = (
        F.when(text.isNull(), "null")
        .when(stripped == "", "blank")
        .when(stripped.isin(".", ".."), "reserved_literal")
    )
    if pattern is not None:
        return rule.when(~text.rlike(rf"\A(?:{pattern})\z"), "custom_pattern")
    if allow_unicode:
        return (
            rule.when(F.length(text) > MAX_ID_LENGTH, "length")
            .when(text.rlike(FORBIDDEN_UNICODE_CHARS), "forbidden_character")
            .when(F.substring(text, 1, 1).isin("-", "."), "leading_character")
        )
    return rule.when(~text.rlike(rf"\A{DEFAULT_ID_PATTERN}\z"), "default_pattern")


def suggest_id(value: Column) -> Column:
    """A clean identifier derived from a bad one; NULL when none can be made."""
    slug = F.regexp_replace(value.cast("string"), r"[^A-Za-z0-9_.-]+", "_")
    slug = F.regexp_replace(slug, r"\A[_.-]+|[_.-]+\z", "")
    slug = F.substring(slug, 1, MAX_ID_LENGTH)
    return F.when(slug.rlike(rf"\A{DEFAULT_ID_PATTERN}\z"), slug)

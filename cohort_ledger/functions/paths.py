"""Result-tree path templates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("tool", "run_tag", "patient_id", "specimen_id", "assay_id")


def template_pattern(template: str) -> tuple[str, list[str]]:
    """Regular expression of a template and its fields in order.

    A path may go deeper than the template.
    """
    names = re.findall(r"\{(\w+)\}", template)
    literal = re.split(r"\{\w+\}", template)
    body = "([^/]+)".join(re.escape(part) for part in literal)
    return rf"\A{body}(?:/.*)?\z", names


def path_fields(relative: Column, templates: dict[str, str]) -> Column:
    """Struct of ``level`` and the template fields of the deepest matching template."""
    result = F.lit(None)
    for level, template in sorted(templates.items(), key=lambda kv: kv[1].count("/")):
        pattern, names = template_pattern(template)
        values = [
            (
                F.regexp_extract(relative, pattern, names.index(f) + 1)
                if f in names
                else F.lit(None).cast("string")
            ).alias(f)
            for f in FIELDS
        ]
        match = F.struct(F.lit(level).alias("level"), *values)
        result = F.when(relative.rlike(pattern), match).otherwise(result)
    return result

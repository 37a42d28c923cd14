"""Node references: ``cohort:<analysis>@<run_tag>``, ``reference:<ref_key>``,
``analysis:<level>/<entity_id>/<analysis>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cohort_node(analysis: Column, run_tag: Column) -> Column:
    return F.concat(F.lit("cohort:"), analysis, F.lit("@"), run_tag)


def reference_node(ref_key: Column) -> Column:
    return F.concat(F.lit("reference:"), ref_key)


def analysis_node(level: Column, entity_id: Column, analysis: Column) -> Column:
    return F.concat(F.lit("analysis:"), level, F.lit("/"), entity_id, F.lit("/"), analysis)


MAX_TEXT = 2**31 - 1
_PART = r"[^/]*[^/\s][^/]*"
_ANALYSIS = r"\Aanalysis:" + "/".join([_PART] * 3) + r"\z"


def parse_node(node: Column) -> Column:
    """Struct of the parts of a node reference; NULL when it is malformed.

    The parts are cut out at their marks; only the analysis scope needs a pattern,
    which is matched once.
    """
    none, size, at = F.lit(None).cast("string"), F.length(node), F.locate("@", node)
    places = F.substring(node, len("analysis:") + 1, MAX_TEXT)

    def parts(scope: str, **given: Column) -> Column:
        names = ("analysis", "run_tag", "ref_key", "entity_level", "entity_id")
        return F.struct(F.lit(scope).alias("scope"), *[given.get(c, none).alias(c) for c in names])

    cohort = parts(
        "cohort",
        analysis=node.substr(F.lit(len("cohort:") + 1), at - len("cohort:") - 1),
        run_tag=node.substr(at + 1, size),
    )
    reference = parts("reference", ref_key=F.substring(node, len("reference:") + 1, MAX_TEXT))
    analysis = parts(
        "analysis",
        analysis=F.substring_index(places, "/", -1),
        entity_level=F.substring_index(places, "/", 1),
        entity_id=F.substring_index(F.substring_index(places, "/", 2), "/", -1),
    )
    return (
        F.when(node.startswith("cohort:") & (at > len("cohort:") + 1) & (at < size), cohort)
        .when(node.startswith("reference:") & (size > len("reference:")), reference)
        .when(node.startswith("analysis:") & node.rlike(_ANALYSIS), analysis)
    )


def format_node(parts: Column) -> Column:
    """The canonical text of a parsed node."""
    return (
        F.when(parts["scope"] == "cohort", cohort_node(parts["analysis"], parts["run_tag"]))
        .when(parts["scope"] == "reference", reference_node(parts["ref_key"]))
        .when(
            parts["scope"] == "analysis",
            analysis_node(parts["entity_level"], parts["entity_id"], parts["analysis"]),
        )
    )

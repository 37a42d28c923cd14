"""Node references cut at their marks, against one pattern over the whole text."""

import re

from pyspark.sql import functions as F

from cohort_ledger.functions.nodes import parse_node
from cohort_ledger.plans import registry
from cohort_ledger.plans.dataset import Model

FOLDER = "/root/testdata/sf0.001"
PART = r"([^/]*[^/ \t\n\x0b\f\r][^/]*)"
PATTERN = re.compile(r"(?s)(?:cohort:([^@]+)@(.+)|reference:(.+)|analysis:" + "/".join([PART] * 3) + ")")
TEXTS = [
    None, "", ":", "cohort:", "cohort:@", "cohort:a@", "cohort:@b", "cohort:a@b", "cohort:a@b@c", "cohort:a@@", "cohort:@@b", "cohort:a:b@c:d",
    "cohort:\n@\n", "cohort: @ ", "cohort:é😀@ü", "Cohort:a@b", " cohort:a@b", "xcohort:a@b", "cohort:reference:a", "reference:", "reference: ",
    "reference:a@b/c", "reference:\n", "reference:é", "references:a", "analysis:", "analysis://", "analysis:a/b/c", "analysis:a/b/c/d",
    "analysis:a/b", "analysis:a//c", "analysis:a/ /c", "analysis:\t/b/c", "analysis: a / b / c ", "analysis:a/b/c\n", "analysis:\na/b\n/c",
    "analysis:a/b/\x0b", "analysis:a/ /c", "analysis:é/😀/ü", "analysis:a@b/c/d", "analysis:a:b/c/d", "assay",
]


def parts_of(text):
    match = PATTERN.fullmatch(text) if text is not None else None
    if match is None:
        return None
    analysis, tag, ref, level, entity, name = match.groups()
    return (text.split(":")[0], analysis or name, tag, ref, level, entity)


def test_parts_are_those_of_the_pattern(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "node string").select("node", parse_node(F.col("node")).alias("p"))
    got = {r.node: tuple(r.p) if r.p is not None else None for r in rows.collect()}
    assert got == {t: parts_of(t) for t in TEXTS}


def test_no_text_is_matched_for_every_part(spark):
    registry.load()
    plan = registry.PLANS["parse_nodes"](Model(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan

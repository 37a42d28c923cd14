"""Merges whose two sides have keys or values of different types."""

from decimal import Decimal

import pytest

from cohort_ledger.operators import ingest, views

BIG = 2**53 + 1


@pytest.mark.parametrize("kind, same, near", [("double", None, float(2**53)), ("string", str(BIG), str(BIG - 1)), ("decimal(20,1)", Decimal(BIG), Decimal(BIG - 1))])
def test_keys_beyond_doubles(spark, rows, kind, same, near):
    manifest = spark.createDataFrame([(BIG, None), (7, None), (None, None)], "id long, v string")
    results = [(near, "near"), ({"double": 7.0, "string": "7", "decimal(20,1)": Decimal(7)}[kind], "seven"), (None, "no key")]
    results += [(same, "same")] if same is not None else []
    results = spark.createDataFrame(results, f"id {kind}, v string")
    filled = ingest.fill_only(manifest, results, "id")
    assert filled.schema["id"].dataType.simpleString() == "bigint"
    assert rows(filled) == sorted([(BIG, "same" if same is not None else None), (7, "seven"), (None, None)], key=lambda t: tuple(map(str, t)))
    missing = {r[0] for r in ingest.gate_missing_keys(results, manifest, "id").collect()}
    assert missing == {near, None}
    both = ingest.merge_fill(manifest, results, "id", allow_new=True)
    assert {str(r.id).removesuffix(".0") for r in both.filter("v IS NOT NULL AND id IS NOT NULL").collect()} == {"7", str(BIG - 1)} | ({str(BIG)} if same is not None else set())


def test_existing_cells_never_change(spark, rows):
    manifest = spark.createDataFrame([("a", Decimal("12345678901234567.0123456789"), BIG, 5), ("b", None, None, None)], "id string, d decimal(38,10), n long, i int")
    results = spark.createDataFrame([("a", 1.0, 1.0, 1.0), ("b", 0.5, 2.0, 2.5)], "id string, d double, n double, i double")
    got = ingest.fill_only(manifest, results, "id").orderBy("id").collect()
    assert Decimal(got[0].d) == Decimal("12345678901234567.0123456789") and int(got[0].n) == BIG and got[0].i == 5
    assert (Decimal(got[1].d), got[1].n, got[1].i) == (Decimal("0.5"), "2", 2.5)


def test_decimals_widen(spark):
    manifest = spark.createDataFrame([("a", 2**62), ("b", None)], "id string, v long")
    results = spark.createDataFrame([("b", Decimal("0.25"))], "id string, v decimal(5,2)")
    got = ingest.fill_only(manifest, results, "id")
    assert got.schema["v"].dataType.simpleString() == "decimal(21,2)"
    assert [r.v for r in got.orderBy("id").collect()] == [Decimal(2**62), Decimal("0.25")]


@pytest.mark.parametrize("value, kind, text", [
    (1.0, "double", "1"), (-0.0, "double", "0"), (1.5, "double", "1.5"), (float(2**60), "double", str(2**60)), (1e300, "double", "1.0E300"), (float("nan"), "double", "NaN"),
    (Decimal("10.50"), "decimal(10,2)", "10.5"), (Decimal("100.00"), "decimal(10,2)", "100"), (100, "int", "100"), ("007", "string", "007"), (True, "boolean", "true"),
])
def test_plain_text(spark, value, kind, text):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    assert frame.select(ingest.plain_text(frame["v"], frame.schema["v"].dataType)).first()[0] == text


def test_keyed_merges_of_different_types(spark, rows):
    manifest = spark.createDataFrame([(1, "m1"), (2, "m2")], "id int, a string")
    results = spark.createDataFrame([("1", "r1"), ("x9", "r9")], "id string, b string")
    assert rows(views.merge_left(manifest, results, "id")) == [(1, "m1", "r1"), (2, "m2", None)]
    assert rows(views.merge_outer(manifest, results, "id")) == [("1", "m1", "r1"), ("2", "m2", None), ("x9", None, "r9")]

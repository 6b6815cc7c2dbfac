"""Band joins, nearest anchors and the name index against plain loops."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import nearby, search


def test_band_join_is_all_pairs_within(spark):
    r = random.Random(1)
    value = lambda: r.choice([None, Decimal("0.5"), Decimal("-0.5"), Decimal("0")] + [Decimal(r.randint(-400, 400)) / 100 for _ in range(6)])
    a, b = [(i, value()) for i in range(120)], [(i, value()) for i in range(90)]
    left, right = spark.createDataFrame(a, "i int, x decimal(18,2)"), spark.createDataFrame(b, "j int, y decimal(18,2)")
    got = nearby.band_join(left, right, "x", "y", "0.5")
    assert sorted((p.i, p.j) for p in got.collect()) == sorted((i, j) for i, x in a for j, y in b if x is not None and y is not None and abs(x - y) < Decimal("0.5"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert nearby.band_join(left.limit(0), right, "x", "y", "0.5").count() == 0


def test_band_labels(spark):
    words = spark.createDataFrame([("10.2",)] * 500 + [("1,010.49",), ("1010.50",), ("acme",), ("ACME",), (" ",), (None,), ("ltd",), ("9.70",), ("12.",), ("1e5",), ("9" * 60,)], "w string")
    amounts = spark.createDataFrame([(1, "B-B", Decimal("10.00")), (0, "B-A", Decimal("10.69")), (2, "B-C", Decimal("1010.00")), (0, "B-A", None)], "priority int, label string, amount decimal(18,2)")
    names = spark.createDataFrame([(1, "I-S", "Acme"), (0, "B-S", "ACME"), (0, "B-S", "ltd"), (0, "B-S", None)], "priority int, label string, name string")
    got = {r.word: (r.n, r.label, r.n_amounts) for r in nearby.band_labels(words, "w", amounts, names).collect()}
    assert got == {"10.2": (500, "B-A", 2), "1,010.49": (1, "B-C", 1), "1010.50": (1, "O", 0), "ACME": (2, "B-S", 0), "LTD": (1, "O", 0), "9.70": (1, "B-B", 1), "12.": (1, "O", 0), "1E5": (1, "O", 0), "9" * 60: (1, "O", 0)}


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_nearest_anchors_are_those_of_a_loop(spark, span):
    r = random.Random(span)
    points = [(n, r.choice([1, 1, 1, 2, 3, None]), r.choice([None] + list(range(60)) * 3)) for n in range(150)] + [(0, 1, 5), (0, 1, 5)]
    anchors = [(r.choice([1, 1, 2, 4, None]), r.choice([None] + list(range(0, 70)) * 2), r.choice("abc")) for _ in range(40)] + [(1, 20, "b"), (1, 20, "a")]
    got = nearby.nearest_anchors(spark.createDataFrame(points, "n int, doc int, at int"), spark.createDataFrame(anchors, "doc int, at int, mark string"), "doc", "at", "mark", span)

    def expected(doc, at):
        if doc is None or at is None:
            return None, None
        own = [(a, m) for d, a, m in anchors if d == doc and a is not None]
        back = min(((-a, m) for a, m in own if a <= at), default=None)
        return back and (-back[0], back[1]), min(((a, m) for a, m in own if a >= at), default=None)

    key = lambda x: str(x)
    rows = [(p.n, p.doc, p.at, p.before and tuple(p.before), p.after and tuple(p.after)) for p in got.collect()]
    assert sorted(rows, key=key) == sorted(((n, d, a, *expected(d, a)) for n, d, a in points), key=key)


def test_nearest_anchors_without_rows(spark):
    points, anchors = spark.createDataFrame([(1, 2)], "doc int, at int"), spark.createDataFrame([(1, 2, "x")], "doc int, at int, mark string")
    assert nearby.nearest_anchors(points.limit(0), anchors, "doc", "at", "mark").count() == 0
    assert nearby.nearest_anchors(points, anchors.limit(0), "doc", "at", "mark").first()["before"] is None
    near = nearby.nearest_anchors(points, anchors, "doc", "at", "mark").select(nearby.nearer(F.col("at"), F.col("before"), F.col("after")).alias("z")).first().z
    assert tuple(near) == (2, "x")


def test_name_index_finds_what_contains_does(spark, tmp_path):
    r = random.Random(3)
    names = ["".join(r.choice("abAB é#") for _ in range(r.randint(0, 9))) for _ in range(300)] + ["aaaa"] * 50 + [None, "x"]
    index = search.NameIndex(spark, str(tmp_path / "i"), 8).build(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    known = {n.lower() for n in names if n is not None}
    patterns = ["", "a", "B", "ab", "aab", "aaaa", "é#", "abé", "zz", "bA b", "x", None, "abababababab"]
    expected = {(p, n) for p in patterns if p is not None for n in known if p.lower() in n}
    got = [tuple(x) for x in index.find_all(spark.createDataFrame([(p,) for p in patterns * 2], "p string"), "p").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    for p in patterns[:-2]:
        assert {x.name for x in index.find(p).collect()} == {n for q, n in expected if q == p}
    plan = index.find("aab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_name_index_of_nothing(spark, tmp_path):
    index = search.NameIndex(spark, str(tmp_path / "i"), 2).build(spark.createDataFrame([], "name string"), "name")
    assert index.find_all(spark.createDataFrame([("a",), ("",)], "p string"), "p").count() == 0 and index.find("abc").count() == 0


def test_band_best_is_the_least_of_all_pairs_without_pairs(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, Decimal("0.5"), Decimal("-0.5"), Decimal("0")] + [Decimal(r.randint(-400, 400)) / 100 for _ in range(6)])
    a, b = [(i, value()) for i in range(150)], [(r.randint(0, 99), r.randint(1, 3), value()) for _ in range(120)]
    left, right = spark.createDataFrame(a, "i int, x decimal(18,2)"), spark.createDataFrame(b, "best int, k int, y decimal(18,2)")
    got = nearby.band_best(left, right, "x", "y", "best", "k", "0.5")

    def expected(x):
        near = [(p, k) for p, k, y in b if x is not None and y is not None and abs(x - y) < Decimal("0.5")]
        return (min(p for p, _ in near), sum(k for _, k in near)) if near else (None, None)

    assert sorted((p.i, p.best, p.k) for p in got.collect()) == sorted((i, *expected(x)) for i, x in a)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_name_ids_are_short(spark, tmp_path):
    index = search.NameIndex(spark, str(tmp_path / "i"), 2).build(spark.createDataFrame([("Ann",), ("ann",), ("Bob",)], "name string"), "name")
    ids = [bytes(r.name_id) for r in index.names().collect()]
    assert sorted(map(len, ids)) == [16, 16] and {bytes(r.name_id) for r in index.postings().collect()} == set(ids)


def test_sheet_rows_are_plain_columns(spark):
    """The sheet's rows are made by one explode of the codes alone; white space and empty codes go, without codes there is one empty."""
    from ledgerloom.operators import register, validate

    rows = [("a", " 1 ,, \n2\t, ", "9.00"), ("b", None, None), ("c", "3 4,5", "1.00")]
    got = register.gst_register_sheet(validate.with_fields(spark.createDataFrame(rows, "k string, HSN string, TOTAL string")), "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "inline(" not in plan
    cells = {}
    for r in got.orderBy("k", "row").collect():
        cells.setdefault(r["k"], []).append((r["row"], r["head"][:9], r["hsn_code"], r["TOTAL"]))
    assert cells["a"] == [(4, "1", "1", "9.00"), (5, "2", "2", None), (6, "TAX TOTAL", None, "9.00"), (8, "Net Amoun", None, None)]
    assert cells["b"] == [(4, "1", "", None), (5, "TAX TOTAL", None, None), (7, "Net Amoun", None, None)]
    assert [c[2] for c in cells["c"]] == ["3 4", "5", None, None]

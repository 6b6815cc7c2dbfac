import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import extract, extract_v1

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@needs_data
@pytest.mark.parametrize("query", ["freight_fields", "freight_records", "freight_records_v1"])
def test_a_paper_whose_parties_are_one(spark, tmp_path, query):
    """Order 552154 of customer 52154 is the first whose two GSTINs are the same; such orders are only in tables larger than sf0.1."""
    orders = f"SELECT * REPLACE (CASE o_orderkey WHEN 0 THEN 552154 ELSE o_orderkey + 450000 END AS o_orderkey, CASE o_orderkey WHEN 0 THEN 52154 ELSE o_custkey + 45000 END AS o_custkey) FROM '{SF}/orders.parquet' WHERE o_orderkey < 40"
    duckdb.execute(f"COPY ({orders}) TO '{tmp_path}/orders.parquet'")
    got = __spark_entry__.queries()[query](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet'")
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in got.columns)} FROM ({__spark_entry__.oracle_sql()[query]}) ORDER BY 1").fetchall()
    assert [tuple(r) for r in got.orderBy("o_orderkey").collect()] == want
    assert any(r[got.columns.index("GSTIN_S")] == r[got.columns.index("GSTIN_R")] for r in want)


def test_supplier_named_twice_is_no_recipient(spark):
    rows = spark.createDataFrame([("GSTIN: 29ABCDE1234F1Z5\nGSTIN: 29ABCDE1234F1Z5",), ("GSTIN: 29ABCDE1234F1Z5 PAN: ABCDE1234F",)], "raw_text string")
    assert [r.GSTIN_R for r in extract.two_pass(rows).select("GSTIN_R").collect()] == [None, None]


def test_gstins_by_one_search(spark):
    """Without a transport label one search gives what the search by places gives: labelled ones first known, bare ones elsewhere added in order."""
    a, b, c = "29ABCDE1234F1Z5", "27ZZZZZ1234F1Z5", "33QQQQQ9999Q1Z9"
    texts = [f"{a} x {b}\nGSTIN/UIN: {c} gsti: {a.lower()}", f"GSTIN: {a}X\n{b} {b}", f"x{a} {c}", "none", f"GSTIN {a}\nGSTIN: {a}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select(extract.gstins(F.col("t")).alias("one"), extract.gstins(F.concat("t", F.lit("." * 99 + "transport"))).alias("placed"), "i").orderBy("i").collect()
    assert [r.one for r in got] == [r.placed for r in got] == [[b, c, a], [a, b], [c], [], [a]]


def test_no_rule_runs_on_an_absent_text(spark):
    rows = spark.createDataFrame([(None,), ("TAX INVOICE",)], "t string")
    got = extract.full_extract(rows, "t", "r").orderBy("t").collect()
    assert got[0].r is None and got[1].r is not None


def test_older_roles_by_one_search(spark):
    """Labelled and bare GSTINs by place; what stands before one is lower-cased once, not once for each use."""
    a, b, c = "29ABCDE1234F1Z5", "27ZZZZZ1234F1Z5", "33QQQQQ9999Q1Z9"
    texts = [f"{a}\nGSTIN: {b}\nBuyer GSTIN/UIN: {a}", f"GSTIN: {a.lower()} x {b}", f"Buyer\n{c} {a}", f"{a} GST No. {a}9 {b}", "none", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", extract_v1.gstin_roles(F.col("t")).alias("r"))
    got = [r.r and (r.r.supplier, r.r.recipient) for r in rows.orderBy("i").collect()]
    assert got == [(b, a), (a, b), (c, c), (a, a + "9"), (None, None), None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2


@needs_data
def test_older_rules_run_only_for_what_is_asked(spark):
    """Of the older rules only those of the fields in the result are in the plan, and its rows are dealt to all tasks."""
    from ledgerloom.plans import coverage

    got = coverage.older_rates(spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CGST" in plan and "IFSC" not in plan and "Challan" not in plan
    assert "hashpartitioning(o_orderkey" in got._jdf.queryExecution().executedPlan().toString()


def test_older_rules_with_words_missing_or_folded(spark):
    """A rule is searched where one of its words is, in any case; noise is repaired where any rule matches."""
    texts = ["CGST @ 9%\nIGST RATE: 18%\nvendor code 55", "net payable 1,234.50\nChallan No 77", "nothing", None, "lnvoice Date: 12J052020\nAssessoble value 100.00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string")
    got = {r["i"]: r for r in extract_v1.master_extract(rows).select("i", "CGST_RATE", "IGST_RATE", "VENDOR_CODE", "TOTAL", "CHALLAN_NO", "TAXABLE", "INV_DATE").collect()}
    assert (got[0]["CGST_RATE"], got[0]["IGST_RATE"], got[0]["VENDOR_CODE"]) == ("9%", "18%", "55")
    assert (got[1]["TOTAL"], got[1]["CHALLAN_NO"]) == ("1234.50", "77")
    assert all(v is None for i in (2, 3) for f, v in got[i].asDict().items() if f != "i")
    assert (got[4]["TAXABLE"], got[4]["INV_DATE"]) == ("100.00", "12/05/2020")


def test_extraction_runs_only_what_is_asked_and_once(spark):
    """Of the rules only those of the fields in the result are in the plan, and a pattern stands there once a pass."""
    rows = spark.createDataFrame([("IFSC: SBIN0001234",), ("Account No: 1234567",), (None,)], "raw_text string")
    got = extract.two_pass(rows).select("IFSC", "SHIP_BY")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Challan" not in plan and "Consignee" not in plan
    assert plan.count("Ship") == 2
    assert [tuple(r) for r in got.collect()] == [("SBIN0001234", None), (None, None), (None, None)]


def test_rules_of_several_patterns_pass_over_lines_without_their_label(spark):
    """The first line with a label gives nothing, a later one does; each head is on the first line of whatever its patterns match."""
    texts = ["Invoice No\nInvoice Date: none\nDated\nx 3-Jan-20\nInvoice Date: 01/02/2020", "Account x\nA/e No: 1234567", "State of x\nState Name: Goa, Code: 30", "abc IN-55\n AB/1234/20 \nIN-77"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.r for r in extract.full_extract(rows, "t", "r").orderBy("i").collect()]
    assert (got[0].INV_DATE, got[1].AC_NO, got[2].STATE_CODE, got[3].INV_NO) == ("3-Jan-2020", "1234567", "30", "AB/1234/20")

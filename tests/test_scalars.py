from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import text as X


def run(spark, make, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


NOISE = [
    ("27C0RPP3939N1ZQ", "27CORPP3939N1ZQ"), ("32AABBA789081ZB", "32AABBA7890B1ZB"), (": 2QAAFFC1234K1Z5", ": 29AAFFC1234K1Z5"), ("31/0a/2018", "31/08/2018"), ("31J082018", "31/08/2018"), ("31/082018", "31/08/2018"), ("23-Ju-2025", "23-Jul-2025"), ("4496,17", "4496.17"),
    ("%6", "6%"), ("lnvoice Involce flet", "Invoice Invoice Net"), ("ICICOQ123 ICICOQ000456 ICICOQ1234567", "ICIC0000123 ICIC0000456 ICIC01234567"), ("IClC0123", "ICIC0123"), ("A/e No. 5", "A/c No. 5"), ("9% 4496.17", "9% 4496.17"), (None, None), ("", ""),
]


def test_noise(spark):
    assert run(spark, S.fix_noise, *[a for a, _ in NOISE]) == [b for _, b in NOISE]
    assert run(spark, lambda c: S.fix_noise(c, strict=True), "%6", "9% 4496.17") == ["6", "94496.17"]
    assert run(spark, lambda c: S.fix_noise(c, tenant=True), "!TBG/18-19/330411TP/1328", "3304ATP/1328") == ["ITBG/18-19/3304/TP/1328", "3304/TP/1328"]
    assert run(spark, S.fix_noise_v1, "4283 9(", "12 34", "lnvoice", "%500") == ["4283.97", "12.34", "Invoice", "₹500"]


def test_amounts(spark):
    assert run(spark, S.clean_amount, "₹ 1,18,000.50", "(500)", "2019", "0", "-5", "1_0", "5d", "", None, "abc") == [Decimal("118000.5000"), Decimal("500.0000"), *[None] * 8]
    assert run(spark, S.to_amount, "1,18,000", "-5", "x", "12%") == [Decimal("118000.0000"), Decimal("-5.0000"), None, Decimal("12.0000")]
    assert run(spark, S.parse_amount, "Rs.1,00,000", "INR 5", "1972") == [Decimal("100000.0000"), Decimal("5.0000"), None]
    assert run(spark, lambda c: S.show(S.to_amount(c)), "2.675", "1") == ["2.68", "1.00"]
    assert run(spark, lambda c: S.show_rate(S.to_amount(c)), "9", "2.5") == ["9%", "2.5%"]
    assert run(spark, lambda c: S.close(S.to_amount(c), F.lit(100).cast("decimal(18,4)"), 0.015), "101", "102", "0", None) == [True, False, False, False]


@pytest.mark.parametrize("words,value", [("Two Lakh Fifty Three Thousand One Hundred Five", 253105), ("one crore", 10000000), ("hundred", 100), ("tltty rune", 59), ("no number", None), ("", None)])
def test_words_to_number(spark, words, value):
    assert run(spark, S.words_to_number, words) == [value]


def test_number_to_words(spark):
    say = lambda c: S.number_to_words(c.cast("decimal(18,2)"))
    assert run(spark, say, "253105", "0.05", "10000000.50", "0", "120", None) == [
        "Two Lakh Fifty Three Thousand One Hundred Five Rupees Only", "Zero Rupees and Five Paise Only", "One Crore Rupees and Fifty Paise Only", None, "One Hundred Twenty Rupees Only", None,
    ]


def test_dates(spark):
    assert run(spark, S.slash_date, "20-Dec-20", "02 - Oct - 2024", "31/08/2018", "23-Jul-2025", "31.8.18", "31082018", "1/1/1999", "soon", "", None) == ["20/12/2020", "02/10/2024", "31/08/2018", "23/07/2025", "31/08/2018", "31/08/2018", None, "soon", None, None]
    assert run(spark, S.normal_date, "20-Dec-20", "31J082018", "31082018", "31/082018", "1/1/1999", "a!b", "x", None) == ["20-Dec-2020", "31/08/2018", "31/08/2018", "31/08/2018", None, None, None, None]
    assert run(spark, S.record_date, "20-Dec-20", "1/2/18", "5/5/1990", None) == ["20/12/2020", "01/02/2018", None, None]


def test_identifiers(spark):
    assert run(spark, S.is_gstin, "29AACCT3705E000", "29AACCT3705E1Z5", "x") == [True, True, False]
    assert run(spark, lambda c: S.is_gstin(c, strict=True), "29AACCT3705E000", "29AACCT3705E1Z5") == [False, True]
    assert run(spark, lambda c: S.fix_pan(c, F.lit("PAN: ABCDE1234F")), "AA8CK1234A", "bad", None) == ["AABCK1234A", "ABCDE1234F", "ABCDE1234F"]
    assert run(spark, lambda c: S.fix_cin(c, F.lit("x L12345MH2000PLC123456 y")), "nope", "U12345KA1999PTC000001") == ["L12345MH2000PLC123456", "U12345KA1999PTC000001"]
    assert run(spark, S.fix_ifsc, "icicoq123", "SBINO001234", None) == ["ICIC0123", "SBIN0001234", None]
    assert run(spark, lambda c: S.fix_invoice_number(c, F.lit("")), "!NV/1 I", "ABC/1") == ["INV/1", "ABC/1"]
    assert run(spark, lambda c: S.fix_invoice_number(c, F.lit("ITBG/18-19/3304/TP/1328"), tenant=True), "!T8G/18-19/3304") == ["ITBG/18-19/3304/TP/1328"]
    assert run(spark, S.fix_reference, "rTP/1", "TP/2", "{X}9") == ["ITP/1", "ITP/2", "X9"]
    assert run(spark, S.is_place, "Karnataka", "kar", "Nowhere") == [True, True, False]
    assert run(spark, lambda c: S.state_name(c, F.lit("?")), "29", "99") == ["Karnataka", "?"]
    assert run(spark, S.tidy_value, " a b., ", "x▁y", "日本", "", None) == ["a b", None, None, None, None]


def test_json_and_maps(spark):
    assert run(spark, S.repair_json, '```json\n{"a": 1,}\n```', '{"a": [1, 2, ], }') == ['{"a": 1}', '{"a": [1, 2 ] }']
    assert run(spark, S.decode_record, '{"a": "1"}', None) == [{"a": "1"}, {}]
    rec = lambda c: S.normal_record(F.from_json(c, "map<string,string>"))
    got = run(spark, rec, '{"PLACE_OF_SUPPLY": "Goa", "TOTAL": "₹ 1,000", "GST_RATE": "18", "GSTIN_S": "30ABCDE1234F1Z5", "X": " "}')[0]
    assert got == {"PLACE": "Goa", "TOTAL": "1000", "GST_RATE": "18%", "GSTIN_S": "30ABCDE1234F1Z5", "STATE_CODE": "30"}


def test_text_helpers(spark):
    assert run(spark, lambda c: X.match_starts(c, "ab"), "xxabyab", "none", None) == [[2, 5], [], None]
    assert run(spark, lambda c: X.line_first(c, r"A\s*:\s*(\d+)", r"B\s*:\s*(\d+)"), "x\nB: 2\nA: 1", "B: x\n3", "A:\n5") == ["2", None, None]
    assert run(spark, lambda c: X.line_first(c, X.label_line("No", r"(\d+)", 2)), "No\n\n: 7", "No 7") == ["7", None]
    assert run(spark, lambda c: X.first_of(c, "(a+)", "(b+)"), "bbaa", "b", "c") == ["aa", "b", None]
    assert run(spark, X.strip_lead, " : -| x ", None) == ["x", None]
    assert run(spark, lambda c: X.find(c, X.on_line(r"(a\s+b[\s:]c)")), "a \tb:c", "a\nb c", "a b\nc") == ["a \tb:c", None, None]


def test_boxes(spark):
    row = spark.range(1).select(S.normal_box(F.lit(-5), F.lit(10), F.lit(300), F.lit(99), F.lit(200), F.lit(100)).alias("b")).first()
    assert row.b == [0, 100, 1000, 990]

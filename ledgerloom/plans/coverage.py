"""Queries that check single operators on values made from the tables, in every branch, each with its SQL.

The SQL says what an operator means in other words: by cases of the number that a value was made from, or by DuckDB's own functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import EXACT, contains_any, match_places, match_starts
from ..operators import extract, extract_v1, jobs, labeling, merge, nearby, register, search, validate
from ..sources import content, readers, sinks, versioned, workbooks
from ..streaming import microbatch
from . import catalog, freight
from .render import LETTERS, invoices, papers, read, spread

D2 = "decimal(18,2)"


def _choose(n: Column, *values) -> Column:
    """values[n], a Column each or a text."""
    out = None
    for i, v in enumerate(values):
        c = v if isinstance(v, Column) else F.lit(v)
        out = F.when(n == i, c) if out is None else out.when(n == i, c)
    return out


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _letters(x: Column) -> Column:
    return F.translate(x.cast("string"), *LETTERS)


LETTERS_SQL = "translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


# ---- identifiers, names, dates ----


def repaired_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAN, CIN, IFSC, invoice and order numbers, transport, terms and delivery date, each whole, misread, only in the text, or bad."""
    c = F.col("c_custkey")
    four, six = F.lpad(F.pmod(c, F.lit(10000)).cast("string"), 4, "0"), F.lpad(F.pmod(c, F.lit(1000000)).cast("string"), 6, "0")
    n = F.pmod(c, F.lit(4))
    pan = F.concat(F.lit("ABCDE"), four, F.lit("F"))
    cin = F.concat(F.lit("U12345KA1999PTC"), six)
    raw = F.concat(F.lit("x\nPAN No: "), pan, F.lit("\nCIN: "), cin, F.lit("\nDBA Date: 12-JAN-20\n"))
    text = F.when(n == 3, F.lit("nothing here")).otherwise(raw)
    given = _choose(n, F.concat(F.lit("AB8DE"), four, F.lit("F")), pan, F.lit(None).cast("string"), F.lit("bad"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", S.fix_pan(given, text).alias("pan"), S.fix_cin(_choose(n, cin, F.lit(None).cast("string"), F.lit("x"), F.lit(None).cast("string")), text).alias("cin"),
        S.fix_ifsc(_choose(n, F.concat(F.lit(" sbinO"), six), F.concat(F.lit("ICICOQ"), four), F.concat(F.lit("SBIN0"), six), F.lit("hdfco123456"))).alias("ifsc"),
        S.fix_invoice_number(_choose(n, F.concat(F.lit("|NV/"), four, F.lit(" I")), F.concat(F.lit("!NV-"), four), F.concat(F.lit(" INV"), four), four), F.lit("")).alias("inv_no"),
        S.fix_reference(_choose(n, F.concat(F.lit("rTP/"), four), F.concat(F.lit("fTP/{"), four, F.lit("}")), F.concat(F.lit("TP/["), four, F.lit("]")), F.concat(F.lit("DB/"), four))).alias("reference"),
        S.fix_transport(_choose(n, F.concat(F.lit("er Name Giobal "), _letters(c)), F.concat(F.lit("Giobal "), _letters(c)), F.concat(F.lit("GLOBAL "), _letters(c)), F.lit("x"))).alias("transport"),
        S.fix_payment_terms(_choose(n, F.lit("29ABCDE1234F1Z5"), F.lit("Net thirty days"), F.lit("29 days"), F.lit("12abcdeX"))).alias("terms"), S.find_dba_date(F.when(n == 1, F.lit("01/02/20")), text).alias("dba_date"),
        S.cut_at(F.concat(F.lit("Trader "), _letters(c), _choose(n, " Road 5", " GSTIN 29", "", " 560001 Town")), r"\s+(?:Road|GSTIN|\d{6})", 12).alias("name"),
    )


IDENTITIES_SQL = f"""
    WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS four, lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS six FROM customer)
    SELECT c_custkey, CASE n WHEN 0 THEN 'ABBDE' || four || 'F' WHEN 3 THEN NULL ELSE 'ABCDE' || four || 'F' END AS pan, CASE WHEN n < 3 THEN 'U12345KA1999PTC' || six END AS cin,
           CASE n WHEN 1 THEN 'ICIC0' || four WHEN 3 THEN 'HDFC0123456' ELSE 'SBIN0' || six END AS ifsc, CASE n WHEN 0 THEN 'INV/' || four WHEN 1 THEN 'INV-' || four WHEN 2 THEN 'INV' || four ELSE four END AS inv_no,
           CASE n WHEN 3 THEN 'DB/' || four ELSE 'ITP/' || four END AS reference, CASE n WHEN 2 THEN 'GLOBAL ' || {LETTERS_SQL.format('c_custkey')} WHEN 3 THEN 'x' ELSE 'Global ' || {LETTERS_SQL.format('c_custkey')} END AS transport,
           CASE n WHEN 1 THEN 'Net thirty days' WHEN 2 THEN '29 days' END AS terms, CASE n WHEN 1 THEN '01/02/20' WHEN 3 THEN NULL ELSE '12-JAN-20' END AS dba_date, substr('Trader ' || {LETTERS_SQL.format('c_custkey')}, 1, 12) AS name
    FROM c
"""


def gstin_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GSTINs that are whole, relaxed only, too short, spelt with a letter too few, lower case, or absent."""
    c = F.col("c_custkey")
    digits = F.lpad(F.pmod(c, F.lit(10000)).cast("string"), 4, "0")
    g = _choose(F.pmod(c, F.lit(6)), F.concat(F.lit("29ABCDE"), digits, F.lit("F1Z5")), F.concat(F.lit("29ABCDE"), digits, F.lit("F0A5")), F.concat(F.lit("29ABCDE"), digits, F.lit("F1")), F.concat(F.lit("29ABC1E"), digits, F.lit("F1Z5")), F.concat(F.lit("07abcde"), digits, F.lit("f1z5")), F.lit(None).cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(S.is_gstin(g), F.lit(False)).alias("relaxed"), F.coalesce(S.is_gstin(g, strict=True), F.lit(False)).alias("strict"), S.state_code(g).alias("code"), S.state_name(S.state_code(g)).alias("state"), S.state_for_tax(S.state_code(g)).alias("for_tax"))


def older_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older record pass over dates: named months, two-digit years, years out of range, unknown forms."""
    o, d = F.col("o_orderkey"), F.add_months(F.to_date("o_orderdate"), 120)
    shown = _choose(F.pmod(o, F.lit(5)), F.date_format(d, "dd-MMM-yy"), F.date_format(d, "dd / MM / yy"), F.date_format(d, "dd/MM/yyyy"), F.concat(F.lit("1 of "), F.date_format(F.add_months(d, -240), "yyyy")), F.lit("soon"))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.record_date(shown).alias("date"))


def date_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice date that is another of the record's dates gives way to one from the text."""
    o, d = F.col("o_orderkey"), F.add_months(F.to_date("o_orderdate"), 120)
    day = lambda more: F.date_format(F.date_add(d, more), "dd/MM/yyyy")
    n = F.pmod(o, F.lit(4))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day(0).alias("INV_DATE"), _choose(n, day(0), day(1), day(0), day(2)).alias("ACK_DATE"), F.when(n == 2, day(3)).alias("OA_DATE"), F.concat(F.lit("Invoice Date: "), _choose(n, day(5), day(5), day(3), day(5)), F.lit("\nIssue Date: "), F.date_format(F.date_add(d, 6), "dd - MMM - yyyy")).alias("raw_text"))
    return validate.post_process(rows, [validate.fix_invoice_date]).select("o_orderkey", "INV_DATE")


def place_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that are known, part of a known one, unknown, with digits, too short or absent."""
    c = F.col("c_custkey")
    place = _choose(F.pmod(c, F.lit(7)), F.lit("Karnataka"), F.lit("karna"), F.lit("Atlantis"), F.lit("Goa 2"), F.lit("UP"), F.lit("South Goa Beach"), F.lit(None).cast("string"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", place.alias("PLACE"), F.lit("").alias("raw_text"))
    return validate.post_process(rows, [validate.validate_place]).select("c_custkey", "PLACE", F.coalesce(S.is_place(place), F.lit(False)).alias("known"))


# ---- values ----


def tidied_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing marks, marker characters, other scripts, line feeds; amounts and turned rates."""
    o = F.col("o_orderkey")
    n = F.pmod(o, F.lit(6))
    name = F.concat(F.lit("Shop "), _letters(o))
    value = _choose(n, F.concat(F.lit("  "), name, F.lit(" .,")), F.concat(F.lit("Ġ"), name), F.concat(name, F.lit("\nx")), F.concat(name, F.lit(" 中")), F.lit(" |; "), F.concat(name, F.lit(" ₹é")))
    amount = _choose(n, F.lit("1,234.567 only"), F.lit("₹ 5"), F.lit("12"), F.lit("0.5"), F.lit(None).cast("string"), F.lit("12.3.4"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", value.alias("SUPPLIER"), amount.alias("TAXABLE"), _choose(n, "%9", "9%", "%123", "9", "% 9", "x").alias("CGST_RATE"), F.lit("").alias("raw_text"))
    return validate.post_process(rows, [validate.clean_strings, validate.fix_amounts]).select("o_orderkey", "SUPPLIER", "TAXABLE", "CGST_RATE")


TIDIED_SQL = f"""
    SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Shop ' || {LETTERS_SQL.format('o_orderkey')} WHEN 5 THEN 'Shop ' || {LETTERS_SQL.format('o_orderkey')} || ' ₹é' END AS "SUPPLIER",
           ['1234.56', '₹ 5', '12', '0.5', NULL, '12.3'][o_orderkey % 6 + 1] AS "TAXABLE", ['9%', '9%', '%123', '9', '% 9', 'x'][o_orderkey % 6 + 1] AS "CGST_RATE"
    FROM orders
"""


def block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block-lists a text has a word of: one word of each list in turn, in capitals, inside a longer text."""
    rows = read(spark, sf_dir, "customer")
    pick = lambda words: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.col("c_custkey"), F.lit(len(words) + 3)).cast("int"))
    inside = lambda words: F.concat(F.lit("a "), F.upper(F.coalesce(pick(words), F.lit("plain"))), F.lit(" z"))
    lists = {"supplier": fixed.NOT_SUPPLIER, "recipient": fixed.NOT_RECIPIENT, "late": fixed.NOT_RECIPIENT_LATE, "description": fixed.NOT_DESCRIPTION}
    return rows.select("c_custkey", *[contains_any(inside(w), w).alias(k) for k, w in lists.items()])


BLOCK_SQL = "SELECT c_custkey, " + ", ".join(f"c_custkey % {len(w) + 3} < {len(w)} AS {k}" for k, w in {"supplier": fixed.NOT_SUPPLIER, "recipient": fixed.NOT_RECIPIENT, "late": fixed.NOT_RECIPIENT_LATE, "description": fixed.NOT_DESCRIPTION}.items()) + " FROM customer"


def excluded_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are excluded, zero, negative, bracketed, or no numbers, read by the three parsers."""
    o = F.col("o_orderkey")
    text = _choose(F.pmod(o, F.lit(7)), F.lit("2019"), F.lit("(1,972)"), F.lit("0.00"), F.lit("-5"), F.lit("abc"), F.concat(F.lit("₹"), o.cast("string"), F.lit(".50")), F.lit("330411"))
    return read(spark, sf_dir, "orders").select("o_orderkey", S.clean_amount(text).cast("double").alias("clean"), S.to_amount(text).cast("double").alias("any"), S.parse_amount(text).cast("double").alias("older"), S.loose_number(text).cast("double").alias("loose"), S.close(S.to_amount(text), F.lit(5).cast(D2), 0.1).alias("near"))


#: Field, value, and whether it looks like its field.
ENTITIES = [
    ("INV_DATE", "20-Dec-2020", 1), ("INV_DATE", "soon then", 0), ("PLACE", "Goa", 1), ("PLACE", "Atlantis", 0), ("GSTIN_S", "29ABCDE1234F1Z5", 1), ("GSTIN_R", "29ABCDE", 0), ("TAXABLE", "1,234.50", 1), ("CGST", "ten", 0),
    ("CGST_RATE", "9%", 1), ("SGST_RATE", "900%", 0), ("QTY", "15", 1), ("QTY", "1500", 0), ("SUPPLIER", "ACME", 1), ("SUPPLIER", "ĠACME", 0), ("RECIPIENT", "x", 0), ("RECIPIENT", "中文名字", 0), ("HSN", "@#$%^&", 0), ("BANK", "S B I", 1),
]


def entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of a model that look like their field, and others that don't."""
    at = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(ENTITIES))).cast("int")
    pick = lambda i: F.get(F.array(*[F.lit(g[i]) for g in ENTITIES]), at)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pick(0).alias("field"), pick(1).alias("value"))
    return rows.groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if(merge.entity_is_valid(F.col("field"), F.col("value"))).alias("valid"))


ENTITY_SQL = f"""
    WITH e(i, field, value, good) AS (VALUES {', '.join(f"({i}, '{f}', '{v}', {g})" for i, (f, v, g) in enumerate(ENTITIES))})
    SELECT field, value, count(*) AS n, CAST(sum(good) AS BIGINT) AS valid FROM lineitem JOIN e ON (l_orderkey + l_linenumber) % {len(ENTITIES)} = i GROUP BY 1, 2
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a page as thousandths, and whether they are boxes: right way round, within the page."""
    n = lambda c, m: F.pmod(F.col(c), F.lit(m)).cast("int")
    x0, y0, x1, y1 = n("l_partkey", 700) - 50, n("l_suppkey", 900) - 20, n("l_partkey", 500) + n("l_linenumber", 7) * 120, n("l_suppkey", 600) + n("l_orderkey", 700)
    box = S.normal_box(x0, y0, x1, y1, F.lit(800), F.lit(1100))
    raw = F.array(x0, y0, x1, y1)
    kept = labeling.valid_words(F.array(F.lit("a"), F.lit("b")), F.array(box, raw), F.array(F.lit(1), F.lit(2)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.get(box, i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))], labeling.valid_box(raw).alias("whole"), labeling.valid_box(raw, bounded=False).alias("loose"), F.array_join(F.transform(kept, lambda z: z["word"]), "").alias("words"))


BOX_SQL = """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 700 - 50 AS a, l_suppkey % 900 - 20 AS b, l_partkey % 500 + l_linenumber % 7 * 120 AS c, l_suppkey % 600 + l_orderkey % 700 AS d FROM lineitem),
    s AS (SELECT *, CAST(greatest(0, floor(1000 * a / 800)) AS INTEGER) AS x0, CAST(greatest(0, floor(1000 * b / 1100)) AS INTEGER) AS y0, CAST(least(1000, floor(1000 * c / 800)) AS INTEGER) AS x1, CAST(least(1000, floor(1000 * d / 1100)) AS INTEGER) AS y1, c > a AND d > b AS loose FROM r),
    v AS (SELECT *, loose AND least(a, b, c, d) >= 0 AND greatest(a, b, c, d) <= 1000 AS whole, x1 > x0 AND y1 > y0 AND x1 >= 0 AND y1 >= 0 AND x0 <= 1000 AND y0 <= 1000 AS first_ok FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x0, y0, x1, y1, whole, loose, CASE WHEN first_ok AND whole THEN 'ab' WHEN first_ok THEN 'a' WHEN whole THEN 'b' ELSE '[PAD]' END AS words FROM v
"""


def model_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's fenced JSON with trailing commas: repaired, normalised, and read back."""
    e = F.col("event_id").cast("string")
    said = F.concat(F.lit('Sure:\n```json\n{"PLACE_OF_SUPPLY": "Goa '), e, F.lit('", "TAXABLE": "₹ 1,2'), e, F.lit('.50", "TOTAL": "INR '), e, F.lit('", "CGST_RATE": "9", "SGST_RATE": "9%", "GSTIN_S": "29ABCDE1234F1Z5", "X": "",}\n```'))
    record = S.normal_record(S.decode_record(S.repair_json(F.when(F.col("event_id") % 5 == 0, F.lit("no json")).otherwise(said))))
    item = lambda k: S.get_item(F.col("record"), k).alias(k.lower())
    # a row's record is made once, for all that is read from it
    rows = read(spark, sf_dir, "events").select("event_id", F.explode(F.array(record)).alias("record"))
    return rows.select("event_id", item("PLACE"), item("TAXABLE"), item("TOTAL"), item("CGST_RATE"), item("SGST_RATE"), item("STATE_CODE"), item("X"), register.field_count(F.col("record")).alias("fields"))


MODEL_SQL = """
    SELECT event_id, CASE WHEN ok THEN 'Goa ' || event_id END AS place, CASE WHEN ok THEN '12' || event_id || '.50' END AS taxable, CASE WHEN ok THEN CAST(event_id AS VARCHAR) END AS total, CASE WHEN ok THEN '9%' END AS cgst_rate, CASE WHEN ok THEN '9%' END AS sgst_rate,
           CASE WHEN ok THEN '29' END AS state_code, CAST(NULL AS VARCHAR) AS x, CASE WHEN ok THEN 7 ELSE 0 END AS fields
    FROM (SELECT event_id, event_id % 5 <> 0 AS ok FROM events)
"""


# ---- records ----


def name_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a labelled GSTIN, the one nearer to the supplier's name supplies; a labelled one comes first."""
    c = F.col("c_custkey")
    a, b = F.concat(F.lit("29AAAAA"), F.lpad(F.pmod(c, F.lit(10000)).cast("string"), 4, "0"), F.lit("A1Z5")), F.concat(F.lit("27BBBBB"), F.lpad(F.pmod(c, F.lit(10000)).cast("string"), 4, "0"), F.lit("B1Z5"))
    n = F.pmod(c, F.lit(4))
    far = F.lit("x" * 60)
    text = _choose(n, F.concat_ws(" ", b, F.lit("ACME TOOLS LIMITED"), far, a), F.concat_ws(" ", a, F.lit("ACME TOOLS LIMITED"), far, b), F.concat(F.lit("ACME TOOLS LIMITED "), b, far, F.lit(" GSTIN: "), a), F.concat(F.lit("GSTIN: "), b))
    rows = read(spark, sf_dir, "customer").select("c_custkey", a.alias("GSTIN_S"), F.when(n < 3, b).alias("GSTIN_R"), F.lit("ACME TOOLS LIMITED").alias("SUPPLIER"), text.alias("raw_text"))
    return validate.post_process(rows, [validate.fix_gstins]).select("c_custkey", "GSTIN_S", "GSTIN_R")


SWAP_SQL = """
    WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, '29AAAAA' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'A1Z5' AS a, '27BBBBB' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'B1Z5' AS b FROM customer)
    SELECT c_custkey, CASE WHEN n IN (0, 3) THEN b ELSE a END AS "GSTIN_S", CASE WHEN n IN (0, 3) THEN a ELSE b END AS "GSTIN_R" FROM c
"""


def gstin_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GSTINs of a text once each, in the order of their labelled place or else of their first, without bare ones near a transporter's label."""
    c = F.col("c_custkey")
    g = lambda word, more=0: F.concat(F.lit("29"), F.lit(word), F.lpad(F.pmod(c + more, F.lit(10000)).cast("string"), 4, "0"), F.lit("A1Z5"))
    text = F.concat_ws("\n", F.concat(F.lit("bare "), g("AAAAA")), F.lit("Transport ID"), g("TTTTT"), F.lit("a line that is long enough to be far away"), F.concat(F.lit("GSTIN/UIN: "), g("BBBBB")), F.concat(F.lit("gstin : "), F.lower(g("AAAAA"))), F.concat(F.lit("again "), g("BBBBB")), F.when(c % 2 == 0, F.concat(F.lit("Transport GSTIN: "), g("UUUUU"))))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(extract.gstins(text), ",").alias("gstins"))


def name_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and recipient cut at words that can't belong to a name; a blocked recipient is looked for again."""
    c = F.col("c_custkey")
    n = F.pmod(c, F.lit(4))
    rows = read(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("ACME  "), _letters(c), _choose(n, " LTD in words: two Rupees x", " LTD Certified true", " LTD.;", " LTD TAX TOTAL 5")).alias("SUPPLIER"),
        _choose(n, F.concat(F.lit("Trader "), _letters(c), F.lit(" Phone 5")), F.lit("customer order 7"), F.lit(None).cast("string"), F.lit("Abc Delivery now")).alias("RECIPIENT"),
        F.concat(F.lit("Buyer (Bill to)\nFound "), _letters(c), F.lit(" Road 9\n12")).alias("raw_text"),
    )
    return validate.post_process(rows, [validate.fix_names]).select("c_custkey", "SUPPLIER", "RECIPIENT")


NAMES_SQL = f"""
    WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, {LETTERS_SQL.format('c_custkey')} AS x FROM customer)
    SELECT c_custkey, 'ACME ' || x || CASE n WHEN 0 THEN ' LTD two' ELSE ' LTD' END AS "SUPPLIER", CASE n WHEN 0 THEN 'Trader ' || x WHEN 3 THEN 'Abc Delivery now' ELSE 'Found ' || x END AS "RECIPIENT" FROM c
"""


def tax_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IGST within a state, an SGST that is the taxable value or far too great, and CGST and SGST across states."""
    o = F.col("o_orderkey")
    t = F.round(F.col("o_totalprice"), 0).cast("decimal(12,2)")
    n = F.pmod(o, F.lit(4))
    show = lambda x: S.show(x)
    half = F.round(t * 9 / 100, 2).cast(D2)
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("29ABCDE1234F1Z5").alias("GSTIN_S"), F.when(n == 3, "27ABCDE1234F1Z5").otherwise("29ABCDE1234F1Z6").alias("GSTIN_R"), show(t).alias("TAXABLE"), show(half).alias("CGST"),
        _choose(n, show(half), show(t), show(half * 6), show(half)).alias("SGST"), _choose(n, F.lit("12.00"), F.lit(None).cast("string"), F.lit(None).cast("string"), show((half * 2).cast(D2))).alias("IGST"), F.lit("9%").alias("CGST_RATE"), F.lit("18%").alias("IGST_RATE"),
    )
    return validate.post_process(rows, [validate.clear_intrastate_igst, validate.fix_sgst, validate.fix_interstate]).select("o_orderkey", "CGST", "SGST", "IGST", "CGST_RATE", "IGST_RATE")


TAX_SQL = f"""
    WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS n, (CAST(round(o_totalprice, 0) AS BIGINT) * 100 * 9 + 50) // 100 AS h FROM orders)
    SELECT o_orderkey, CASE WHEN n < 3 THEN {freight._show('h')} END AS "CGST", CASE WHEN n < 3 THEN {freight._show('h')} END AS "SGST", CASE WHEN n = 3 THEN {freight._show('2 * h')} END AS "IGST", CASE WHEN n < 3 THEN '9%' END AS "CGST_RATE", CASE WHEN n > 0 THEN '18%' END AS "IGST_RATE" FROM o
"""


def invoice_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label and value tab of every order as a record, filled sections only."""
    rows = validate.with_fields(read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string")).alias("SUPPLIER"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("PLACE"), F.lit("").alias("HSN"), F.col("o_orderstatus").alias("UPI_ID"), F.col("o_custkey").cast("string").alias("INV_NO")))
    counted = register.filled_sections(rows, "o_orderkey").select("o_orderkey", "section", F.col("rows").alias("filled"))
    return register.sections(rows, "o_orderkey").join(counted, ["o_orderkey", "section"]).select("o_orderkey", "section", "ordinal", "field", "label", "value", "filled")


SECTION_SQL = """
    SELECT o_orderkey, 'Supplier Details' AS section, 0 AS ordinal, 'SUPPLIER' AS field, 'Supplier Name' AS label, 'Clerk ' || o_custkey AS value, 1::BIGINT AS filled FROM orders UNION ALL
    SELECT o_orderkey, 'Buyer / Recipient', 103, 'PLACE', 'Place of Supply', o_orderpriority, 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
    SELECT o_orderkey, 'Invoice Details', 200, 'INV_NO', 'Invoice No.', CAST(o_custkey AS VARCHAR), 1 FROM orders UNION ALL
    SELECT o_orderkey, 'Bank & Payment', 503, 'UPI_ID', 'UPI ID', o_orderstatus, 1 FROM orders
"""


def any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record has any of some fields; its total tax; its header line where it has no items."""
    o = F.col("o_orderkey")
    rows = validate.with_fields(read(spark, sf_dir, "orders").select("o_orderkey", F.when(o % 3 == 0, "x").otherwise("").alias("OA_NO"), F.when(o % 5 == 0, "y").alias("DBA_NO"), o.cast("string").alias("ITEM_DESC"), F.lit("7").alias("QTY")))
    taxes = [F.when(o % m == 0, F.col("o_custkey").cast(D2) * m) for m in (2, 3, 5)]
    own = rows.withColumn("has", register.has_value(["OA_NO", "DBA_NO"])).join(read(spark, sf_dir, "orders").select("o_orderkey", register.total_tax(*taxes).cast("double").alias("tax")), "o_orderkey")
    details = register.invoice_details(rows, "o_orderkey").select("o_orderkey", "sl_no", "description", "qty")
    return own.select("o_orderkey", "has", "tax").join(details, "o_orderkey")


# ---- jobs ----


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' lists: five newest batches of a user, ten newest of all, ten newest of a user with counts beside."""
    orders = read(spark, sf_dir, "orders")
    show = lambda name, rows: rows.select(F.lit(name).alias("page"), "o_orderkey")
    own = jobs.owned(orders, "o_custkey", 7)
    return show("batches", jobs.recent(orders, 5, "o_orderdate", "o_orderkey", "o_custkey", 7)).union(show("versions", jobs.recent(orders, 10, "o_orderdate", "o_orderkey"))).union(show("dashboard", jobs.recent(own, 10, "o_orderdate", "o_orderkey"))).union(jobs.status_counts(own, "o_custkey", "o_orderstatus", ["F", "O", "P"]).select(F.lit("counts"), (F.col("jobs") * 1000000 + F.col("n_f") * 10000 + F.col("n_o") * 100 + F.col("n_p"))))


PAGES_SQL = """
    WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS s, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS own FROM orders)
    SELECT 'batches' AS page, o_orderkey FROM o WHERE o_custkey = 7 AND own <= 5 UNION ALL SELECT 'versions', o_orderkey FROM o WHERE place <= 10 UNION ALL SELECT 'dashboard', o_orderkey FROM o WHERE o_custkey = 7 AND own <= 10 UNION ALL
    SELECT 'counts', count(*) * 1000000 + count(*) FILTER (s = 'F') * 10000 + count(*) FILTER (s = 'O') * 100 + count(*) FILTER (s = 'P') FROM o WHERE o_custkey = 7 GROUP BY o_custkey
"""


def batch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as batches with their orders, those without any too; finished members only carry sections."""
    batches = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return jobs.batch_members(batches, read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey").select("o_custkey", "o_orderkey", F.coalesce(F.col("o_orderstatus") == "F", F.lit(False)).alias("sections"))


def training_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders with a file that no training has used, and per customer whether they make a full retraining."""
    o = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), (o % 3 == 0).alias("used"), F.when(o % 4 > 0, "a.pdf").alias("file"))
    fresh = jobs.trainable(rows, "status", "used", "file").groupBy("o_custkey").agg(F.count("*").alias("fresh"))
    trained = rows.groupBy("o_custkey").agg(F.count_if("used").alias("trained"))
    return trained.join(fresh, "o_custkey", "left").select("o_custkey", "trained", F.coalesce("fresh", F.lit(0)).alias("fresh"), jobs.needs_full_retrain(F.col("trained"), F.coalesce("fresh", F.lit(0)), 5).alias("full"))


POOL_SQL = """
    SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS trained, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 4 > 0) AS fresh,
           count(*) FILTER (o_orderkey % 3 = 0) % 5 < count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 4 > 0) AS "full"
    FROM orders GROUP BY 1
"""


def version_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as model versions: the next one appended, the only active."""
    versions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("version"), (F.col("n_nationkey") == 3).alias("is_active"))
    return jobs.next_version(versions)


def new_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles inserted where a user has none."""
    have = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.lit("old").alias("state"))
    return jobs.insert_absent(have, read(spark, sf_dir, "customer").select("c_custkey", F.lit("new").alias("state")), "c_custkey")


def best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every conversation's turns the longest text, the first of equals."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return readers.longest_layout(turns, "conv_id", "text", "turn")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled words of documents by their lines, and the line of the report."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    labelled = F.size(F.filter(F.transform("lines", lambda x: F.length(x) % 4), lambda x: x != 0))
    return docs.select("doc_id", labelled.alias("labelled"), labeling.report_line(F.when(labelled >= 3, "OK").otherwise("SKIP"), F.concat("source", F.lit(".png")), F.size("lines"), labelled, F.array(*[F.lit(f"F{i}") for i in range(8)])).alias("line"))


COUNTS_SQL = """
    WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), e AS (SELECT *, len(list_filter(lines, lambda x: length(x) % 4 <> 0)) AS n FROM d)
    SELECT doc_id, CAST(n AS INTEGER) AS labelled, concat_ws('  ', CASE WHEN n >= 3 THEN 'OK' ELSE 'SKIP' END, source || '.png', len(lines) || ' words', n || ' labeled', 'F0,F1,F2,F3,F4,F5') AS line FROM e
"""


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a random split divides documents and two small sets: one training row at least, some of it for validation where nothing is left."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    count = lambda name, rows: labeling.random_split(rows, "doc_id", "split seed").groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("distinct_ids")).select(F.lit(name).alias("name"), "split", "n", "distinct_ids")
    return count("all", docs).union(count("one", docs.orderBy("doc_id").limit(1))).union(count("nine", docs.orderBy("doc_id").limit(9)))


SPLIT_SQL = """
    WITH s(name, n) AS (SELECT 'all', count(*) FROM documents UNION ALL SELECT 'one', 1 UNION ALL SELECT 'nine', 9), t AS (SELECT name, n, greatest(1, CAST(floor(n * 0.8) AS BIGINT)) AS k FROM s)
    SELECT name, 'train' AS split, k AS n, k AS distinct_ids FROM t UNION ALL SELECT name, 'val', CASE WHEN n > k THEN n - k ELSE greatest(1, k // 4) END, CASE WHEN n > k THEN n - k ELSE greatest(1, k // 4) END FROM t
"""


# ---- sources and sinks ----


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: text layer or recognised lines, page and image sizes, what is joined."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct(x.alias("text"), (F.pmod(i, F.lit(5)) / 8).alias("confidence")))
    seen = readers.confident_text(lines)
    size = F.col("doc_id") * 1000
    return read(spark, sf_dir, "documents").select(
        "doc_id", readers.has_text_layer(F.col("text")).alias("layer"), readers.needs_hard_preprocessing(size, F.lit(2)).alias("hard_page"), readers.needs_hard_preprocessing(size, F.lit(2), False).alias("hard_image"), readers.needs_fallback(seen).alias("fallback"),
        F.md5(seen.cast("binary")).alias("seen"), F.md5(readers.acquire_text(F.col("text"), F.array(seen, F.lit("p2"))).cast("binary")).alias("joined"),
    )


SOURCES_SQL = """
    WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), e AS (SELECT *, array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF (i - 1) % 5 > 2], chr(10)) AS seen FROM d)
    SELECT doc_id, coalesce(length(trim(text, ' ')) > 80, false) AS layer, doc_id * 2000 > 2000000 AS hard_page, doc_id * 2000 > 1500000 AS hard_image, length(trim(seen, ' ')) < 20 AS fallback, md5(seen) AS seen,
           md5(CASE WHEN coalesce(length(trim(text, ' ')) > 80, false) THEN text || chr(10) ELSE '' END || seen || chr(10) || 'p2') AS joined
    FROM e
"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages, their words with page and place."""
    word = lambda x: F.struct(x.alias("text"), F.lit(0.9).alias("confidence"))
    pages = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("ts"))
    words = pages.select("conv_id", F.transform("ts", lambda z: F.transform(F.split(z["t"], " ", -1), word)).alias("ws"))
    return readers.document_words(words, "conv_id", "ws").select("conv_id", "page", "pos", "text")


WORDS_SQL = """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS page, string_split(coalesce(text, ''), ' ') AS ws FROM conversations)
    SELECT conv_id, CAST(page AS INTEGER) AS page, CAST(i - 1 AS INTEGER) AS pos, ws[i] AS text FROM t, unnest(range(1, len(ws) + 1)) AS u(i)
"""


def upload_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of their source: suffix, size, and the first files of a batch; and all as one batch."""
    d = F.col("doc_id")
    files = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lpad(d.cast("string"), 9, "0"), _choose(F.pmod(d, F.lit(4)), ".PDF", ".exe", ".jpeg", ".tar.bmp")).alias("path"), (F.pmod(d, F.lit(5)) * 6 * 1024 * 1024).alias("length"))
    whole = readers.upload_gate(files).select("doc_id", F.col("gate").alias("alone"))
    return readers.upload_gate(files, batch="source").select("doc_id", "gate").join(whole, "doc_id")


GATES_SQL = f"""
    WITH f AS (SELECT doc_id, source, doc_id % 4 <> 1 AND doc_id % 5 * 6 * 1024 * 1024 <= {fixed.UPLOAD_BYTES} AS fine FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, fine ORDER BY doc_id) AS own, row_number() OVER (PARTITION BY fine ORDER BY doc_id) AS place FROM f)
    SELECT doc_id, CASE WHEN NOT fine THEN 'skipped' WHEN own > {fixed.UPLOAD_FILES} THEN 'over' ELSE 'accepted' END AS gate, CASE WHEN NOT fine THEN 'skipped' WHEN place > {fixed.UPLOAD_FILES} THEN 'over' ELSE 'accepted' END AS alone FROM r
"""


def stored_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a job table and read back in its declared schema; absent columns are null."""
    folder = microbatch.state_folder(spark, "jobs")
    read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("uploaded_by"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"), F.to_json(F.create_map(F.lit("TOTAL"), F.col("o_totalprice").cast("string"))).alias("extracted_data")).write.parquet(f"{folder}/invoice_job")
    got = readers.job_table(spark, folder, "invoice_job")
    return got.select("id", "uploaded_by", "status", S.get_item(S.decode_record(F.col("extracted_data")), "TOTAL").cast("double").alias("total"), F.col("batch_id").isNull().alias("alone"))


def stored_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples written as JSON by split and read back."""
    folder = microbatch.state_folder(spark, "samples")
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    samples = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), words.alias("words"), F.transform(words, lambda w: F.length(w) % 3).alias("labels"), F.when(F.col("turn") % 5 == 0, "val").otherwise("train").alias("split"))
    sinks.write_samples(samples, folder)
    return readers.training_samples(spark, folder, lists=False).select("id", F.array_join("words", " ").alias("text"), F.size(F.filter("labels", lambda x: x != 0)).alias("non_o"))


def stored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with labels written as label files of documents and read back; tabs and line feeds in a word become spaces."""
    folder = microbatch.state_folder(spark, "labels")
    turns = read(spark, sf_dir, "conversations")
    words = turns.select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("w\t"), "role", F.lit("\n"), F.col("turn").cast("string")).alias("word"), F.when(F.col("turn") % 2 == 0, "O").otherwise("B-HSN").alias("label"))
    sinks.write_labels(words, folder, "conv_id")
    return sinks.read_labels(spark, folder).select(F.col("doc").cast("long").alias("conv_id"), "word", "label")


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch workbooks of all nations' customers as cells: each the register with its totals, and a tab a file."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", F.concat("c_name", F.lit(".pdf")).alias("file"), F.col("c_name").alias("SUPPLIER"), F.col("c_acctbal").cast(D2).cast("string").alias("TOTAL"))
    return sinks.workbook_cells(validate.with_fields(rows), "file", "c_nationkey").select("c_nationkey", "sheet", "row", "name", "value").where("value <> ''")


CELLS_SQL = """
    WITH c AS (SELECT c_nationkey, c_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS total, CAST(c_acctbal AS DECIMAL(18,2)) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name || '.pdf') AS n FROM customer),
    s AS (SELECT c_nationkey, count(*) AS n, sum(t) AS t FROM c GROUP BY 1)
    SELECT c_nationkey, 'Batch Register' AS sheet, n::INTEGER AS "row", 'row_no' AS name, CAST(n AS VARCHAR) AS value FROM c UNION ALL SELECT c_nationkey, 'Batch Register', n, 'file', c_name || '.pdf' FROM c UNION ALL SELECT c_nationkey, 'Batch Register', n, 'SUPPLIER', c_name FROM c UNION ALL SELECT c_nationkey, 'Batch Register', n, 'TOTAL', total FROM c UNION ALL
    SELECT c_nationkey, 'Batch Register', n + 1, 'row_no', 'TOTALS (' || n || ' invoices)' FROM s UNION ALL SELECT c_nationkey, 'Batch Register', n + 1, f, CASE WHEN f = 'TOTAL' THEN format('{:,.2f}', t) ELSE '0.00' END FROM s, unnest(['TAXABLE', 'CGST', 'SGST', 'IGST', 'TOTAL_GST', 'TOTAL']) AS u(f) UNION ALL
    SELECT c_nationkey, c_name || '.pdf', 0, 'Supplier Name', c_name FROM c UNION ALL SELECT c_nationkey, c_name || '.pdf', 408, 'Net Payable (₹)', total FROM c
"""


def batch_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation of its customers' records, written on the executors and read back cell by cell."""
    folder = microbatch.state_folder(spark, "workbooks")
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("nation "), "c_nationkey").alias("batch"), F.concat("c_name", F.lit(".pdf")).alias("file"), F.col("c_name").alias("SUPPLIER"), F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("<"), "c_mktsegment", F.lit(" & co>"))).alias("RECIPIENT"), F.col("c_acctbal").cast(D2).cast("string").alias("TOTAL"))
    workbooks.write_books(workbooks.batch_books(validate.with_fields(rows), "file", "batch"), folder, placed=True)
    got = workbooks.read_books(spark, folder)
    return got.select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("batch"), "sheet_no", "sheet", "line", F.posexplode("cells").alias("col", "value")).where("value <> ''")


BOOKS_SQL = f"""
    WITH c AS (
        SELECT 'nation ' || c_nationkey AS batch, c_name, c_custkey, '<' || c_mktsegment || ' & co>' AS buyer, CAST(c_acctbal AS DECIMAL(18,2)) AS t, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name || '.pdf') AS n FROM customer
    ), h AS (SELECT i - 1 AS col, names[i] AS name FROM (SELECT ['row_no', 'file', {', '.join(f"'{f}'" for f in fixed.REGISTER)}] AS names), unnest(range(1, len(names) + 1)) AS u(i)),
    s AS (SELECT batch, count(*) AS n, sum(t) AS t FROM c GROUP BY batch), cells AS (
        SELECT batch, 1 AS sheet_no, 'Batch Register' AS sheet, 1 AS line, col, name AS value FROM s, h
        UNION ALL SELECT batch, 1, 'Batch Register', n + 1, col, CASE name WHEN 'row_no' THEN CAST(n AS VARCHAR) WHEN 'file' THEN c_name || '.pdf' WHEN 'SUPPLIER' THEN c_name WHEN 'RECIPIENT' THEN CASE WHEN c_custkey % 3 <> 0 THEN buyer END WHEN 'TOTAL' THEN CAST(t AS VARCHAR) END FROM c, h
        UNION ALL SELECT batch, 1, 'Batch Register', n + 2, col, CASE name WHEN 'row_no' THEN 'TOTALS (' || n || ' invoices)' WHEN 'TOTAL' THEN format('{{:,.2f}}', t) ELSE '0.00' END FROM s, h WHERE name IN ('row_no', {', '.join(f"'{f}'" for f in fixed.REGISTER_SUMS)})
        UNION ALL SELECT batch, n + 1, c_name, 1, i, ['Field', 'Value'][i + 1] FROM c, range(2) AS r(i)
        UNION ALL SELECT batch, n + 1, c_name, 2, i, ['Supplier Name', c_name][i + 1] FROM c, range(2) AS r(i)
        UNION ALL SELECT batch, n + 1, c_name, 3, i, ['Recipient Name', buyer][i + 1] FROM c, range(2) AS r(i) WHERE c_custkey % 3 <> 0
        UNION ALL SELECT batch, n + 1, c_name, CASE WHEN c_custkey % 3 <> 0 THEN 4 ELSE 3 END, i, ['Net Payable (₹)', CAST(t AS VARCHAR)][i + 1] FROM c, range(2) AS r(i)
    )
    SELECT batch, CAST(sheet_no AS INTEGER) AS sheet_no, sheet, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, value FROM cells WHERE value <> ''
"""


def cached_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of customers per nation, converted to its number of lines: even nations first, then odd ones and the even ones' files under other names, which cost no conversion."""
    folder = microbatch.state_folder(spark, "uploads")
    names = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("value"))
    even, odd = names.where("c_nationkey % 2 = 0"), names.where("c_nationkey % 2 = 1")
    put = lambda rows, name: rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(f"{folder}/in/{name}")
    cache = content.ContentCache(spark, f"{folder}/cache", "int")
    lines = lambda c: F.size(F.split(F.decode(c, "UTF-8"), "\n", -1)) - 1
    put(even, "first")
    cache.refresh(f"{folder}/in/*", lines)
    put(odd, "second")
    put(even, "renamed")
    cache.refresh(f"{folder}/in/*", lines)
    place = lambda n: F.regexp_extract("path", r"/in/([a-z]+)/c_nationkey=(\d+)/", n)
    return cache.current().where(F.endswith("path", F.lit(".txt"))).select(place(1).alias("upload"), place(2).cast("int").alias("nation"), F.col("result").alias("lines"), "reused")


# ---- joins by nearness, search ----


def band_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of all papers by a dictionary of all invoices' fields: amounts within half a unit, names by their words."""
    words = papers(spark, sf_dir).select(F.explode(F.split("raw_text", r"\s+")).alias("w"))
    truth = invoices(spark, sf_dir)
    fields = [("taxable", "B-TAXABLE"), ("cgst", "B-CGST"), ("sgst", "B-SGST"), ("igst", "B-IGST"), ("total", "B-TOTAL")]
    amounts = truth.select(F.inline(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(label).alias("label"), F.col(f).alias("amount")) for i, (f, label) in enumerate(fields)])))
    named = lambda c, n, kind: F.transform(F.split(c, " "), lambda w, i: F.struct((F.when(i == 0, n).otherwise(n + 1)).alias("priority"), F.when(i == 0, f"B-{kind}").otherwise(f"I-{kind}").alias("label"), w.alias("name")))
    names = truth.select(F.inline(F.concat(named("supplier", 0, "SUPPLIER"), named("recipient", 2, "RECIPIENT"))))
    return nearby.band_labels(words, "w", amounts, names)


BAND_SQL = f"""
    WITH {catalog.INVOICE_SQL}, {catalog.PAPER_WORDS_SQL},
    w AS (SELECT upper(w) AS word, count(*) AS n FROM numbered WHERE w <> '' GROUP BY 1),
    v AS (SELECT word, n, CASE WHEN regexp_matches(replace(word, ',', ''), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(replace(word, ',', '') AS DECIMAL(28,6)) END AS x FROM w),
    f AS (SELECT 0 AS p, taxable AS y FROM invoice UNION ALL SELECT 1, half FROM invoice UNION ALL SELECT 2, half FROM invoice UNION ALL SELECT 3, igst FROM invoice UNION ALL SELECT 4, total FROM invoice),
    g AS (SELECT CAST(round(y, 2) AS DECIMAL(28,6)) AS y, min(p) AS p, count(*) AS k FROM f WHERE y IS NOT NULL GROUP BY 1),
    b AS (SELECT v.word, min(p) AS p, sum(k) AS k FROM v JOIN g ON g.y BETWEEN v.x - 0.499999 AND v.x + 0.499999 GROUP BY 1),
    t AS (SELECT upper(s[i]) AS word, min(CASE WHEN i = 1 THEN q ELSE q + 1 END) AS q FROM (SELECT 0 AS q, string_split(supplier, ' ') AS s FROM invoice UNION ALL SELECT 2, string_split(recipient, ' ') FROM invoice), unnest(range(1, len(s) + 1)) AS u(i) WHERE length(s[i]) > 3 GROUP BY 1)
    SELECT v.word, v.n, CASE WHEN b.p IS NOT NULL THEN ['B-TAXABLE', 'B-CGST', 'B-SGST', 'B-IGST', 'B-TOTAL'][b.p + 1] WHEN t.q IS NOT NULL THEN ['B-SUPPLIER', 'I-SUPPLIER', 'B-RECIPIENT', 'I-RECIPIENT'][t.q + 1] ELSE 'O' END AS label, CAST(coalesce(b.k, 0) AS BIGINT) AS n_amounts
    FROM v LEFT JOIN b USING (word) LEFT JOIN t USING (word)
"""


def nearest_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in capitals' case of every document with the sentence mark before and behind it, and the nearer one; -1 without one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    points = docs.select("doc_id", F.explode(match_starts(F.col("text"), "[A-Z][a-z]+", EXACT)).alias("at"))
    # a mark comes with its place: no copy of the text goes with each
    marks = docs.select("doc_id", F.inline(match_places(F.col("text"), "[.!?]", EXACT)).alias("at", "mark"))
    got = nearby.nearest_anchors(points, marks, "doc_id", "at", "mark")
    near = nearby.nearer(F.col("at"), F.col("before"), F.col("after"))
    return got.select("doc_id", F.col("at").cast("long").alias("place"), *[F.coalesce(c, F.lit(-1)).alias(n) for n, c in (("before_at", F.col("before.at")), ("after_at", F.col("after.at")), ("near_at", near["at"]))], F.col("before.mark").alias("before_mark"), F.col("after.mark").alias("after_mark"))


MARKS_SQL = """
    WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents WHERE text IS NOT NULL),
    e AS (SELECT doc_id, i - 1 AS place, c[i] AS ch, c[i + 1] AS nx FROM d, unnest(range(1, len(c) + 1)) AS u(i)),
    p AS (SELECT doc_id, place FROM e WHERE ch BETWEEN 'A' AND 'Z' AND nx BETWEEN 'a' AND 'z'), m AS (SELECT doc_id, place, ch FROM e WHERE ch IN ('.', '!', '?')),
    b AS (SELECT p.doc_id, p.place, m.place AS before_at, m.ch AS before_mark FROM p ASOF LEFT JOIN m ON p.doc_id = m.doc_id AND p.place >= m.place),
    a AS (SELECT b.*, m.place AS after_at, m.ch AS after_mark FROM b ASOF LEFT JOIN m ON b.doc_id = m.doc_id AND b.place <= m.place)
    SELECT doc_id, place, coalesce(before_at, -1) AS before_at, before_mark, coalesce(after_at, -1) AS after_at, after_mark, coalesce(CASE WHEN before_at IS NULL OR after_at - place < place - before_at THEN after_at ELSE before_at END, -1) AS near_at FROM a
"""


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of customers' names, searched for the ends of all suppliers' keys, for short patterns and for such that no name has."""
    index = search.NameIndex(spark, microbatch.state_folder(spark, "names")).build(read(spark, sf_dir, "customer"), "c_name")
    k = F.col("s_suppkey").cast("string")
    patterns = read(spark, sf_dir, "supplier").select(_choose(F.col("s_suppkey") % 4, F.concat(F.lit("0"), k), F.concat(F.lit("R#0000"), F.lpad(k, 5, "0")), F.concat(F.lit("x"), k), F.substring(k, 1, 2)).alias("pattern"))
    return index.find_all(patterns, "pattern").groupBy("pattern").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


SEARCH_SQL = """
    WITH p AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN '0' || s_suppkey WHEN 1 THEN 'R#0000' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') WHEN 2 THEN 'x' || s_suppkey ELSE substr(CAST(s_suppkey AS VARCHAR), 1, 2) END AS pattern FROM supplier),
    c AS (SELECT DISTINCT lower(c_name) AS name FROM customer)
    SELECT pattern, count(*) AS n, min(name) AS first, max(name) AS last FROM p JOIN c ON contains(name, lower(pattern)) GROUP BY 1
"""


# ---- training as a stream ----


def training_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases arriving in three portions at the training job: fakes go, what is too little waits, the rest trains a version."""
    events = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    arrivals = events.select(F.col("event_id").cast("long").alias("id"), (F.col("event_id") % 7 == 0).alias("fake"), F.when(F.col("event_id") < 40, 0).when(F.col("event_id") < 60, 1).otherwise(2).alias("portion"))
    return microbatch.training_job(spark, arrivals, "portion", 3, least=5)


ROUNDS_SQL = """
    WITH e AS (SELECT event_id, event_id % 7 = 0 AS fake, CASE WHEN event_id < 40 THEN 0 WHEN event_id < 60 THEN 1 ELSE 2 END AS portion FROM events WHERE event_type = 'purchase'),
    n AS (SELECT p AS round, count(event_id) FILTER (NOT fake) AS came, count(event_id) FILTER (fake) AS fakes FROM range(3) AS t(p) LEFT JOIN e ON portion = p GROUP BY 1),
    a AS (SELECT max(came) FILTER (round = 0) AS r0, max(came) FILTER (round = 1) AS r1, max(came) FILTER (round = 2) AS r2 FROM n),
    b AS (SELECT *, CASE WHEN r0 >= 5 THEN 0 ELSE r0 END AS w0 FROM a), c AS (SELECT *, CASE WHEN w0 + r1 >= 5 THEN 0 ELSE w0 + r1 END AS w1 FROM b),
    g AS (SELECT 0 AS round, r0 AS offered FROM c UNION ALL SELECT 1, w0 + r1 FROM c UNION ALL SELECT 2, w1 + r2 FROM c)
    SELECT g.round, n.fakes, g.offered, g.offered >= 5 AS taken, CASE WHEN g.offered >= 5 THEN count(*) FILTER (g.offered >= 5) OVER (ORDER BY g.round) END AS version FROM g JOIN n USING (round)
"""


def sample_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' samples in a store that is changed as a whole: those of even customers, then anew and added those of every third, as two publications."""
    store = versioned.VersionedTable(spark, microbatch.state_folder(spark, "samples"), "id long, value double, publication int")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_custkey").alias("c"))
    for n, every in ((1, 2), (2, 3)):
        new = rows.where(F.col("c") % every == 0).select("id", "value", F.lit(n).alias("publication"))
        store.update(lambda held, new=new: jobs.upsert(held, new, "id"))
    return store.read()


def older_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with rates of every form and a description through the older rules and their record pass."""
    k, rate = F.col("o_orderkey"), F.element_at(F.array(*[F.lit(r) for r in ("5", "12", "18", "28")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shown = (
        F.when(k % 6 == 0, line("CGST @ ", rate, "%\nSGST @ ", rate, "%")).when(k % 6 == 1, line("IGST Rate: ", rate, "%")).when(k % 6 == 2, line("Tax %: ", rate))
        .when(k % 6 == 3, line(rate, "% GST")).when(k % 6 == 4, line("@", rate, "%")).otherwise(line("Central Tax Rate ", rate, "%\nState Tax Rate ", rate, "%"))
    )
    name = F.translate(k.cast("string"), *LETTERS)
    goods = F.when(k % 7 == 0, line("certified goods ", name)).otherwise(line("Steel parts ", name))
    papers = spread(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.concat_ws("\n", line("Description of Goods: ", goods), shown).alias("raw_text"))
    got = extract_v1.post_process(extract_v1.master_extract(papers))
    return got.select("o_orderkey", "CGST_RATE", "SGST_RATE", "IGST_RATE", "GST_RATE", "ITEM_DESC")


#: A sample of each noise rule in the rules' order, and what all rules make of it.
NOISE_SAMPLES = [
    ("27C0RPP3939N1ZQ", "27CORPP3939N1ZQ"),
    ("32AABBA789081ZB", "32AABBA7890B1ZB"),
    (": 2QAAFFC1234K1Z5", ": 29AAFFC1234K1Z5"),
    ("!TBG/18-19/330411TP/1328", "ITBG/18-19/3304/TP/1328"),
    ("|T8G/77", "ITBG/77"),
    ("3304ATP/1328", "3304/TP/1328"),
    ("ITBG/18-19/3304\nTP/1328", "ITBG/18-19/3304/TP/TP/1328"),
    ("!TBG/18-19/55", "ITBG/18-19/55"),
    ("ITBG/18-19/55 I", "ITBG/18-19/55"),
    ("31/0a/2018", "31/08/2018"),
    ("31J082018", "31/08/2018"),
    ("31/082018", "31/08/2018"),
    ("23-Ju-2025", "23-Jul-2025"),
    ("23-Ja-2025", "23-Jan-2025"),
    ("23-Fe-2025", "23-Feb-2025"),
    ("23-Ma-2025", "23-Mar-2025"),
    ("23-Ap-2025", "23-Apr-2025"),
    ("23-Au-2025", "23-Aug-2025"),
    ("23-Se-2025", "23-Sep-2025"),
    ("23-Oc-2025", "23-Oct-2025"),
    ("23-No-2025", "23-Nov-2025"),
    ("23-De-2025", "23-Dec-2025"),
    ("ICICOQ123", "ICIC0000123"),
    ("ICICO123456", "ICIC0123456"),
    ("ICICO45F", "ICIC045F"),
    ("IClCl", "ICICI"),
    ("IClC0X", "ICIC0X"),
    ("IClC5", "ICIC5"),
    ("Account Number ; 5", "Account Number: 5"),
    ("A/e No. 5", "A/c No. 5"),
    ("€ 500", "500"),
    ("4496,17", "4496.17"),
    ("AA8CK1234F", "AABCK1234F"),
    ("KERALA x in words : DEVELOPMENT y", "KERALA x  DEVELOPMENT y"),
    ("x %6", "x 6%"),
    ("lnvoice", "Invoice"),
    ("Involce", "Invoice"),
    ("a!BC", "aIBC"),
    ("flet", "Net"),
    ("NlNETY", "NINETY"),
    ("27AAFCV2449G127", "27AAFCV2449G1Z7"),
]


def noise_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's number behind a sample of one noise rule, one company's rules included."""
    c = F.col("c_custkey")
    samples = F.array(*[F.lit(text) for text, _ in NOISE_SAMPLES])
    noisy = F.concat(F.get(samples, (c % len(NOISE_SAMPLES)).cast("int")), F.lit(" #"), c.cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", S.fix_noise(noisy, tenant=True).alias("fixed"))


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with any number of scored fields filled: what was found, the score and its bands by both versions' bounds."""
    filled = F.col("o_orderkey") % (len(fixed.SCORED) + 1)
    fields = [F.when(filled > i, "x").otherwise(F.lit("" if i % 2 else None)).alias(f) for i, f in enumerate(fixed.SCORED)]
    got = register.score_record(read(spark, sf_dir, "orders").select("o_orderkey", *fields), "o_orderkey")
    return got.withColumn("older_band", register.score_band(F.col("score"), older=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        freight.freight_fields, freight.freight_records, freight.freight_records_v1, repaired_identities, gstin_checks, older_dates, date_difference, place_checks, tidied_values, block_lists, excluded_amounts, entity_checks, boxes, model_output, name_swap, gstin_lists, name_repairs, tax_repairs,
        invoice_sections, any_value, job_pages, batch_pages, training_pool, version_registry, new_profiles, best_of, label_counts, random_split, text_sources, document_words, upload_gates, stored_jobs, stored_samples, stored_labels, sheet_cells, batch_workbooks, cached_conversion, band_labels, nearest_marks, name_search, training_rounds, noise_rules, score_bands, sample_store, older_rates,
    )
}

_STATES = "(VALUES " + ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}', '{fixed.STATES_FOR_TAX[k]}')" for k, v in fixed.STATES.items()) + ") AS st(code, state, tax)"
ORACLE: dict[str, str] = freight.oracle(catalog.SAY_SQL, fixed.UNITS, fixed.TENS) | {
    "repaired_identities": IDENTITIES_SQL,
    "gstin_checks": f"WITH c AS (SELECT c_custkey, c_custkey % 6 AS n FROM customer), d AS (SELECT *, CASE WHEN n < 4 THEN '29' WHEN n = 4 THEN '07' END AS code FROM c) SELECT c_custkey, n IN (0, 1, 4) AS relaxed, n IN (0, 4) AS strict, d.code, st.state, st.tax AS for_tax FROM d LEFT JOIN {_STATES} ON st.code = d.code",
    "older_dates": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN CASE WHEN year(d) - 20 >= 2000 THEN '1 of ' || (year(d) - 20) END WHEN 4 THEN 'soon' ELSE strftime(d, '%d/%m/%Y') END AS date FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS d FROM orders)",
    "date_difference": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(d + 5, '%d/%m/%Y') WHEN 2 THEN strftime(d + 6, '%d-%b-%Y') ELSE strftime(d, '%d/%m/%Y') END AS \"INV_DATE\" FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS d FROM orders)",
    "place_checks": "SELECT c_custkey, ['Karnataka', 'karna', NULL, NULL, NULL, 'South Goa Beach', NULL][c_custkey % 7 + 1] AS \"PLACE\", [true, true, false, true, false, true, false][c_custkey % 7 + 1] AS known FROM customer",
    "tidied_values": TIDIED_SQL,
    "block_lists": BLOCK_SQL,
    "excluded_amounts": "SELECT o_orderkey, [NULL, NULL, NULL, NULL, NULL, o_orderkey + 0.5, NULL][o_orderkey % 7 + 1]::DOUBLE AS clean, [2019, NULL, 0, -5, NULL, o_orderkey + 0.5, 330411][o_orderkey % 7 + 1]::DOUBLE AS \"any\", [NULL, NULL, NULL, NULL, NULL, o_orderkey + 0.5, 330411][o_orderkey % 7 + 1]::DOUBLE AS older, [2019, NULL, 0, -5, NULL, o_orderkey + 0.5, 330411][o_orderkey % 7 + 1]::DOUBLE AS loose, o_orderkey % 7 = 5 AND o_orderkey = 5 AS near FROM orders",
    "entity_checks": ENTITY_SQL,
    "boxes": BOX_SQL,
    "model_output": MODEL_SQL,
    "name_swap": SWAP_SQL,
    "gstin_lists": "SELECT c_custkey, '29BBBBB' || x || ',29AAAAA' || x || CASE WHEN c_custkey % 2 = 0 THEN ',29UUUUU' || x ELSE '' END AS gstins FROM (SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || 'A1Z5' AS x FROM customer)",
    "name_repairs": NAMES_SQL,
    "tax_repairs": TAX_SQL,
    "invoice_sections": SECTION_SQL,
    "any_value": "SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS has, CAST((CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 5 ELSE 0 END) * o_custkey AS DOUBLE) AS tax, 1 AS sl_no, CAST(o_orderkey AS VARCHAR) AS description, '7' AS qty FROM orders",
    "job_pages": PAGES_SQL,
    "batch_pages": "SELECT c_custkey AS o_custkey, o_orderkey, coalesce(o_orderstatus = 'F', false) AS sections FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "training_pool": POOL_SQL,
    "version_registry": "SELECT CAST(n_nationkey AS INTEGER) AS version, false AS is_active FROM nation UNION ALL SELECT CAST(max(n_nationkey) + 1 AS INTEGER), true FROM nation",
    "new_profiles": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM customer",
    "best_of": "SELECT conv_id, coalesce(text, '') AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(trim(coalesce(text, ''), ' ')) DESC, turn) = 1",
    "label_counts": COUNTS_SQL,
    "random_split": SPLIT_SQL,
    "text_sources": SOURCES_SQL,
    "document_words": WORDS_SQL,
    "upload_gates": GATES_SQL,
    "stored_jobs": "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS uploaded_by, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS status, CAST(o_totalprice AS DOUBLE) AS total, true AS alone FROM orders",
    "stored_samples": "SELECT conv_id || '-' || turn AS id, coalesce(text, '') AS text, CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) % 3 <> 0)) AS INTEGER) AS non_o FROM conversations",
    "stored_labels": "SELECT CAST(conv_id AS BIGINT) AS conv_id, 'w ' || role || ' ' || turn AS word, CASE WHEN turn % 2 = 0 THEN 'O' ELSE 'B-HSN' END AS label FROM conversations",
    "sheet_cells": CELLS_SQL,
    "batch_workbooks": BOOKS_SQL,
    "cached_conversion": "WITH c AS (SELECT c_nationkey AS nation, CAST(count(*) AS INTEGER) AS lines FROM customer GROUP BY 1) SELECT CASE WHEN nation % 2 = 0 THEN 'first' ELSE 'second' END AS upload, nation, lines, false AS reused FROM c UNION ALL SELECT 'renamed', nation, lines, true FROM c WHERE nation % 2 = 0",
    "band_labels": BAND_SQL,
    "nearest_marks": MARKS_SQL,
    "name_search": SEARCH_SQL,
    "training_rounds": ROUNDS_SQL,
    "sample_store": "SELECT o_orderkey AS id, o_totalprice AS value, CASE WHEN o_custkey % 3 = 0 THEN 2 ELSE 1 END AS publication FROM orders WHERE o_custkey % 2 = 0 OR o_custkey % 3 = 0",
    # without a rate of its own the whole is IGST's or both halves' sum; half a whole rate is rounded to the even number
    "older_rates": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 6 AS form, [5, 12, 18, 28][o_orderkey % 4 + 1] AS rate, [2, 6, 9, 14][o_orderkey % 4 + 1] AS half FROM orders)
        SELECT k AS o_orderkey, CASE WHEN form IN (0, 5) THEN rate || '%' WHEN form BETWEEN 1 AND 4 THEN half || '%' END AS "CGST_RATE", CASE WHEN form IN (0, 5) THEN rate || '%' WHEN form BETWEEN 1 AND 4 THEN half || '%' END AS "SGST_RATE",
               CASE WHEN form = 1 THEN rate || '%' END AS "IGST_RATE", CASE WHEN form = 5 THEN 2 * rate ELSE rate END || '%' AS "GST_RATE", CASE WHEN k % 7 <> 0 THEN 'Steel parts ' || translate(CAST(k AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS "ITEM_DESC"
        FROM r""",
    "noise_rules": f"SELECT c_custkey, [{', '.join(chr(39) + fixed_text + chr(39) for _, fixed_text in NOISE_SAMPLES)}][c_custkey % {len(NOISE_SAMPLES)} + 1] || ' #' || c_custkey AS fixed FROM customer",
    "score_bands": f"""SELECT o_orderkey, CAST(k AS INTEGER) AS found, CAST(k * 100 // {len(fixed.SCORED)} AS INTEGER) AS score, CASE WHEN k * 100 // {len(fixed.SCORED)} >= 75 THEN 'good' WHEN k * 100 // {len(fixed.SCORED)} >= 50 THEN 'fair' ELSE 'poor' END AS band,
        CASE WHEN k * 100 // {len(fixed.SCORED)} >= 80 THEN 'good' WHEN k * 100 // {len(fixed.SCORED)} >= 60 THEN 'fair' ELSE 'poor' END AS older_band FROM (SELECT o_orderkey, o_orderkey % {len(fixed.SCORED) + 1} AS k FROM orders)""",
}

"""Registered queries of the library, and DuckDB SQL for each that SQL can express.

Extraction queries run on invoices rendered from the order tables; their SQL never looks at a text but
computes from the structured columns what extraction has to give back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import find_all, strip_lead
from ..operators import extract, jobs, labeling, merge, register, validate
from ..streaming import microbatch
from . import render
from .render import read

KEY = ["l_orderkey", "l_suppkey"]
D2 = "decimal(18,2)"

# ---- shared SQL ----

STATE_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fixed.STATES.items()) + ") AS st(code, state)"
DIGITS = "translate(CAST({} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


def _gstin_sql(nation: str, key: str) -> str:
    digits = f"lpad(CAST({key} AS VARCHAR), 9, '0')"
    return f"lpad(CAST({nation} + 1 AS VARCHAR), 2, '0') || translate(substr({digits}, 1, 5), '0123456789', 'ABCDEFGHIJ') || substr({digits}, 6, 4) || 'K1Z5'"


LINES_SQL = """
    SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_quantity AS INTEGER) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS rate,
           CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS taxable,
           lpad(CAST(3000 + (l_partkey * 7) % 6000 AS VARCHAR), 4, '0') AS hsn,
           row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS sl_no
    FROM lineitem
"""
INVOICE_SQL = f"""
    lines AS ({LINES_SQL}),
    grouped AS (
        SELECT l_orderkey, l_suppkey, CAST(sum(taxable) AS DECIMAL(18,2)) AS taxable, sum(qty) AS qty,
               list({{'sl_no': sl_no, 'hsn': hsn, 'qty': qty, 'rate': rate, 'part': l_partkey}} ORDER BY sl_no) AS items,
               coalesce(first(rate ORDER BY sl_no) FILTER (qty = 1), first(rate ORDER BY sl_no)) AS shown_rate
        FROM lines GROUP BY 1, 2
    ),
    priced AS (
        SELECT g.*, o.o_custkey, s.s_nationkey, c.c_nationkey, CAST(o.o_orderdate + INTERVAL 120 MONTH AS DATE) AS inv_date,
               CASE l_suppkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 28 END AS gst_rate, s.s_nationkey <> c.c_nationkey AS is_inter
        FROM grouped g JOIN orders o ON o.o_orderkey = g.l_orderkey JOIN supplier s ON s.s_suppkey = g.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey
    ),
    taxed AS (
        -- exact rounding, half up, in whole hundredths
        SELECT *, CASE WHEN is_inter THEN CAST((CAST(taxable * 100 AS BIGINT) * gst_rate + 50) // 100 AS DECIMAL(18,2)) / 100 END AS igst,
               CASE WHEN NOT is_inter THEN CAST((CAST(taxable * 100 AS BIGINT) * gst_rate + 100) // 200 AS DECIMAL(18,2)) / 100 END AS half
        FROM priced
    ),
    invoice AS (
        SELECT *, coalesce(igst, half * 2) AS total_gst, taxable + coalesce(igst, half * 2) AS total,
               'INV/' || l_orderkey || '/' || l_suppkey AS inv_no, 'SUPPLIER ' || {DIGITS.format('l_suppkey')} || ' LIMITED' AS supplier, 'Trader ' || {DIGITS.format('o_custkey')} AS recipient,
               {_gstin_sql('s_nationkey', 'l_suppkey')} AS gstin_s, {_gstin_sql('c_nationkey', 'o_custkey + 500000')} AS gstin_r, st.state AS place
        FROM taxed JOIN {STATE_SQL} ON st.code = lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')
    )
"""


def _money_sql(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR)"


#: HSN codes an invoice keeps: the first three distinct, but none within 5 of the whole part of one of its amounts.
HSN_SQL = """
    codes AS (
        SELECT l_orderkey, l_suppkey, hsn, min(sl_no) AS first_sl FROM lines GROUP BY 1, 2, 3
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY first_sl) AS rn FROM codes
    ),
    kept AS (
        SELECT r.l_orderkey, r.l_suppkey, string_agg(r.hsn, ', ' ORDER BY r.rn) AS hsn
        FROM ranked r JOIN invoice i USING (l_orderkey, l_suppkey)
        WHERE r.rn <= 3 AND abs(CAST(r.hsn AS BIGINT) - floor(i.taxable)) >= 5 AND abs(CAST(r.hsn AS BIGINT) - floor(i.total)) >= 5 AND abs(CAST(r.hsn AS BIGINT) - floor(i.total_gst)) >= 5
          AND abs(CAST(r.hsn AS BIGINT) - floor(coalesce(i.half, i.igst))) >= 5 AND abs(CAST(r.hsn AS BIGINT) - floor(i.shown_rate)) >= 5
        GROUP BY 1, 2
    )
"""


def _records(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """Extracted and validated records of all rendered invoices."""
    return validate.post_process(extract.two_pass(render.papers(spark, sf_dir, noisy)))


def _truth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records straight from the structured invoices, for queries on records alone."""
    # plain columns: of a struct none can be left out once its fields are used more than once
    rows = render.render(render.invoices(spark, sf_dir))
    t = F.col
    text = lambda c: c.cast("string")
    half_rate = F.when(~t("is_inter"), S.show_rate((t("gst_rate") / 2).cast(D2)))
    codes = F.array_join(F.slice(F.array_distinct("codes"), 1, 3), ", ")
    given = rows.select(
        *KEY, t("items").alias("items"), "raw_text", t("supplier").alias("SUPPLIER"), t("gstin_s").alias("GSTIN_S"), t("recipient").alias("RECIPIENT"), t("gstin_r").alias("GSTIN_R"), t("place").alias("PLACE"), t("inv_no").alias("INV_NO"),
        F.date_format(t("inv_date"), "dd/MM/yyyy").alias("INV_DATE"), text(t("taxable")).alias("TAXABLE"), text(t("cgst")).alias("CGST"), text(t("sgst")).alias("SGST"), text(t("igst")).alias("IGST"), text(t("total_gst")).alias("TOTAL_GST"),
        text(t("total")).alias("TOTAL"), half_rate.alias("CGST_RATE"), half_rate.alias("SGST_RATE"), F.when(t("is_inter"), S.show_rate(t("gst_rate"))).alias("IGST_RATE"), S.show_rate(t("gst_rate")).alias("GST_RATE"), codes.alias("HSN"), text(t("qty")).alias("QTY"),
    )
    return validate.with_fields(given)


# ---- registers ----


def gst_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: render, repair, extract, validate, and the 21-column register numbered within each order."""
    got = register.batch_register(_records(spark, sf_dir), "INV_NO", ["l_suppkey"], "l_orderkey")
    return got.drop("file", "UOM", "BANK", "IFSC")


def gst_register_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.total_row(_records(spark, sf_dir, noisy=True)).select("invoices", *[F.col(f).cast("double").alias(f) for f in fixed.REGISTER_SUMS])


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = register.register_totals(_truth_records(spark, sf_dir), "l_suppkey")
    return got.select("l_suppkey", "invoices", *[F.col(f).cast("double").alias(f) for f in fixed.REGISTER_SUMS])


REGISTER_SQL = f"""
    WITH {INVOICE_SQL}, {HSN_SQL}
    SELECT i.l_orderkey, CAST(row_number() OVER (PARTITION BY i.l_orderkey ORDER BY i.l_suppkey) AS INTEGER) AS row_no, supplier AS "SUPPLIER", gstin_s AS "GSTIN_S", recipient AS "RECIPIENT", gstin_r AS "GSTIN_R", inv_no AS "INV_NO",
           strftime(inv_date, '%d/%m/%Y') AS "INV_DATE", place AS "PLACE", {_money_sql('taxable')} AS "TAXABLE", coalesce({_money_sql('half')}, '') AS "CGST", coalesce({_money_sql('half')}, '') AS "SGST",
           coalesce({_money_sql('igst')}, '') AS "IGST", {_money_sql('total_gst')} AS "TOTAL_GST", {_money_sql('total')} AS "TOTAL", coalesce(k.hsn, '') AS "HSN", CASE WHEN qty < 1000 THEN CAST(qty AS VARCHAR) ELSE '' END AS "QTY", {_money_sql('shown_rate')} AS "RATE"
    FROM invoice i LEFT JOIN kept k USING (l_orderkey, l_suppkey)
"""
SUMS_SQL = 'count(*) AS invoices, CAST(sum(taxable) AS DOUBLE) AS "TAXABLE", CAST(coalesce(sum(half), 0) AS DOUBLE) AS "CGST", CAST(coalesce(sum(half), 0) AS DOUBLE) AS "SGST", CAST(coalesce(sum(igst), 0) AS DOUBLE) AS "IGST", CAST(sum(total_gst) AS DOUBLE) AS "TOTAL_GST", CAST(sum(total) AS DOUBLE) AS "TOTAL"'

# ---- scalars ----


def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with currency signs, commas and brackets, read back."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast(D2).alias("price"))
    shown = F.concat(F.lit("₹ ("), F.format_number("price", 2), F.lit(")"))
    return rows.select("o_orderkey", S.clean_amount(shown).cast("double").alias("clean"), S.to_amount(F.format_number("price", 2)).cast("double").alias("plain"), S.parse_amount(F.concat(F.lit("Rs."), F.format_number("price", 2))).cast("double").alias("older"), S.show(F.col("price")).alias("shown"))


def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three written forms, normalised by both passes."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), 120).alias("d"))
    named = F.date_format("d", "dd - MMM - yy")
    return rows.select("o_orderkey", S.slash_date(named).alias("slash"), S.normal_date(named).alias("dashed"), S.normal_date(F.date_format("d", "ddMMyyyy")).alias("run"), S.slash_date(F.date_format("d", "dd/MM/yyyy")).alias("same"))


def gstin_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", render.gstin(F.col("c_nationkey"), F.col("c_custkey")).alias("gstin"))
    return rows.select("c_custkey", "gstin", S.is_gstin(F.col("gstin")).alias("relaxed"), S.is_gstin(F.col("gstin"), strict=True).alias("strict"), S.state_code(F.col("gstin")).alias("state_code"), F.substring("gstin", 3, 10).alias("pan"))


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.lpad((F.col("s_nationkey") * 2 + 1).cast("string"), 2, "0").alias("code"))
    return rows.select("s_suppkey", "code", S.state_name(F.col("code"), F.lit("printed")).alias("state"))


def number_to_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", S.number_to_words(F.col("o_totalprice").cast(D2)).alias("words"))


def words_to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rupees to words and back."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("n"))
    said = S.number_to_words(F.col("n").cast(D2))
    return rows.select("o_orderkey", S.words_to_number(F.regexp_replace(said, " Rupees.*", "")).alias("value"))


#: SQL: the words of a number {n} below 1000, by lists u and t.
SAY_SQL = "CASE WHEN {n} = 0 THEN '' WHEN {n} < 20 THEN u[{n} + 1] WHEN {n} < 100 THEN trim(t[{n} // 10 + 1] || ' ' || u[{n} % 10 + 1]) ELSE trim(u[{n} // 100 + 1] || ' Hundred ' || CASE WHEN {n} % 100 < 20 THEN u[{n} % 100 + 1] ELSE trim(t[{n} % 100 // 10 + 1] || ' ' || u[{n} % 10 + 1]) END) END"
WORDS_SQL = f"""
    WITH w AS (
        SELECT {fixed.UNITS} AS u, {fixed.TENS} AS t
    ), p AS (
        SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) // 100 AS r, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 100 AS paise FROM orders
    ), q AS (
        SELECT o_orderkey, paise, {SAY_SQL.format(n='(r // 10000000 % 1000)')} AS crore, {SAY_SQL.format(n='(r // 100000 % 100)')} AS lakh, {SAY_SQL.format(n='(r // 1000 % 100)')} AS thousand, {SAY_SQL.format(n='(r % 1000)')} AS rest, {SAY_SQL.format(n='paise')} AS small
        FROM p, w
    )
    SELECT o_orderkey, concat_ws(' ', nullif(crore, '') || ' Crore', nullif(lakh, '') || ' Lakh', nullif(thousand, '') || ' Thousand', nullif(rest, '')) || ' Rupees' || CASE WHEN paise > 0 THEN ' and ' || small || ' Paise' ELSE '' END || ' Only' AS words
    FROM q
"""

# ---- tax logic ----


def _tax_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with only parties, taxable value and total tax: the steps have to derive the rest."""
    rows = _truth_records(spark, sf_dir)
    return rows.select(*KEY, "GSTIN_S", "GSTIN_R", "PLACE", "TAXABLE", "TOTAL_GST")


def tax_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IGST or halves, and the total, from taxable value and total tax."""
    got = validate.post_process(_tax_inputs(spark, sf_dir), validate.TAX_STEPS)
    return got.select(*KEY, "CGST", "SGST", "IGST", "TOTAL_GST", "TOTAL")


def rate_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal rates from amounts."""
    got = validate.post_process(_tax_inputs(spark, sf_dir), validate.TAX_STEPS[:2])
    return got.select(*KEY, "GST_RATE", "CGST_RATE", "SGST_RATE", "IGST_RATE")


def tax_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong totals put right: every other invoice comes with a total tax and a total that are off."""
    rows = _truth_records(spark, sf_dir)
    off = F.col("l_orderkey") % 2 == 0
    wrong = rows.withColumns({"TOTAL_GST": F.when(off, S.show(S.to_amount(F.col("TOTAL_GST")) + 7)).otherwise(F.col("TOTAL_GST")), "TOTAL": F.when(off, S.show(S.to_amount(F.col("TOTAL")) * 2)).otherwise(F.col("TOTAL"))})
    got = validate.post_process(wrong, validate.TAX_STEPS)
    return got.select(*KEY, "TAXABLE", "CGST", "IGST", "TOTAL_GST", "TOTAL")


def tax_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _truth_records(spark, sf_dir)
    return register.tax_breakdown(rows, "INV_NO")


def detection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields found per invoice, as a whole percentage and band."""
    return register.score_record(_truth_records(spark, sf_dir), "INV_NO")


# ---- line items ----


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = register.invoice_details(_truth_records(spark, sf_dir), "INV_NO", "items")
    return got.select("INV_NO", "sl_no", "hsn", "qty", "rate")


def hsn_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = register.hsn_register(_truth_records(spark, sf_dir), "INV_NO")
    return got.select("INV_NO", F.col("sl").cast("int").alias("sl"), "hsn_code", "GST_RATE", "TAXABLE", "TOTAL")


def gst_register_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice's register with its tax totals and its total in words; orders of odd numbers have no words."""
    words = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("Rupees "), "TOTAL", F.lit(" Only")))
    got = register.gst_register_sheet(_truth_records(spark, sf_dir).withColumn("TOTAL_WORDS", words), "INV_NO")
    return got


def whole_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices in one register, a batch for each supplier, with the totals of batches and of all in it."""
    records = _truth_records(spark, sf_dir).select("l_suppkey", "INV_NO", *fixed.REGISTER_SUMS)
    got = register.whole_register(records, "l_suppkey", "INV_NO")
    return got.select("line", "row_no", "level", "l_suppkey", "INV_NO", "invoices", *[F.col(f).cast("double").alias(f) for f in fixed.REGISTER_SUMS])


def numbered_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices numbered as one batch, the dearest first."""
    rows = _truth_records(spark, sf_dir).select("INV_NO", (-F.col("TOTAL").cast(D2)).alias("low"))
    return register.numbered(microbatch.kept(rows, "numbered"), ["low", "INV_NO"]).select("row_no", "INV_NO")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.raw_lines(read(spark, sf_dir, "documents"), "doc_id", "text")


def ordered_distinct_hsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as extraction sees them on paper: distinct, in order, the first three."""
    rows = render.papers(spark, sf_dir)
    codes = extract.hsn_codes(F.col("raw_text"), F.array().cast("array<string>"))
    return rows.select(*KEY, F.array_join(F.slice(codes, 1, 3), ", ").alias("hsn"))


# ---- extraction ----


def extract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the raw texts, before any validation."""
    got = extract.two_pass(render.papers(spark, sf_dir))
    return got.select(*KEY, "SUPPLIER", "RECIPIENT", "GSTIN_S", "GSTIN_R", "PAN", "PLACE", "INV_NO", "INV_DATE", "TAXABLE", "IGST", "CGST", "TOTAL_GST", "TOTAL", "BANK", "AC_NO", "IFSC", "STATE_CODE")


def noise_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread dates, months, words and numbers put right."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    noisy = F.concat(F.lit("lnvoice "), F.date_format("d", "dd'J'MMyyyy"), F.lit(" 23-Ju-2025 ICICO45F A/e No. 4496,17 "), F.date_format("d", "dd/MMyyyy"))
    return rows.select("o_orderkey", S.fix_noise(noisy).alias("fixed"))


def merge_first_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial records of each customer merged, and a model's record laid over."""
    c = read(spark, sf_dir, "customer")
    a = F.create_map(F.lit("SUPPLIER"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lit("")), F.lit("QTY"), F.col("c_nationkey").cast("string"))
    b = F.create_map(F.lit("SUPPLIER"), F.lit("fallback"), F.lit("UOM"), F.col("c_mktsegment"))
    merged = merge.first_non_empty(a, b)
    over = merge.override(merged, F.create_map(F.lit("SUPPLIER"), F.when(F.col("c_custkey") % 3 == 0, F.lit("model name")).otherwise(F.lit("abc")), F.lit("QTY"), F.lit("9"), F.lit("RATE"), F.lit("5")))
    return c.select("c_custkey", F.element_at(merged, "SUPPLIER").alias("first"), F.element_at(merged, "UOM").alias("uom"), F.element_at(over, "SUPPLIER").alias("supplier"), F.element_at(over, "QTY").alias("qty"), F.element_at(over, "RATE").alias("rate"), register.field_count(over).alias("fields"))


def context_gstin_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and recipient by the words before each GSTIN."""
    from ..operators import extract_v1

    rows = render.papers(spark, sf_dir)
    roles = extract_v1.gstin_roles(F.col("raw_text"))
    return rows.select(*KEY, roles.alias("r")).select(*KEY, F.col("r.supplier").alias("supplier"), F.col("r.recipient").alias("recipient"))


def extract_fields_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rules end to end: extraction, record pass and line items."""
    from ..operators import extract_v1

    got = extract_v1.post_process(extract_v1.master_extract(render.papers(spark, sf_dir)))
    return got.select(*KEY, "GSTIN_S", "GSTIN_R", "INV_NO", "INV_DATE", "TAXABLE", "TOTAL_GST", "TOTAL", F.size("LINE_ITEMS").alias("n_items"))


# ---- jobs (orders are batches, lineitem are jobs) ----


def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jobs.recent(read(spark, sf_dir, "orders"), 8, "o_orderdate", "o_orderkey", "o_custkey", 7)
    return got.select("o_orderkey", "o_custkey", "o_orderdate")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jobs.history(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", "UR", "o_orderstatus", "F")
    return got.select("o_orderkey", "o_orderstatus", "o_orderpriority")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest_per(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = read(spark, sf_dir, "orders").select("o_orderkey")
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return jobs.batch_progress(batches, items, "o_orderkey", F.col("l_linestatus") == "F")


def owned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their profile and jobs, those without jobs kept; one document of one user deleted."""
    orders = jobs.without(read(spark, sf_dir, "orders"), "o_orderkey", 1, "o_custkey", 1)
    users = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return jobs.navigate(users, orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("jobs"), F.max("o_orderkey").alias("newest"))


# ---- labelling ----


def weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each invoice get each label."""
    got = labeling.weak_labels(_truth_records(spark, sf_dir), KEY, "raw_text")
    return got.groupBy(*KEY, "label").agg(F.count("*").alias("n"))


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
_WORD = "upper(w)"
_NEAR = "abs({} - n) < 0.5"
#: Every word of every invoice's paper (CTE numbered), and its label by the invoice's structured values.
PAPER_WORDS_SQL = f"""
    parts AS (
        SELECT i.*, substr(gstin_s, 3, 10) AS pan, strftime(inv_date, '%d/%m/%Y') AS day, list_transform(items, lambda x: x.hsn) AS codes,
               list_concat(
                   ['TAX', 'INVOICE', 'For'], string_split(supplier, ' '), ['GSTIN/UIN:', gstin_s, 'PAN:', substr(gstin_s, 3, 10), 'Invoice', 'No:', inv_no, 'Invoice', 'Date:', strftime(inv_date, '%d/%m/%Y'), 'Buyer', '(Bill', 'to)'], string_split(recipient, ' '),
                   ['GSTIN/UIN:', gstin_r, 'Place', 'of', 'Supply'], string_split(place, ' '), ['(' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') || ')'],
                   flatten(list_transform(items, lambda x: [CAST(x.sl_no AS VARCHAR), 'Part', {DIGITS.format('x.part')}, x.hsn, CAST(x.qty AS VARCHAR), 'Nos', CAST(x.rate AS VARCHAR)])), flatten(list_transform(items, lambda x: ['HSN/SAC:', x.hsn])),
                   ['Total', CAST(qty AS VARCHAR), 'NOS', 'Rate:', CAST(items[1].rate AS VARCHAR), 'Taxable', 'Value:', {_money_sql('taxable')}],
                   CASE WHEN is_inter THEN ['IGST', gst_rate || '%', 'IGST', 'Amount:', {_money_sql('igst')}] ELSE ['CGST', (gst_rate // 2) || '%', 'SGST', (gst_rate // 2) || '%', 'CGST', 'Amount:', {_money_sql('half')}, 'SGST', 'Amount:', {_money_sql('half')}] END,
                   ['Total', 'GST:', {_money_sql('total_gst')}, 'Grand', 'Total:', {_money_sql('total')}, 'Bank:', 'STATE', 'BANK', 'A/c', 'No:', '1234567890', 'IFSC:', 'SBIN0001234']
               ) AS words
        FROM invoice i
    ),
    distinct_codes AS (
        SELECT *, array_to_string(list_filter(codes, lambda x, j: list_position(codes, x) = j)[1:3], ', ') AS hsn FROM parts
    ),
    each AS (
        SELECT *, unnest(words) AS w FROM distinct_codes
    ),
    numbered AS (
        SELECT *, CASE WHEN regexp_matches(replace(w, ',', ''), '{_NUMBER}') THEN CAST(replace(w, ',', '') AS DOUBLE) END AS n FROM each
    )
"""
LABELS_SQL = f"""
    {PAPER_WORDS_SQL}
    SELECT l_orderkey, l_suppkey, CASE
               WHEN regexp_matches(w, '(?i)^{fixed.GSTIN_STRICT}') THEN CASE WHEN {_WORD} = gstin_r AND {_WORD} <> gstin_s THEN 'B-GSTIN_R' ELSE 'B-GSTIN_S' END
               WHEN contains(upper(inv_no), {_WORD}) THEN 'B-INV_NO'
               WHEN regexp_matches(w, '^[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}') AND (contains(day, w) OR contains(w, day)) THEN 'B-INV_DATE'
               WHEN regexp_matches(w, '^[0-9]{{4,6}}$') AND (w IN ({', '.join(repr(x) for x in fixed.VALID_HSN)}) OR contains(hsn, w)) THEN 'B-HSN'
               WHEN {_NEAR.format('taxable')} THEN 'B-TAXABLE' WHEN {_NEAR.format('half')} THEN 'B-CGST' WHEN {_NEAR.format('igst')} THEN 'B-IGST' WHEN {_NEAR.format('total')} THEN 'B-TOTAL'
               WHEN regexp_matches(w, '^(5|9|12|14|18|28)%?$') THEN 'B-CGST_RATE'
               WHEN length(w) > 3 AND list_contains(string_split(upper(supplier), ' '), {_WORD}) THEN CASE WHEN {_WORD} = string_split(upper(supplier), ' ')[1] THEN 'B-SUPPLIER' ELSE 'I-SUPPLIER' END
               WHEN length(w) > 3 AND list_contains(string_split(upper(recipient), ' '), {_WORD}) THEN CASE WHEN {_WORD} = string_split(upper(recipient), ' ')[1] THEN 'B-RECIPIENT' ELSE 'I-RECIPIENT' END
               ELSE 'O' END AS label, count(*) AS n
    FROM numbered GROUP BY 1, 2, 3
"""


def fake_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    raw = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, F.lit(" SAMPLE  INVOICE Insert   Logo")).otherwise(F.lit("")))
    return docs.select("doc_id", labeling.is_fake(raw, F.when(F.col("doc_id") % 11 == 0, F.lit("29AAAAA0000A1Z5")).otherwise(F.lit("29ABCDE1234F1Z5")), (F.col("doc_id") % 9).cast("int")).alias("fake"))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples with one label id per line: those with at least three that aren't O."""
    docs = read(spark, sf_dir, "documents")
    labels = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(x) % 4)
    return docs.select("doc_id", labeling.good_sample(labels).alias("good"))


def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as labelled tokens, grouped to entities."""
    turns = read(spark, sf_dir, "conversations")
    label = F.when(F.col("turn") % 4 == 0, F.lit("B-TOTAL")).when(F.col("turn") % 4 == 1, F.lit("I-TOTAL")).when(F.col("turn") % 4 == 2, F.lit("B-HSN")).otherwise(F.lit("O"))
    tokens = turns.select("conv_id", F.col("turn").alias("pos"), F.concat(F.col("role"), F.lit("_"), F.col("turn").cast("string")).alias("token"), label.alias("label"))
    return merge.bio_entities(tokens, "conv_id")


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 7, -100).otherwise(F.col("l_partkey") % 5).cast("int").alias("truth"), (F.col("l_suppkey") % 5).cast("int").alias("guess"))
    return labeling.macro_f1(pairs, "truth", "guess").select(F.round("macro_f1", 6).alias("macro_f1"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 80 % of every source's documents train."""
    docs = read(spark, sf_dir, "documents")
    by = W.partitionBy("source")
    return docs.select("doc_id", "source", labeling.split_by_rank(F.row_number().over(by.orderBy("doc_id")), F.count("*").over(by)).alias("split"))


def upsert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("state"))
    new = read(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("state")).distinct()
    return jobs.upsert(docs, new, "doc_id")


# ---- text ----


def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment-address-shaped tokens of documents."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(find_all(F.col("text"), r"\b([A-Za-z0-9._\-]{3,30}@[A-Za-z0-9]{2,20})\b", flags=""), " ").alias("tokens")).where("tokens <> ''")


def hex_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(find_all(F.col("text"), "([a-f0-9]{30,})", flags=""), " ").alias("runs")).where("runs <> ''")


def doc_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_all(F.col("text"), r"([0-9][0-9,]*\.[0-9]{2})", flags="")
    return docs.select("doc_id", F.size(found).alias("n"), F.aggregate(found, F.lit(0).cast(D2), lambda a, x: (a + F.coalesce(S.to_amount(x), F.lit(0))).cast(D2)).cast("double").alias("total")).where("n > 0")


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of each document cut into word boxes, on pages of thousandths with 46 lines each."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))
    top = F.lit(40) + 20 * F.pmod("line_no", F.lit(46))
    boxes = labeling.word_boxes(F.col("line"), F.lit(100), top, F.lit(900), top + 20)
    words = lines.select("doc_id", F.floor(F.col("line_no") / 46).cast("int").alias("page"), "line_no", F.posexplode(boxes).alias("pos", "b"))
    return words.select("doc_id", "page", "line_no", "pos", "b.word", *[F.get("b.box", i).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def lead_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", strip_lead(F.concat(F.lit(" : -|  "), "p_name", F.lit("  "))).alias("name"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties of events as records, and back."""
    rows = read(spark, sf_dir, "events")
    record = S.decode_record(F.col("props"))
    return rows.select("event_id", F.element_at(record, "k").alias("k"), S.encode_record(record).alias("json"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of five minutes by type."""
    got = microbatch.windowed_counts(read(spark, sf_dir, "events"))
    return got.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        gst_register, gst_register_totals, batch_totals, amount_parse, date_normalise, gstin_parts, state_lookup, number_to_words, words_to_number, tax_split, rate_snap, tax_reconcile, tax_breakdown, detection_score, line_items, hsn_register, gst_register_sheet, whole_register, numbered_invoices, raw_lines,
        ordered_distinct_hsn, extract_fields, noise_repair, merge_first_nonempty, context_gstin_roles, extract_fields_v1, recent_topk, history_search, status_counts, latest_version, batch_progress, owned_jobs, weak_labels, fake_filter, quality_gate, bio_spans, macro_f1,
        train_val_split, upsert_samples, pii_tokens, hex_runs, doc_amounts, word_boxes, lead_stripped, event_props, windowed_events, microbatch.microbatch_threshold, microbatch.user_training_rounds,
    )
}

INV = f"WITH {INVOICE_SQL} "
ORACLE: dict[str, str] = {
    "gst_register": REGISTER_SQL,
    "gst_register_totals": f"{INV} SELECT {SUMS_SQL} FROM invoice",
    "batch_totals": f"{INV} SELECT l_suppkey, {SUMS_SQL} FROM invoice GROUP BY l_suppkey",
    "amount_parse": "SELECT o_orderkey, CASE WHEN p > 0 THEN CAST(p AS DOUBLE) END AS clean, CAST(p AS DOUBLE) AS plain, CASE WHEN p > 0 THEN CAST(p AS DOUBLE) END AS older, CAST(p AS VARCHAR) AS shown FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)",
    "date_normalise": "SELECT o_orderkey, strftime(d, '%d/%m/%Y') AS slash, strftime(d, '%d-%b-%Y') AS dashed, strftime(d, '%d/%m/%Y') AS run, strftime(d, '%d/%m/%Y') AS same FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 120 MONTH AS DATE) AS d FROM orders)",
    "gstin_parts": f"SELECT c_custkey, g AS gstin, true AS relaxed, true AS strict, substr(g, 1, 2) AS state_code, substr(g, 3, 10) AS pan FROM (SELECT c_custkey, {_gstin_sql('c_nationkey', 'c_custkey')} AS g FROM customer)",
    "state_lookup": f"SELECT s_suppkey, c AS code, coalesce(st.state, 'printed') AS state FROM (SELECT s_suppkey, lpad(CAST(s_nationkey * 2 + 1 AS VARCHAR), 2, '0') AS c FROM supplier) LEFT JOIN {STATE_SQL} ON st.code = c",
    "number_to_words": WORDS_SQL,
    "words_to_number": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders",
    "tax_split": f'{INV} SELECT l_orderkey, l_suppkey, CASE WHEN NOT is_inter THEN {_money_sql("half")} END AS "CGST", CASE WHEN NOT is_inter THEN {_money_sql("half")} END AS "SGST", {_money_sql("igst")} AS "IGST", {_money_sql("total_gst")} AS "TOTAL_GST", {_money_sql("total")} AS "TOTAL" FROM invoice',
    "rate_snap": f"{INV} SELECT l_orderkey, l_suppkey, gst_rate || '%' AS \"GST_RATE\", CASE WHEN NOT is_inter THEN (gst_rate // 2) || '%' END AS \"CGST_RATE\", CASE WHEN NOT is_inter THEN (gst_rate // 2) || '%' END AS \"SGST_RATE\", CASE WHEN is_inter THEN gst_rate || '%' END AS \"IGST_RATE\" FROM invoice",
    "tax_reconcile": f'{INV} SELECT l_orderkey, l_suppkey, {_money_sql("taxable")} AS "TAXABLE", {_money_sql("half")} AS "CGST", {_money_sql("igst")} AS "IGST", {_money_sql("total_gst")} AS "TOTAL_GST", {_money_sql("total")} AS "TOTAL" FROM invoice',
    "tax_breakdown": f"""{INV} SELECT inv_no AS "INV_NO", ordinal, component, {_money_sql('amount')} AS amount, rate FROM (
        SELECT inv_no, 1 AS ordinal, 'Taxable' AS component, taxable AS amount, '—' AS rate FROM invoice UNION ALL
        SELECT inv_no, 2, 'IGST', igst, gst_rate || '%' FROM invoice WHERE is_inter UNION ALL
        SELECT inv_no, 3, 'CGST', half, (gst_rate // 2) || '%' FROM invoice WHERE NOT is_inter UNION ALL
        SELECT inv_no, 4, 'SGST', half, (gst_rate // 2) || '%' FROM invoice WHERE NOT is_inter UNION ALL
        SELECT inv_no, 5, 'Total GST', total_gst, '—' FROM invoice UNION ALL SELECT inv_no, 6, 'Net', total, '—' FROM invoice)""",
    "detection_score": f"{INV} SELECT inv_no AS \"INV_NO\", CASE WHEN is_inter THEN 15 ELSE 17 END AS found, CASE WHEN is_inter THEN 15 ELSE 17 END * 100 // {len(fixed.SCORED)} AS score, 'poor' AS band FROM invoice",
    "line_items": f"WITH lines AS ({LINES_SQL}) SELECT 'INV/' || l_orderkey || '/' || l_suppkey AS \"INV_NO\", CAST(sl_no AS INTEGER) AS sl_no, hsn, CAST(qty AS VARCHAR) AS qty, CAST(rate AS VARCHAR) AS rate FROM lines",
    "hsn_register": f"""{INV}, codes AS (SELECT l_orderkey, l_suppkey, hsn, min(sl_no) AS first_sl FROM lines GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY first_sl) AS rn FROM codes)
        SELECT inv_no AS "INV_NO", CAST(rn AS INTEGER) AS sl, hsn AS hsn_code, gst_rate || '%' AS "GST_RATE", CASE WHEN rn = 1 THEN {_money_sql('taxable')} END AS "TAXABLE", CASE WHEN rn = 1 THEN {_money_sql('total')} END AS "TOTAL"
        FROM ranked JOIN invoice USING (l_orderkey, l_suppkey) WHERE rn <= 3""",
    "gst_register_sheet": f"""{INV}, codes AS (SELECT l_orderkey, l_suppkey, hsn, min(sl_no) AS first_sl FROM lines GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY first_sl) AS rn FROM codes),
        i AS (SELECT *, least(3, (SELECT count(*) FROM codes c WHERE c.l_orderkey = invoice.l_orderkey AND c.l_suppkey = invoice.l_suppkey)) AS n, CASE WHEN NOT is_inter THEN gst_rate / 2 END AS part FROM invoice),
        m AS (SELECT *, {_money_sql('taxable')} AS net, {_money_sql('total')} AS gross, {_money_sql('half')} AS tax_half, {_money_sql('igst')} AS tax_whole, CAST(gst_rate // 2 AS VARCHAR) || '%' AS half_rate, gst_rate || '%' AS whole_rate FROM i)
        SELECT inv_no AS "INV_NO", CAST(rn + 3 AS INTEGER) AS row, CAST(rn AS VARCHAR) AS head, hsn AS hsn_code, whole_rate AS "GST_RATE", CASE WHEN NOT is_inter THEN half_rate END AS "CGST_RATE", CASE WHEN NOT is_inter THEN half_rate END AS "SGST_RATE", CASE WHEN is_inter THEN whole_rate END AS "IGST_RATE",
               CASE WHEN rn = 1 THEN tax_half END AS "CGST", CASE WHEN rn = 1 THEN tax_half END AS "SGST", CASE WHEN rn = 1 THEN tax_whole END AS "IGST", CASE WHEN rn = 1 THEN net END AS "TAXABLE", CASE WHEN rn = 1 THEN gross END AS "TOTAL"
        FROM ranked JOIN m USING (l_orderkey, l_suppkey) WHERE rn <= 3
        UNION ALL SELECT inv_no, n + 4, 'TAX TOTAL', NULL, NULL, NULL, NULL, NULL, tax_half, tax_half, tax_whole, net, gross FROM m
        UNION ALL SELECT inv_no, n + 6, 'Net Amount Payable (in words):  ' || CASE WHEN l_orderkey % 2 = 0 THEN 'Rupees ' || gross || ' Only' ELSE '—' END || '   (₹ ' || gross || ' /-)', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM m""",
    "whole_register": f"""{INV}, r AS (
            SELECT CASE grouping(l_suppkey, inv_no) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level, l_suppkey, inv_no, {SUMS_SQL} FROM invoice GROUP BY ROLLUP (l_suppkey, inv_no)
        )
        SELECT row_number() OVER (ORDER BY level = 2, l_suppkey, level, inv_no) AS line, CASE WHEN level = 0 THEN row_number() OVER (PARTITION BY level ORDER BY l_suppkey, inv_no) END AS row_no, level, l_suppkey, inv_no AS "INV_NO", invoices, {', '.join(f'round("{f}", 2) AS "{f}"' for f in fixed.REGISTER_SUMS)} FROM r""",
    "numbered_invoices": f"""{INV} SELECT row_number() OVER (ORDER BY CAST(round(total * 100) AS BIGINT) DESC, inv_no) AS row_no, inv_no AS "INV_NO" FROM invoice""",
    "user_training_rounds": """WITH RECURSIVE a AS (
            SELECT user_id, event_id % 3 AS round, count(*) FILTER (event_id % 7 = 0) AS fakes, count(*) FILTER (event_id % 7 <> 0) AS fresh FROM events GROUP BY 1, 2
        ), u AS (SELECT DISTINCT user_id FROM events), s(user_id, round, seen, fakes, offered, taken, waiting, version) AS (
            SELECT user_id, -1::BIGINT, false, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT FROM u
            UNION ALL
            SELECT s.user_id, s.round + 1, a.user_id IS NOT NULL, coalesce(a.fakes, 0), s.waiting + coalesce(a.fresh, 0), s.waiting + coalesce(a.fresh, 0) >= 5,
                   CASE WHEN s.waiting + coalesce(a.fresh, 0) >= 5 THEN 0 ELSE s.waiting + coalesce(a.fresh, 0) END, s.version + (s.waiting + coalesce(a.fresh, 0) >= 5)::BIGINT
            FROM s LEFT JOIN a ON a.user_id = s.user_id AND a.round = s.round + 1 WHERE s.round < 2
        )
        SELECT user_id, round, fakes, offered, taken, CASE WHEN taken THEN version END AS version FROM s WHERE seen""",
    "raw_lines": r"SELECT doc_id, CAST(i + 2 AS INTEGER) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS t(i)",
    "ordered_distinct_hsn": f"WITH lines AS ({LINES_SQL}), codes AS (SELECT l_orderkey, l_suppkey, hsn, min(sl_no) AS first_sl FROM lines GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY first_sl) AS rn FROM codes) SELECT l_orderkey, l_suppkey, string_agg(hsn, ', ' ORDER BY rn) AS hsn FROM ranked WHERE rn <= 3 GROUP BY 1, 2",
    "extract_fields": f"""{INV} SELECT l_orderkey, l_suppkey, supplier AS "SUPPLIER", recipient AS "RECIPIENT", gstin_s AS "GSTIN_S", gstin_r AS "GSTIN_R", substr(gstin_s, 3, 10) AS "PAN", place AS "PLACE", inv_no AS "INV_NO", strftime(inv_date, '%d/%m/%Y') AS "INV_DATE",
        {_money_sql('taxable')} AS "TAXABLE", CASE WHEN igst > 50 THEN {_money_sql('igst')} END AS "IGST", CASE WHEN half > 1 THEN {_money_sql('half')} END AS "CGST", CASE WHEN total_gst > 1 THEN {_money_sql('total_gst')} END AS "TOTAL_GST",
        {_money_sql('total')} AS "TOTAL", 'STATE BANK' AS "BANK", '1234567890' AS "AC_NO", 'SBIN0001234' AS "IFSC", substr(gstin_s, 1, 2) AS "STATE_CODE" FROM invoice""",
    "noise_repair": "SELECT o_orderkey, 'Invoice ' || strftime(o_orderdate, '%d/%m/%Y') || ' 23-Jul-2025 ICIC045F A/c No. 4496.17 ' || strftime(o_orderdate, '%d/%m/%Y') AS fixed FROM orders",
    "merge_first_nonempty": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'fallback' END AS \"first\", c_mktsegment AS uom, CASE WHEN c_custkey % 3 = 0 THEN 'model name' WHEN c_custkey % 2 = 0 THEN c_name ELSE 'fallback' END AS supplier, CAST(c_nationkey AS VARCHAR) AS qty, '5' AS rate, 4 AS fields FROM customer",
    "context_gstin_roles": f"{INV} SELECT l_orderkey, l_suppkey, gstin_s AS supplier, gstin_r AS recipient FROM invoice",
    # the older rules halve any total tax into CGST and SGST, and then count an IGST beside them; their
    # noise repair joins an HSN code and a quantity of two digits, and only the raw text has such rows
    "extract_fields_v1": f"""{INV}, v AS (SELECT *, CASE WHEN is_inter THEN CAST((CAST(igst * 100 AS BIGINT) + 1) // 2 * 2 AS DECIMAL(18,2)) / 100 + igst ELSE total_gst END AS tax FROM invoice),
        w AS (SELECT *, CASE WHEN abs(tax - total_gst) > 5 THEN tax ELSE total_gst END AS tg FROM v)
        SELECT l_orderkey, l_suppkey, gstin_s AS "GSTIN_S", gstin_r AS "GSTIN_R", inv_no AS "INV_NO", strftime(inv_date, '%d/%m/%Y') AS "INV_DATE", {_money_sql('taxable')} AS "TAXABLE", {_money_sql('tg')} AS "TOTAL_GST",
               CASE WHEN abs(taxable + tg - total) > (taxable + tg) * 0.01 THEN {_money_sql('taxable + tg')} ELSE {_money_sql('total')} END AS "TOTAL", CAST(CASE WHEN len(list_filter(items, lambda x: x.qty < 10)) > 0 THEN len(list_filter(items, lambda x: x.qty < 10)) ELSE len(items) END AS INTEGER) AS n_items FROM w""",
    "recent_topk": "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8",
    "history_search": "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'ur') AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "status_counts": "SELECT o_custkey, count(*) AS jobs, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
    "latest_version": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "batch_progress": "SELECT o_orderkey, coalesce(t, 0) AS total, coalesce(d, 0) AS done, CAST(CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE 100 * d // t END AS INTEGER) AS percent FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_linestatus = 'F') AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
    "owned_jobs": "SELECT c_custkey, count(o_orderkey) AS jobs, max(o_orderkey) AS newest FROM customer LEFT JOIN (SELECT * FROM orders WHERE NOT (o_orderkey = 1 AND o_custkey = 1)) ON o_custkey = c_custkey GROUP BY 1",
    "fake_filter": "SELECT doc_id, doc_id % 9 < 4 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR regexp_matches(coalesce(text, ''), '(?i)AAAAA0000A|Insert\\s+Logo|ExcelDataPro|DO/MMYYYY|TRAINING USE ONLY|Wear Your Opinion|GogstBill|Your Company Name|SAMPLE INVOICE|TEST INVOICE|dummy|000-000-0000') AS fake FROM documents",
    "quality_gate": "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(x) % 4 <> 0)) >= 3 AS good FROM documents",
    "bio_spans": """
        WITH t AS (SELECT conv_id, turn, role || '_' || turn AS tok, CASE turn % 4 WHEN 0 THEN 'B-TOTAL' WHEN 1 THEN 'I-TOTAL' WHEN 2 THEN 'B-HSN' ELSE 'O' END AS lab FROM conversations),
        s AS (SELECT *, sum(CASE WHEN lab LIKE 'I-%' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS span, max(turn) OVER (PARTITION BY conv_id) AS last FROM t),
        g AS (SELECT conv_id, span, arg_min(lab, turn) AS head, min(turn) AS first_turn, max(turn) = max(last) AS is_last, string_agg(tok, ' ' ORDER BY turn) AS value FROM s GROUP BY 1, 2)
        SELECT conv_id, substr(head, 3) AS field, value FROM g WHERE head LIKE 'B-%' QUALIFY row_number() OVER (PARTITION BY conv_id, substr(head, 3) ORDER BY NOT is_last, first_turn) = 1""",
    "macro_f1": """
        WITH p AS (SELECT CASE WHEN l_linenumber = 7 THEN -100 ELSE l_partkey % 5 END AS truth, l_suppkey % 5 AS guess FROM lineitem), q AS (SELECT * FROM p WHERE truth <> -100),
        l AS (SELECT DISTINCT x FROM (SELECT truth AS x FROM q UNION ALL SELECT guess FROM q) WHERE x <> 0),
        c AS (SELECT x, (SELECT count(*) FROM q WHERE truth = x AND guess = x) AS tp, (SELECT count(*) FROM q WHERE truth <> x AND guess = x) AS fp, (SELECT count(*) FROM q WHERE truth = x AND guess <> x) AS fn FROM l),
        f AS (SELECT tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM c)
        SELECT round(avg(2 * p * r / (p + r + 1e-8)), 6) AS macro_f1 FROM f""",
    "train_val_split": "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY source) * 0.8) THEN 'train' ELSE 'val' END AS split FROM documents",
    "upsert_samples": "SELECT doc_id, 'old' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'new' FROM labels",
    "pii_tokens": r"SELECT doc_id, tokens FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '\b([A-Za-z0-9._\-]{3,30}@[A-Za-z0-9]{2,20})\b', 1), ' ') AS tokens FROM documents) WHERE tokens <> ''",
    "hex_runs": "SELECT doc_id, runs FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '([a-f0-9]{30,})', 1), ' ') AS runs FROM documents) WHERE runs <> ''",
    "doc_amounts": r"SELECT doc_id, len(a) AS n, CAST(list_sum(list_transform(a, lambda x: CAST(replace(x, ',', '') AS DECIMAL(18,2)))) AS DOUBLE) AS total FROM (SELECT doc_id, regexp_extract_all(text, '([0-9][0-9,]*\.[0-9]{2})', 1) AS a FROM documents) WHERE len(a) > 0",
    "lead_stripped": "SELECT p_partkey, trim(p_name) AS name FROM part",
    "event_props": "SELECT event_id, CAST(props::JSON ->> 'k' AS VARCHAR) AS k, '{\"k\":\"' || (props::JSON ->> 'k') || '\"}' AS json FROM events",
    "weak_labels": f"{INV}, {LABELS_SQL}",
    "word_boxes": r"""
        WITH l AS (SELECT doc_id, i - 1 AS line_no, list_filter(string_split_regex(ls[i], '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '') AS ws FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
        w AS (SELECT doc_id, line_no, j - 1 AS pos, ws[j] AS word, len(ws) AS k, 800 * length(ws[j]) // list_sum(list_transform(ws, lambda v: length(v))) AS width FROM l, unnest(range(1, len(ws) + 1)) AS u(j)),
        x AS (SELECT *, sum(width) OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS upto, 40 + 20 * (line_no % 46) AS top FROM w)
        SELECT doc_id, CAST(line_no // 46 AS INTEGER) AS page, CAST(line_no AS INTEGER) AS line_no, CAST(pos AS INTEGER) AS pos, word, CAST(100 + CASE WHEN k = 1 THEN 0 ELSE upto - width END AS INTEGER) AS x0, CAST(top AS INTEGER) AS y0, CAST(CASE WHEN k = 1 THEN 900 ELSE 100 + upto END AS INTEGER) AS x1, CAST(top + 20 AS INTEGER) AS y1 FROM x""",
    "microbatch_threshold": "SELECT 0::BIGINT AS batch, count(*) AS rows, count(*) >= 5 AS taken FROM events WHERE event_type = 'purchase'",
    "windowed_events": "SELECT CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}



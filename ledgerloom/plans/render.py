"""Invoices from the order tables, as records and as the text that such an invoice carries.

One invoice per (order, supplier). Everything is deterministic decimal arithmetic, so the structured
columns are the ground truth for what extraction has to give back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Days on paper are 120 months after the order's, inside the years that count as plausible.
MONTHS_ON = 120
LETTERS = ("0123456789", "ABCDEFGHIJ")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to as many tasks as the session shuffles to. Extraction costs far more per byte than the sizes assume by which files are split and small shuffle partitions joined."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def gstin(nation, key):
    """State code, five letters and four digits of the key, and a fixed end."""
    digits = F.lpad(key.cast("string"), 9, "0")
    return F.concat(F.lpad((nation + 1).cast("string"), 2, "0"), F.translate(F.substring(digits, 1, 5), *LETTERS), F.substring(digits, 6, 4), F.lit("K1Z5"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with a line number per invoice, HSN and the taxable value, dealt by order: all that follows by order or invoice stays where it lies."""
    lines = spread(read(spark, sf_dir, "lineitem"), "l_orderkey")
    order = W.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    taxable = (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)")
    return lines.select(
        "l_orderkey", "l_suppkey", F.row_number().over(order).alias("sl_no"), F.lpad((3000 + (F.col("l_partkey") * 7) % 6000).cast("string"), 4, "0").alias("hsn"), F.concat(F.lit("Part "), F.translate(F.col("l_partkey").cast("string"), *LETTERS)).alias("description"),
        F.col("l_quantity").cast("int").alias("qty"), F.lit("Nos").alias("uom"), F.col("l_extendedprice").cast("decimal(12,2)").alias("rate"), F.round(taxable, 2).cast(S.MONEY).alias("taxable"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per invoice: parties, date, items (by line number), their HSN codes alone, and tax amounts.

    Lines cross the network once, as they are read; buyers are joined to orders before orders meet their lines, so no invoice is shuffled.
    Orders are dealt to the lines' tasks (a merge join): invoices without their items look small enough to be broadcast, which would leave all that follows to the few tasks that read orders.
    """
    item = F.struct("sl_no", "description", "hsn", "qty", "uom", "rate", "taxable")
    grouped = invoice_lines(spark, sf_dir).groupBy("l_orderkey", "l_suppkey").agg(F.sum("taxable").cast(S.MONEY).alias("taxable"), F.sort_array(F.collect_list(item)).alias("items"), F.sort_array(F.collect_list(F.struct("sl_no", "hsn"))).alias("codes"), F.sum("qty").cast("int").alias("qty"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.add_months(F.to_date("o_orderdate"), MONTHS_ON).alias("inv_date"))
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey"))
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey"))
    joined = grouped.join(orders.join(customer, "o_custkey").hint("merge"), "l_orderkey").join(supplier, "l_suppkey")
    rate = F.element_at(F.array(F.lit(12), F.lit(18), F.lit(28)), (F.col("l_suppkey") % 3 + 1).cast("int"))
    inter = F.col("s_nationkey") != F.col("c_nationkey")
    half = F.round(F.col("taxable") * F.col("gst_rate") / 200, 2).cast(S.MONEY)
    whole = F.round(F.col("taxable") * F.col("gst_rate") / 100, 2).cast(S.MONEY)
    priced = joined.withColumn("gst_rate", rate).withColumns({"is_inter": inter, "igst": F.when(inter, whole), "cgst": F.when(~inter, half), "sgst": F.when(~inter, half)})
    priced = priced.withColumn("total_gst", F.coalesce(F.col("igst"), (F.col("cgst") * 2)).cast(S.MONEY))
    name = lambda word, key, end="": F.concat(F.lit(word), F.translate(F.col(key).cast("string"), *LETTERS), F.lit(end))
    return priced.select(
        F.concat_ws("/", F.lit("INV"), F.col("l_orderkey"), F.col("l_suppkey")).alias("inv_no"), name("SUPPLIER ", "l_suppkey", " LIMITED").alias("supplier"), gstin(F.col("s_nationkey"), F.col("l_suppkey")).alias("gstin_s"),
        name("Trader ", "o_custkey").alias("recipient"), gstin(F.col("c_nationkey"), F.col("o_custkey") + 500000).alias("gstin_r"), S.state_name(F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")).alias("place"),
        F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0").alias("place_code"), "inv_date", "items", F.col("codes.hsn").alias("codes"), "qty", "gst_rate", "is_inter", "taxable", "cgst", "sgst", "igst", "total_gst", (F.col("taxable") + F.col("total_gst")).cast(S.MONEY).alias("total"),
        "l_orderkey", "l_suppkey", "o_custkey",
    )


def render(rows: DataFrame, noisy: bool = False) -> DataFrame:
    """rows with raw_text, the invoice on paper. ``noisy``: every third invoice has misread words and a misread date."""
    c = F.col
    half_rate = F.floor(c("gst_rate") / 2).cast("string")
    items = F.array_join(F.transform("items", lambda i: F.concat(i["sl_no"].cast("string"), F.lit(" "), i["description"], F.lit(" "), i["hsn"], F.lit(" "), i["qty"].cast("string"), F.lit(" Nos "), i["rate"].cast("string"))), "\n")
    codes = F.array_join(F.transform("items", lambda i: F.concat(F.lit("HSN/SAC: "), i["hsn"])), "\n")
    tax = F.when(c("is_inter"), F.concat(F.lit("IGST "), c("gst_rate").cast("string"), F.lit("%\nIGST Amount: "), c("igst").cast("string"))).otherwise(
        F.concat(F.lit("CGST "), half_rate, F.lit("%\nSGST "), half_rate, F.lit("%\nCGST Amount: "), c("cgst").cast("string"), F.lit("\nSGST Amount: "), c("sgst").cast("string"))
    )
    lines = [
        F.lit("TAX INVOICE"), F.concat(F.lit("For "), c("supplier")), F.concat(F.lit("GSTIN/UIN: "), c("gstin_s")), F.concat(F.lit("PAN: "), F.substring("gstin_s", 3, 10)), F.concat(F.lit("Invoice No: "), c("inv_no")),
        F.concat(F.lit("Invoice Date: "), F.date_format("inv_date", "dd/MM/yyyy")), F.lit("Buyer (Bill to)"), c("recipient"), F.concat(F.lit("GSTIN/UIN: "), c("gstin_r")), F.lit("Place of Supply"), F.concat(c("place"), F.lit(" ("), c("place_code"), F.lit(")")),
        items, codes, F.concat(F.lit("Total "), c("qty").cast("string"), F.lit(" NOS")), F.concat(F.lit("Rate: "), F.get("items", 0)["rate"].cast("string")), F.concat(F.lit("Taxable Value: "), c("taxable").cast("string")), tax,
        F.concat(F.lit("Total GST: "), c("total_gst").cast("string")), F.concat(F.lit("Grand Total: "), c("total").cast("string")), F.lit("Bank: STATE BANK A/c No: 1234567890 IFSC: SBIN0001234"),
    ]
    text = F.concat_ws("\n", *lines)
    if noisy:
        misread = F.regexp_replace(F.regexp_replace(text, "Invoice Date: (\\d{2})/(\\d{2})/", "Invoice Date: $1J$2"), "Invoice No", "lnvoice No")
        text = F.when(c("l_orderkey") % 3 == 0, misread).otherwise(text)
    return rows.withColumn("raw_text", text)


def papers(spark: SparkSession, sf_dir: str, noisy: bool = False) -> DataFrame:
    """(l_orderkey, l_suppkey, truth, raw_text): the text of every invoice beside what it was made from."""
    rows = render(invoices(spark, sf_dir), noisy)
    return rows.select("l_orderkey", "l_suppkey", F.struct(*[c for c in rows.columns if c not in ("l_orderkey", "l_suppkey", "raw_text", "codes")]).alias("truth"), "raw_text")

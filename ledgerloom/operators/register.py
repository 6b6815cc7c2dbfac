"""Sheets as DataFrames: registers with totals, sections, summaries, breakdowns, line items, raw lines.

Records are rows with one text column per field (see ``validate.with_fields``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import blank_to_null, strip
from ..streaming.microbatch import kept

SUM = "decimal(28,2)"


def amount(field: str) -> Column:
    """The field for summing: unreadable and absent values count as 0."""
    return F.coalesce(S.as_number(F.col(field)), F.lit(0)).cast(SUM)


def total_row(records: DataFrame) -> DataFrame:
    """One row: the number of records and the sums of the six amounts."""
    return records.agg(F.count("*").alias("invoices"), *[F.coalesce(F.sum(amount(f)), F.lit(0)).cast(SUM).alias(f) for f in fixed.REGISTER_SUMS])


#: Of a numbered table so many rows, the least by a hash of their order, say where its ranges begin.
SAMPLED = 4096


def numbered(rows: DataFrame, order: list[str], name: str = "row_no", ranges: int | None = None) -> DataFrame:
    """rows with a number from 1 in the order, over all rows and in no single task.

    Rows are dealt to ranges of the order, whose bounds come from a sample of SAMPLED rows; a range's rows are numbered by
    themselves, and the number of rows in the ranges before is added. Bounds and counts read the order's columns alone. A row's
    range is a function of the row, so lost tasks come back the same. Rows equal in the order get different numbers, in no
    stated order, and lie in one range: the order should tell rows apart. Nulls come first.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct(*order)
    sample = rows.select(place.alias("_place")).orderBy(F.xxhash64("_place"), "_place").limit(SAMPLED)
    held = sorted(sample.select("_place", F.row_number().over(W.orderBy("_place")).alias("_nth")).collect(), key=lambda r: r["_nth"])
    cuts = [held[len(held) * i // n]["_place"] for i in range(1, n)] if held else []
    bounds = spark.createDataFrame([([tuple(c) for c in cuts],)], StructType([StructField("_bounds", ArrayType(rows.select(place.alias("p")).schema["p"].dataType))]))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= place))).drop("_bounds")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    starts, before = {}, 0
    for at, count in counts:
        starts[at] = before
        before += count
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv]), F.col("_range")).cast("long")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return ranged.withColumn(name, offset + own).drop("_range")


def rows_and_totals(records: DataFrame, batch: str, key: str) -> DataFrame:
    """(level, batch, key, invoices, the six sums) in one pass over the records: a row per record (level 0), each batch's total (1) and the whole's (2).

    A rollup: partial sums of all three levels leave each task, so no batch is gathered. Records that share batch and key are one row.
    """
    level = F.when(F.grouping_id() == 0, 0).when(F.grouping_id() == 1, 1).otherwise(2)
    sums = [F.sum(amount(f)).cast(SUM).alias(f) for f in fixed.REGISTER_SUMS]
    return records.rollup(batch, key).agg(level.alias("level"), F.count("*").alias("invoices"), *sums).select("level", batch, key, "invoices", *fixed.REGISTER_SUMS)


def whole_register(records: DataFrame, batch: str, key: str, ranges: int | None = None) -> DataFrame:
    """The register of all batches: records in the order of batch and key, each batch's total behind its records and the whole's last, numbered by where they stand; records also by their number among records."""
    # both numberings sample, count and read the rows, which are far cheaper to read than to make
    rows = kept(rows_and_totals(records, batch, key), "register")
    rows = rows.withColumns({"_last": F.col("level") == 2, "_total": F.col("level") == 1})
    placed = numbered(rows, ["_last", batch, "_total", key], "line", ranges)
    # of the lines before a record, one for each earlier batch is a total; batches are numbered by their totals
    batches = numbered(rows.where("level = 1").select(batch), [batch], "_batch_no", ranges)
    out = placed.join(batches.withColumnRenamed(batch, "_batch"), F.col(batch).eqNullSafe(F.col("_batch")) & (F.col("level") < 2), "left")
    return out.select("line", F.when(F.col("level") == 0, F.col("line") - F.col("_batch_no") + 1).alias("row_no"), "level", batch, key, "invoices", *fixed.REGISTER_SUMS)


def batch_register(records: DataFrame, file_col: str, order: list[str], batch: str | None = None) -> DataFrame:
    """21 columns per record with a row number from 1 in batch order.

    Numbers are per ``batch``, which is what bounds a window's partition; without one the whole input is one batch.
    """
    numbered = F.row_number().over(W.partitionBy(batch or F.lit(0)).orderBy(*order))
    kept = [batch] if batch else []
    return records.select(*kept, numbered.alias("row_no"), F.col(file_col).alias("file"), *[strip(F.coalesce(f, F.lit(""))).alias(f) for f in fixed.REGISTER])


def register_totals(records: DataFrame, batch: str) -> DataFrame:
    """The totals row of every batch."""
    return records.groupBy(batch).agg(F.count("*").alias("invoices"), *[F.sum(amount(f)).cast(SUM).alias(f) for f in fixed.REGISTER_SUMS])


def shown_totals(totals: DataFrame) -> DataFrame:
    """Totals as they are printed, with thousands separators."""
    return totals.select("invoices", *[F.format_number(f, 2).alias(f) for f in fixed.REGISTER_SUMS])


def sections(records: DataFrame, key: str) -> DataFrame:
    """(key, section, ordinal, field, label, value) of the non-empty fields, in the order of the sections."""
    rows = [(n, i, f, label) for n, (s, fields) in enumerate(fixed.SECTIONS.items()) for i, (f, label) in enumerate(fields.items())]
    entry = lambda n, i, f, label: F.struct(F.lit(list(fixed.SECTIONS)[n]).alias("section"), F.lit(100 * n + i).alias("ordinal"), F.lit(f).alias("field"), F.lit(label).alias("label"), F.col(f).cast("string").alias("value"))
    return records.select(key, F.inline(F.array(*[entry(*r) for r in rows]))).where(strip("value") != "")


def filled_sections(records: DataFrame, key: str) -> DataFrame:
    """Sections with any value and how many they have."""
    return sections(records, key).groupBy(key, "section").agg(F.count("*").alias("rows"), F.min("ordinal").alias("ordinal"))


def has_value(fields: list[str]) -> Column:
    """Whether any of the fields is filled."""
    return F.exists(F.array(*fields), lambda x: F.coalesce(x != "", F.lit(False)))


def detection_score(found: Column, total: Column | int) -> Column:
    """Whole percent of fields found, cut off."""
    return F.floor(100 * found / F.lit(total)).cast("int") if isinstance(total, int) else F.floor(100 * found / total).cast("int")


def score_band(score: Column, older: bool = False) -> Column:
    high, low = (80, 60) if older else (75, 50)
    return F.when(score >= high, "good").when(score >= low, "fair").otherwise("poor")


def score_record(records: DataFrame, key: str) -> DataFrame:
    """(key, found, score, band) over the scored fields."""
    have = [f for f in fixed.SCORED if f in records.columns]
    found = sum((F.when(F.coalesce(F.col(f), F.lit("")) != "", 1).otherwise(0) for f in have), F.lit(0))
    return records.select(key, found.alias("found")).withColumn("score", detection_score(F.col("found"), len(fixed.SCORED))).withColumn("band", score_band(F.col("score")))


def field_count(record: Column) -> Column:
    """Filled keys of a record map, raw text aside."""
    return F.size(F.map_filter(record, lambda k, v: (k != "raw_text") & (F.coalesce(v, F.lit("")) != "")))


def total_tax(cgst: Column, sgst: Column, igst: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(cgst) + zero(sgst) + zero(igst)


def is_interstate_sheet() -> Column:
    """The breakdown's own test: state codes differ, or there is an IGST."""
    s, r = F.coalesce("GSTIN_S", F.lit("")), F.coalesce("GSTIN_R", F.lit(""))
    return ((F.length(s) >= 2) & (F.length(r) >= 2) & (F.substring(s, 1, 2) != F.substring(r, 1, 2))) | (F.coalesce("IGST", F.lit("")) != "")


def tax_breakdown(records: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, component, amount, rate): IGST across states, else CGST and SGST; empty amounts are left out."""
    row = lambda n, name, field, rate, when=None: F.when(when, F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("component"), F.col(field).alias("amount"), rate.alias("rate"))) if when is not None else F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("component"), F.col(field).alias("amount"), rate.alias("rate"))
    inter, dash = is_interstate_sheet(), F.lit("—")
    rate = lambda f, default: F.coalesce(F.col(f), F.lit(default))
    rows = F.array(
        row(1, "Taxable", "TAXABLE", dash), row(2, "IGST", "IGST", rate("IGST_RATE", "18%"), inter), row(3, "CGST", "CGST", rate("CGST_RATE", "9%"), ~inter), row(4, "SGST", "SGST", rate("SGST_RATE", "9%"), ~inter),
        row(5, "Total GST", "TOTAL_GST", dash), row(6, "Net", "TOTAL", dash),
    )
    return records.select(key, F.inline(F.filter(rows, lambda r: r.isNotNull()))).where(F.coalesce("amount", F.lit("")) != "")


def hsn_register(records: DataFrame, key: str) -> DataFrame:
    """One row per HSN code of a record, amounts on the first only."""
    codes = F.filter(F.transform(F.split(F.coalesce("HSN", F.lit("")), ","), lambda x: strip(x)), lambda c: c != "")
    codes = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("")))
    first = lambda f: F.when(F.col("pos") == 0, F.col(f)).alias(f)
    return records.select("*", F.posexplode(codes).alias("pos", "hsn_code")).select(key, (F.col("pos") + 1).alias("sl"), "hsn_code", "GST_RATE", "CGST_RATE", first("CGST"), "SGST_RATE", first("SGST"), "IGST_RATE", first("IGST"), first("TAXABLE"), first("TOTAL"))


def gst_register_sheet(records: DataFrame, key: str) -> DataFrame:
    """(key, row, head, hsn_code, rates and amounts): the GST register's cells by sheet row.

    From row 4 a row per HSN code, under them the tax totals, and after an empty row the total in words; absent totals and words are a dash.
    """
    # codes without the white space around them; only they are exploded, with two places below, and cells are plain columns, which are compiled
    codes = F.array_remove(F.split(strip(F.coalesce("HSN", F.lit(""))), r"\s*,\s*"), "")
    rates, sums = ["GST_RATE", "CGST_RATE", "SGST_RATE", "IGST_RATE"], ["CGST", "SGST", "IGST", "TAXABLE", "TOTAL"]
    said = F.concat(F.lit("Net Amount Payable (in words):  "), F.coalesce("TOTAL_WORDS", F.lit("—")), F.lit("   (₹ "), F.coalesce("TOTAL", F.lit("—")), F.lit(" /-)"))
    listed = F.when(F.size("_codes") > 0, F.col("_codes")).otherwise(F.array(F.lit("")))
    below = F.array(F.lit(None).cast("string"), F.lit(None).cast("string"))
    given = records.select(key, *rates, *sums, "TOTAL_WORDS", codes.alias("_codes")).withColumn("_n", F.greatest(F.size("_codes"), F.lit(1)))
    rows = given.select(key, *rates, *sums, "TOTAL_WORDS", "_n", F.posexplode(F.concat(listed, below)).alias("_at", "hsn_code"))
    at, n = F.col("_at"), F.col("_n")
    head = F.when(at < n, (at + 1).cast("string")).when(at == n, F.lit("TAX TOTAL")).otherwise(said)
    place = at + F.when(at > n, 5).otherwise(4)
    return rows.select(key, place.alias("row"), head.alias("head"), "hsn_code", *[F.when(at < n, F.col(f)).alias(f) for f in rates], *[F.when((at == 0) | (at == n), F.col(f)).alias(f) for f in sums])


def invoice_details(records: DataFrame, key: str, items: str | None = None) -> DataFrame:
    """One row per line item; a record without items gives one from its header."""
    header = {"description": "ITEM_DESC", "hsn": "HSN", "qty": "QTY", "uom": "UOM", "rate": "RATE"}
    if items is None:
        return records.select(key, F.lit(1).alias("sl_no"), *[F.col(f).alias(n) for n, f in header.items()], *fixed.REGISTER_SUMS[:4], "TOTAL")
    rows = records.select("*", F.explode_outer(items).alias("_item"))
    pick = lambda n, f: F.coalesce(blank_to_null(F.col(f"_item.{n}").cast("string")), F.col(f)).alias(n)
    return rows.select(key, F.coalesce(F.col("_item.sl_no").cast("int"), F.lit(1)).alias("sl_no"), *[pick(n, f) for n, f in header.items()])


def raw_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): every line of a text, the first on sheet row 3."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(key, (F.col("pos") + 3).alias("line_no"), "line")

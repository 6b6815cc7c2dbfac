"""Merging competing extractions, and turning labelled tokens into entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import EXACT, has, strip, sub

#: Fields where a model's value beats the rules' if it is longer than 3 characters.
MODEL_WINS = ["SUPPLIER", "RECIPIENT", "ITEM_DESC"]


def filled(v: Column) -> Column:
    return F.coalesce(strip(v) != "", F.lit(False))


def first_non_empty(a: Column, b: Column) -> Column:
    """Two records (maps of text): a's value where it has one, else b's; empty values are none."""
    merged = F.map_zip_with(F.coalesce(a, F.create_map().cast("map<string,string>")), F.coalesce(b, F.create_map().cast("map<string,string>")), lambda k, x, y: F.when(filled(x), x).otherwise(y))
    return F.map_filter(merged, lambda k, v: filled(v))


def override(rules: Column, model: Column) -> Column:
    """The rules' record, where the model's wins for MODEL_WINS and fills gaps elsewhere."""
    wins = lambda k, y: k.isin(MODEL_WINS) & (F.length(y) > 3)
    merged = F.map_zip_with(rules, model, lambda k, x, y: F.when(F.coalesce(wins(k, y), F.lit(False)), y).when(filled(x), x).otherwise(y))
    return F.map_filter(merged, lambda k, v: filled(v))


def merge_pages(pages: DataFrame, key: str, page: str, record: str) -> DataFrame:
    """One record per key: every field from the earliest page that has it."""
    rows = pages.select(key, page, F.explode(record).alias("field", "value")).where(filled(F.col("value")))
    first = rows.groupBy(key, "field").agg(F.min_by("value", F.struct(page, "value")).alias("value"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias(record))


def bio_entities(tokens: DataFrame, key: str, pos: str = "pos", token: str = "token", label: str = "label") -> DataFrame:
    """(key, field, value) from BIO-labelled tokens.

    A span begins at B- and goes on over any I-, whatever its field; O, and an I- with nothing open,
    belong to none. The first span of a field wins, but a span that reaches the last token overwrites.
    """
    order = W.partitionBy(key).orderBy(pos)
    cut = F.col("lab").startswith("B-") | ~F.col("lab").startswith("I-")
    marked = tokens.select(key, pos, strip(F.replace(F.col(token), F.lit("▁"), F.lit(" "))).alias("tok"), F.col(label).alias("lab")).withColumn("span", F.sum(F.when(cut, 1).otherwise(0)).over(order)).withColumn("last", F.max(pos).over(W.partitionBy(key)))
    spans = marked.groupBy(key, "span").agg(F.min_by("lab", pos).alias("head"), F.min(pos).alias("at"), (F.max(pos) == F.max("last")).alias("trailing"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), "tok"))), lambda x: x["tok"]), " ").alias("value"))
    real = spans.where(F.col("head").startswith("B-")).select(key, F.expr("substring(head, 3)").alias("field"), "value", "at", "trailing")
    return real.groupBy(key, "field").agg(strip(F.min_by("value", F.struct(~F.col("trailing"), "at"))).alias("value"))


def entity_is_valid(field: Column, value: Column) -> Column:
    """Whether a model's entity looks like its field: printable Latin, half of it plain, in the field's format."""
    v = strip(value)
    plain = F.length(sub(value, r"[^a-zA-Z0-9/\-., ]", "", EXACT)) >= F.length(value) * 0.5
    number = S.as_number(F.replace(v, F.lit(","), F.lit("")))
    quantity = F.floor(number)
    checks = [
        (field == "INV_DATE", has(v, r"\d{1,2}[-/]\w{2,9}[-/]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}", EXACT)),
        (field == "PLACE", (F.length(v) >= 3) & S.is_place(v)),
        (field.isin("GSTIN_S", "GSTIN_R"), S.is_gstin(v, strict=True) | S.is_gstin(v)),
        (field.isin("TAXABLE", "CGST", "SGST", "IGST", "TOTAL", "TOTAL_GST", "RATE"), number.isNotNull()),
        (field.isin(*fixed.RATES), has(v, r"^\d{1,2}%?$", EXACT)),
        (field == "QTY", quantity.between(1, 999)),
    ]
    fine = (F.length(v) >= 2) & ~has(value, fixed.TOKEN_MARKERS, EXACT) & ~has(value, r"[^\x20-\x7E -ɏ]", EXACT) & plain
    for is_field, check in checks:
        fine = fine & (~is_field | F.coalesce(check, F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def valid_entities(record: Column) -> Column:
    return F.map_filter(record, entity_is_valid)

"""The record pass: 25 ordered steps of cleaning, repair and tax arithmetic over extracted columns.

A record is a row with one text column per field (null where absent) and ``raw_text``. Each step is one
projection, so the order of steps is the order of the plan. Arithmetic is decimal, rounded half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import EXACT, blank_to_null, contains_any, find, find_all, first_of, has, let, squeeze, strip, sub, trim_tail
from .extract import QTY_TOTAL, RECIPIENT_TEXT

# ---- fixed values: what the steps look for in the raw text ----

FIRST_GSTIN = rf"GSTIN?(?:/UIN)?\s*:\s*({fixed.GSTIN})"
PLACE_FORM = r"^[A-Za-z][A-Za-z\s&\-\.]+$"
DATE_TEXT = [
    r"Invoice\s*Date\s*[:\.]?\s*(\d{1,2}[-/\.]\w{2,9}[-/\.]\d{2,4})",
    r"Invoice\s*Date\s*[:\.]?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"Invoice\s*Date:?(\d{2}[JjIil]\d{2}\d{4})",
    r"Issue\s*Date\s*[:\.]?\s*(\d{1,2}\s*[-–]\s*\w{3,9}\s*[-–]\s*\d{2,4})",
    r"Dated\s+(\d{1,2}[-–]\w{3,9}[-–]\d{2,4})",
]
SUPPLIER_MIDDLE, SUPPLIER_END = r"\s*in\s+words\s*:\s*", r"\s+(?:in\s+words\s*[:\.]?|DECLARATIO|Certified|Rupees|TAX\s+TOTAL|We\s+declare)"
RECIPIENT_END, RECIPIENT_END_AGAIN = r"\s+(?:Customer|Invoice|OA|Delivery|GSTIN|Phone|Address|Challan|\d{6})", r"\s+(?:Plot|Road|GSTIN|Phone|\d{6})"
NOT_RECIPIENT_AGAIN = ["same state", "ship to", "bill to", "dispatch", "kochi"]
QTY_TEXT, ORDER_TEXT = r"\b([1-9]\d{0,2})\s+(?:NOS?|MTS?|Nos?)\b", r"[•·]\s*(\d{3,6})\s"


def none() -> Column:
    return F.lit(None).cast("string")


def money(name: str) -> Column:
    """The field's amount, null where absent, unreadable or 0. A plain amount, as nearly all are, is cast as it is; as a number of up to 15 digits it is the same by way of a double."""
    text = F.col(name)
    plain = F.nullif(text.try_cast("decimal(18,4)"), F.lit(0))
    return F.when(text.rlike(S.PLAIN), plain).when(text.isNotNull(), let(S.to_amount(text), lambda n: F.when(n != 0, n)))


def with_money(df: DataFrame, *names: str) -> DataFrame:
    """df with the fields' amounts as columns ``_n_<field>``, read once however often a step asks for them."""
    return df.withColumns({f"_n_{f}": money(f) for f in names})


def held(name: str) -> Column:
    """An amount of ``with_money``."""
    return F.col(f"_n_{name}")


def with_fields(df: DataFrame, extra: tuple[str, ...] = ("DISCOUNT", "TOTAL_WORDS")) -> DataFrame:
    """df with every field as a text column and raw_text; those that it lacks are null."""
    missing = [f for f in [*fixed.FIELDS, *extra, "raw_text"] if f not in df.columns]
    return df.withColumns({f: none() for f in missing}) if missing else df


# ---- where supplier and buyer are ----


def codes_differ() -> Column:
    s, r = F.substring("GSTIN_S", 1, 2), F.substring("GSTIN_R", 1, 2)
    return F.coalesce((F.length("GSTIN_S") >= 2) & (F.length("GSTIN_R") >= 2) & (s != r), F.lit(False))


def place_differs() -> Column:
    """Whether the supplier's state and the place of supply don't contain each other."""
    state, place = S.state_for_tax(S.state_code(F.col("GSTIN_S"))), F.lower(blank_to_null(F.col("PLACE")))
    return F.coalesce(~(state.contains(place) | place.contains(state)), F.lit(False))


def is_inter(by_place: bool = True, by_igst: bool = False) -> Column:
    """Whether a supply crosses states, by GSTINs and, where asked, by place or by an IGST without CGST."""
    out = codes_differ()
    if by_igst:
        out = out | (blank_to_null(F.col("IGST")).isNotNull() & blank_to_null(F.col("CGST")).isNull())
    # GSTINs settle most; the place is looked at where they don't
    return F.when(out, True).otherwise(place_differs()) if by_place else out


# ---- steps ----


def clean_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({f: S.tidy_value(F.col(f)) for f in [*fixed.FIELDS, "DISCOUNT"]})


def fix_amounts(df: DataFrame) -> DataFrame:
    def amount(c: Column) -> Column:
        bare = strip(F.replace(c, F.lit(","), F.lit("")))
        return F.coalesce(find(bare, r"^(\d+\.?\d{0,2})", flags=EXACT), c)

    turned = lambda c: F.coalesce(F.concat(find(strip(c), r"^%(\d{1,2})$", flags=EXACT), F.lit("%")), c)
    return df.withColumns({f: amount(F.col(f)) for f in fixed.AMOUNTS} | {f: turned(F.col(f)) for f in fixed.RATES})


def fix_gstins(df: DataFrame) -> DataFrame:
    """The first labelled GSTIN of the raw text supplies; else the one nearer to the supplier's name."""
    raw, s, r = F.col("raw_text"), F.upper("GSTIN_S"), F.upper("GSTIN_R")
    first = F.upper(find(raw, FIRST_GSTIN))
    at = lambda what, where: F.nullif(F.instr(where, what), F.lit(0)) if isinstance(what, str) else F.nullif(F.call_function("instr", where, what), F.lit(0))
    name = at(F.substring(F.lower("SUPPLIER"), 1, 15), F.lower(raw))
    swap = F.coalesce(first.isNull() & (F.length("SUPPLIER") >= 10) & (F.abs(at(r, F.upper(raw)) - name) < F.abs(at(s, F.upper(raw)) - name)), F.lit(False))
    return df.withColumns({
        "GSTIN_R": F.when(first.isNotNull() & s.isNotNull() & (s != first) & r.isNull(), s).when(swap, s).otherwise(F.col("GSTIN_R")),
        "GSTIN_S": F.coalesce(first, F.when(swap, r), F.col("GSTIN_S")),
    })


def validate_place(df: DataFrame) -> DataFrame:
    p = strip("PLACE")
    return df.withColumn("PLACE", F.when((F.length(p) >= 3) & has(p, PLACE_FORM, EXACT) & S.is_place(p), F.col("PLACE")))


def fix_invoice_number(df: DataFrame, tenant: bool = False) -> DataFrame:
    return df.withColumn("INV_NO", S.fix_invoice_number(F.col("INV_NO"), F.col("raw_text"), tenant))


def fix_invoice_date(df: DataFrame) -> DataFrame:
    """The own date unless it is another of the record's dates; else one from the raw text."""
    bad = F.filter(F.array("OA_DATE", "ACK_DATE", "DBA_DATE"), lambda x: x.isNotNull())
    good = lambda v: v.isNotNull() & ~F.array_contains(bad, v)
    own = S.normal_date(sub(F.col("INV_DATE"), "/0a/", "/08/"))
    found = first_of(F.col("raw_text"), *DATE_TEXT, clean=S.normal_date, guard=good)
    return df.withColumn("INV_DATE", F.coalesce(F.when(good(own), own), found))


def fix_identities(df: DataFrame) -> DataFrame:
    """PAN, then CIN, then the state code."""
    raw = F.col("raw_text")
    return df.withColumns({"PAN": S.fix_pan(F.col("PAN"), raw), "CIN": S.fix_cin(F.col("CIN"), raw), "STATE_CODE": F.coalesce("STATE_CODE", S.state_code(F.col("GSTIN_S")))})


def fix_names(df: DataFrame) -> DataFrame:
    """Supplier and recipient cut at words that can't belong to a name; a recipient is looked for again."""
    supplier = squeeze(sub(F.col("SUPPLIER"), SUPPLIER_MIDDLE, " "))
    supplier = trim_tail(S.cut_at(supplier, SUPPLIER_END, 200))
    own = F.when(~contains_any(F.col("RECIPIENT"), fixed.NOT_RECIPIENT_LATE), F.col("RECIPIENT"))
    cut = S.cut_at(own, RECIPIENT_END, 150)
    again = first_of(F.col("raw_text"), *RECIPIENT_TEXT[:3], clean=lambda v: S.cut_at(strip(v), RECIPIENT_END_AGAIN, 150), guard=lambda v: (F.length(v) > 3) & ~contains_any(v, NOT_RECIPIENT_AGAIN))
    return df.withColumns({"SUPPLIER": blank_to_null(supplier), "RECIPIENT": F.coalesce(F.when(F.length(cut) > 3, cut), own, again)})


def fix_ifsc(df: DataFrame) -> DataFrame:
    return df.withColumn("IFSC", S.fix_ifsc(F.col("IFSC")))


def fix_quantity(df: DataFrame) -> DataFrame:
    q = F.when(strip("QTY").rlike(r"^\d{1,4}$"), strip("QTY"))
    codes = F.transform(F.split(F.coalesce("HSN", F.lit("")), ","), lambda x: strip(x))
    fine = lambda v: (v.cast("int") < 1000) & ~F.array_contains(codes, v)
    again = first_of(F.col("raw_text"), QTY_TOTAL, QTY_TEXT, clean=lambda v: v.cast("int").cast("string"), guard=fine)
    return df.withColumn("QTY", F.when(q.isNotNull(), F.coalesce(F.when(fine(q), q), again)))


def fix_hsn(df: DataFrame) -> DataFrame:
    """Codes of 4 to 6 digits up to 99999 that are no year and not within 5 of an amount's whole part."""
    whole = F.filter(F.array(*[F.get(F.split(F.col(f), r"\."), 0) for f in ("TAXABLE", "CGST", "SGST", "IGST", "TOTAL", "TOTAL_GST", "RATE")]), lambda x: x.isNotNull())
    near = lambda c: F.exists(whole, lambda a: (a == c) | F.coalesce(F.abs(a.try_cast("long") - c.cast("long")) < 5, F.lit(False)))
    codes = F.transform(F.split("HSN", ","), lambda x: strip(x))
    fine = F.filter(codes, lambda c: c.rlike(r"^\d{4,6}$") & ~c.rlike(r"^(19|20)\d{2}$") & (c.try_cast("int") <= 99999) & ~((F.length(c) == 5) & c.startswith("1") & (c.try_cast("int") > 15000)) & ~near(c))
    return df.withColumn("HSN", blank_to_null(F.array_join(F.array_distinct(fine), ", ")))


def fix_texts(df: DataFrame) -> DataFrame:
    """Description, payment terms, references, transport and the delivery date."""
    raw = F.col("raw_text")
    return df.withColumns({
        "ITEM_DESC": F.when(~contains_any(F.col("ITEM_DESC"), fixed.NOT_DESCRIPTION), F.col("ITEM_DESC")),
        "PAYMENT_TERMS": S.fix_payment_terms(F.col("PAYMENT_TERMS")),
        "OA_NO": S.fix_reference(F.col("OA_NO")), "DBA_NO": S.fix_reference(F.col("DBA_NO")),
        "CUST_ORDER": F.coalesce("CUST_ORDER", find(raw, ORDER_TEXT)),
        "TRANSPORT": S.fix_transport(F.col("TRANSPORT")), "DBA_DATE": S.find_dba_date(F.col("DBA_DATE"), raw),
    })


def clear_intrastate_igst(df: DataFrame) -> DataFrame:
    """Within a state an IGST beside CGST and SGST, or below 50, is dropped; the place doesn't count here."""
    found = with_money(df, "IGST", "CGST", "SGST")
    igst = held("IGST")
    drop = F.coalesce(igst.isNotNull() & ~is_inter(by_place=False) & ((held("CGST").isNotNull() & held("SGST").isNotNull()) | (igst < 50)), F.lit(False))
    found = found.withColumn("_drop", drop)
    return found.withColumns({f: F.when(~F.col("_drop"), F.col(f)) for f in ("IGST", "IGST_RATE")}).drop("_drop", *[f"_n_{f}" for f in ("IGST", "CGST", "SGST")])


def snap(amount: Column, taxable: Column, legal: list[int]) -> Column:
    """The legal rate within half a point of amount / taxable, or null."""
    rate = F.round(amount / F.when(taxable > 0, taxable) * 100, 1)
    return F.when(rate.isNotNull(), let(rate, lambda rate: F.coalesce(*[F.when(F.abs(rate - r) < F.lit(0.5).cast("decimal(9,4)"), F.lit(r)) for r in legal])))


def derive_rates(df: DataFrame) -> DataFrame:
    # no amount changes here
    df = with_money(df, "CGST", "IGST", "TOTAL_GST", "TAXABLE").withColumn("_inter", is_inter(by_igst=True))
    inter = F.col("_inter")
    both = F.col("CGST_RATE").isNotNull() & F.col("SGST_RATE").isNotNull()
    summed = F.when(both, S.show_rate(F.floor(S.rate_of(F.col("CGST_RATE")) + S.rate_of(F.col("SGST_RATE")))))
    df = df.withColumn("GST_RATE", F.coalesce("GST_RATE", summed, F.when(~both, F.col("IGST_RATE"))))
    shown = lambda c: F.when(c.isNotNull(), S.show_rate(c))
    df = df.withColumn("_c", F.when(F.col("CGST_RATE").isNull() & ~inter, snap(held("CGST"), held("TAXABLE"), fixed.CGST_SNAP)))
    df = df.withColumns({"_half": shown(F.col("_c")), "_whole": shown(F.col("_c") * 2), "_i": shown(F.when(F.col("IGST_RATE").isNull(), snap(held("IGST"), held("TAXABLE"), fixed.IGST_SNAP)))})
    df = df.withColumns({"GST_RATE": F.coalesce("GST_RATE", "_whole", "_i"), "SGST_RATE": F.coalesce("_half", "SGST_RATE"), "CGST_RATE": F.coalesce("CGST_RATE", "_half"), "IGST_RATE": F.coalesce("IGST_RATE", "_i")})
    df = df.withColumn("_g", F.when(F.col("GST_RATE").isNull(), snap(held("TOTAL_GST"), held("TAXABLE"), fixed.GST_SNAP)))
    df = df.withColumns({"_whole": shown(F.col("_g")), "_half": F.when(~inter & F.col("CGST_RATE").isNull(), shown(F.col("_g") / 2))})
    df = df.withColumns({"GST_RATE": F.coalesce("GST_RATE", "_whole"), "IGST_RATE": F.coalesce(F.when(inter, F.col("_whole")), "IGST_RATE"), "SGST_RATE": F.coalesce("_half", "SGST_RATE"), "CGST_RATE": F.coalesce("CGST_RATE", "_half")})
    df = df.withColumn("_half", F.when(~inter & F.col("CGST_RATE").isNull() & F.col("GST_RATE").isNotNull(), S.show_rate(S.rate_of(F.col("GST_RATE")) / 2)))
    df = df.withColumns({"SGST_RATE": F.coalesce("_half", "SGST_RATE"), "CGST_RATE": F.coalesce("CGST_RATE", "_half"), "IGST_RATE": F.coalesce("IGST_RATE", F.when(inter, F.col("GST_RATE")))})
    return df.drop("_inter", "_c", "_i", "_g", "_half", "_whole", *[f"_n_{f}" for f in ("CGST", "IGST", "TOTAL_GST", "TAXABLE")])


def fix_sgst(df: DataFrame) -> DataFrame:
    """An SGST that is the taxable value, or over five times the CGST, becomes the CGST."""
    found = with_money(df, "CGST", "SGST", "TAXABLE")
    c, s, t = held("CGST"), held("SGST"), held("TAXABLE")
    wrong = F.coalesce(c.isNotNull() & s.isNotNull() & (F.coalesce(F.abs(s - t) < 1, F.lit(False)) | (s > c * 5)), F.lit(False))
    return found.withColumn("SGST", F.when(wrong, S.show(c)).otherwise(F.col("SGST"))).drop(*[f"_n_{f}" for f in ("CGST", "SGST", "TAXABLE")])


def fix_interstate(df: DataFrame) -> DataFrame:
    """Across states CGST and SGST that add up to the IGST are dropped."""
    found = with_money(df, "IGST", "CGST", "SGST")
    agree = F.coalesce((held("IGST") > 1) & (F.abs(held("CGST") + held("SGST") - held("IGST")) < 1), F.lit(False))
    found = found.withColumn("_drop", F.when(agree, is_inter()).otherwise(False))
    return found.withColumns({f: F.when(~F.col("_drop"), F.col(f)) for f in ("CGST", "SGST", "CGST_RATE", "SGST_RATE")}).drop("_drop", *[f"_n_{f}" for f in ("IGST", "CGST", "SGST")])


def propagate_igst(df: DataFrame) -> DataFrame:
    """Across states a total GST without CGST is the IGST."""
    absent = F.col("IGST").isNull() & F.col("CGST").isNull() & F.col("TOTAL_GST").isNotNull()
    return df.withColumn("IGST", F.when(absent, F.when(is_inter(), F.col("TOTAL_GST"))).otherwise(F.col("IGST")))


def validate_amounts(df: DataFrame) -> DataFrame:
    """Amounts made to agree: tax halves or IGST, their sum, the total, and what can be filled back.

    An amount is read once, and again only where it has changed.
    """
    read = ["IGST", "TAXABLE", "CGST", "SGST", "TOTAL_GST", "TOTAL", "DISCOUNT"]
    df = with_money(df, *read).withColumn("_inter", is_inter(by_igst=True))
    inter = F.col("_inter")
    df = df.withColumn("_is_net", S.close(held("IGST"), held("TAXABLE"), 0.001))
    df = df.withColumns({f: F.when(~F.col("_is_net"), F.col(f)) for f in ("IGST", "_n_IGST")})
    df = df.withColumn("_half", F.when(~inter & held("CGST").isNull() & held("IGST").isNotNull(), S.show(held("IGST") / 2)))
    df = df.withColumns({"CGST": F.coalesce("_half", "CGST"), "SGST": F.coalesce("_half", "SGST"), "IGST": F.when(F.col("_half").isNull(), F.col("IGST"))})
    changed = F.col("_half").isNotNull()
    df = df.withColumns({f"_n_{f}": F.when(changed, money(f)).otherwise(held(f)) for f in ("CGST", "SGST", "IGST")})
    rate = S.rate_of(F.coalesce("IGST_RATE", "GST_RATE"))
    df = df.withColumn("_made", F.when(inter & held("IGST").isNull() & held("TAXABLE").isNotNull(), S.show(held("TAXABLE") * rate / 100)))
    df = df.withColumn("IGST", F.coalesce("_made", "IGST")).withColumn("_n_IGST", F.when(F.col("_made").isNotNull(), money("IGST")).otherwise(held("IGST")))
    df = df.withColumn("_tax", F.when(inter, F.round(held("IGST"), 2)).otherwise(F.round(held("CGST") + held("SGST"), 2)))
    df = df.withColumn("_off", F.col("_tax").isNotNull() & (held("TOTAL_GST").isNull() | (F.abs(F.col("_tax") - held("TOTAL_GST")) > 2)))
    df = df.withColumn("TOTAL_GST", F.when(F.col("_off"), S.show(F.col("_tax"))).otherwise(F.col("TOTAL_GST")))
    df = df.withColumn("_n_TOTAL_GST", F.when(F.col("_off"), money("TOTAL_GST")).otherwise(held("TOTAL_GST")))
    df = df.withColumn("_net", F.round(held("TAXABLE") + held("TOTAL_GST") - F.coalesce(held("DISCOUNT"), F.lit(0)), 2))
    df = df.withColumn("_off", F.col("_net").isNotNull() & (held("TOTAL").isNull() | ~S.close(F.col("_net"), held("TOTAL"), 0.015)))
    df = df.withColumn("TOTAL", F.when(F.col("_off"), S.show(F.col("_net"))).otherwise(F.col("TOTAL")))
    df = df.withColumn("_split", F.when(~inter & held("CGST").isNull() & held("TOTAL_GST").isNotNull(), S.show(held("TOTAL_GST") / 2)))
    total = F.when(F.col("_off"), money("TOTAL")).otherwise(held("TOTAL"))
    back = F.when(held("TAXABLE").isNull() & (held("TOTAL_GST") / total > 0.01), S.show(total - held("TOTAL_GST")))
    df = df.withColumns({"CGST": F.coalesce("_split", "CGST"), "SGST": F.coalesce("_split", "SGST"), "TAXABLE": F.coalesce(back, "TAXABLE")})
    return df.drop("_inter", "_is_net", "_half", "_made", "_tax", "_off", "_net", "_split", *[f"_n_{f}" for f in read])


def add_total_words(df: DataFrame) -> DataFrame:
    return df.withColumn("TOTAL_WORDS", F.coalesce(S.number_to_words(F.round(money("TOTAL"), 2)), "TOTAL_WORDS"))


STEPS = [
    clean_strings, fix_amounts, fix_gstins, validate_place, fix_invoice_number, fix_invoice_date, fix_identities, fix_names, fix_ifsc, fix_quantity, fix_hsn, fix_texts,
    clear_intrastate_igst, derive_rates, fix_sgst, fix_interstate, propagate_igst, validate_amounts, add_total_words,
]
TAX_STEPS = [clear_intrastate_igst, derive_rates, fix_sgst, fix_interstate, propagate_igst, validate_amounts]


def post_process(df: DataFrame, steps=None) -> DataFrame:
    """All steps in order over a DataFrame of records; fields it lacks are added as null."""
    df = with_fields(df)
    for step in steps or STEPS:
        df = step(df)
    return df


def labelled_gstins(raw: Column) -> Column:
    return F.array_distinct(F.transform(find_all(raw, FIRST_GSTIN), F.upper))

"""Field extraction: an invoice's text becomes one nullable text column per field.

Two precedences occur. A line rule takes the earliest line on which any of its patterns matches; a
text rule takes the first of its patterns that matches anywhere. Rules are built-in expressions, each a column of its
own, so that those nothing asks for are left out; stages keep generated expressions from growing with the rules before
them. A rule runs only on a text with one of its words (``text.Mentioned``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..functions.text import EXACT, Mentioned, blank_to_null, const_array, contains_any, find, find_all, first_of, has, label_line, let, line_first, lines_of, match_places, mentioning, once, plain_spaces, squeeze, strip, sub, trim_tail

# ---- fixed values: what each field looks like on paper ----

NUM, NUM2 = r"([\d,]+\.?\d*)", r"([\d,]+\.\d{2})"
DAY_NAME, DAY_SPACED = r"(\d{1,2}[-/]\w{3,9}[-/]\d{2,4})", r"(\d{1,2}\s*[-–]\s*\w{3,9}\s*[-–]\s*\d{2,4})"

#: One pattern, earliest line.
LINE_PATTERNS = {
    "SERVICE_TAX": [r"Service\s*Tax\s*No\.?\s*[:\s]+([A-Z0-9]{10,25})"],
    "MSME_NO": [r"MSME\s*NO?\s*[:\-]+\s*(\d{6,15})"],
    "LUT_BOND": [r"LUT\s*Bond\s*No\.?\s*[:\s]+([A-Z0-9]{5,20})"],
    "FSSAI": [r"FSSAI\s*No\.?\s*[:\s]+([A-Z0-9]{4,20})"],
    "TAN": [r"\bTAN\s*[:\-]?\s*([A-Z]{4}\d{5}[A-Z])"],
    "STATE_CODE": [r"State\s*(?:Name\s*)?[,:]?\s*[A-Za-z,\s]+?,?\s*Code\s*[:\-]?\s*(\d{2})\b", r"State\s*Code\s*[:\-]?\s*(\d{2})\b"],
    "VEHICLE_NO": [r"Vehicle\s*No\.?\s*[:\s]+([A-Z]{2}\d{2}[A-Z]{2}\d{4})", r"Vehicle\s*No\.?\s*[:\s]+([A-Z0-9]{6,12})"],
    "ACK_NO": [label_line(r"Ack\s*No\.?", r"(\d{10,16})[ \t]*(?:\n|\z)"), r"Ack\s*No\.?\s*[:\s]+(\d{10,16})"],
    "ACK_DATE": [label_line(r"Ack\s*Date", r"[^\n]*?(\d{1,2}-\w{3}-\d{2,4})"), r"Ack\s*Date\s*[:\s]+(\d{1,2}[-/]\w{2,9}[-/]?\d{0,4})"],
    "CHALLAN_NO": [label_line(r"Challan\s*No\.?", r"(\d{1,10})[ \t]*(?:\n|\z)"), r"Challan\s*No\.?\s*[:\-]?\s*(\d{1,10})\b"],
    "CHALLAN_DATE": [label_line(r"Challan\s*Date", rf"[^\n]*?{DAY_NAME}"), rf"Challan\s*Date\s*[:\-]?\s*{DAY_NAME}"],
    "EWAY_BILL": [label_line(r"E[-\s]?Way\s*Bill\s*No\.?", r"(\d{8,16})[ \t]*(?:\n|\z)"), r"E[-\s]?Way\s*Bill\s*No\.?\s*[:\-]?\s*(\d{8,16})"],
    "TRANSPORT_ID": [label_line(r"Transport\s*ID", r"([A-Z0-9]{8,30})[ \t]*(?:\n|\z)"), r"Transport\s*ID\s*[:\-]?\s*([A-Z0-9]{8,30})"],
    "VENDOR_CODE": [label_line(r"Vendor\s*Code\s*[:\.]?", r"(\d{3,10})[ \t]*(?:\n|\z)"), r"Vendor\s*Code\s*[:\-]?\s*(\d{3,10})"],
    "OA_DATE": [r"OA\s*Date\s*[:\-]?\s*(\d{1,2}[-/]\w{2,9}[-/]?\d{0,4})"],
    "DBA_DATE": [r"(?:DBA|OBA)\s*Date\s*[:\-]?\s*(\d{1,2}[-/]\w{2,9}[-/]?\d{0,4})", label_line(r"(?:DBA|OBA)\s*Date\s*[:\-]?", r"[^\n]*?(\d{1,2}-\w{3}-\d{2,4}|\d{1,2}/\d{2}/\d{2,4})")],
    "CUST_ORDER": [r"[•·]\s*(\d{3,6})\s"],
    "AC_NO": [r"A/[ce]\s*No\.?\s*[:\-]?\s*(\d{6,20})", r"Account\s*Number\s*[:\-;]?\s*(\d{6,20})"],
}
#: Words, lower case, of which the first line of each match of a field's patterns has one.
MENTIONS = {
    "SERVICE_TAX": ("service",), "MSME_NO": ("msme",), "LUT_BOND": ("lut",), "FSSAI": ("fssai",), "TAN": ("tan",), "STATE_CODE": ("code",), "VEHICLE_NO": ("vehicle",), "ACK_NO": ("ack",), "ACK_DATE": ("ack",), "CHALLAN_NO": ("challan",),
    "CHALLAN_DATE": ("challan",), "EWAY_BILL": ("way",), "TRANSPORT_ID": ("transport",), "VENDOR_CODE": ("vendor",), "OA_DATE": ("oa",), "DBA_DATE": ("dba", "oba"), "CUST_ORDER": ("•", "·"), "AC_NO": ("a/c", "a/e", "account"),
    "INV_NO": ("invoice", "in-", "/", "gst-"), "INV_DATE": ("date",), "DISPATCH_DATE": ("dispatch",), "DISPATCH_FROM": ("dispatch",), "TRANSPORT": ("transport",), "SHIP_BY": ("ship",), "PAN": ("pan",), "CIN": ("u", "l"), "PAYMENT_TERMS": ("payment",),
    "OA_NO": ("oa",), "DBA_NO": ("dba", "oba"), "BANK": ("bank",), "IFSC": ("ifsc",), "UPI_ID": ("upi", "@"),
}
#: What the first line of each match has, for fields of several patterns.
HEADS = {
    "STATE_CODE": "State", "VEHICLE_NO": r"Vehicle\s*No", "ACK_NO": r"Ack\s*No", "ACK_DATE": r"Ack\s*Date", "CHALLAN_NO": r"Challan\s*No", "CHALLAN_DATE": r"Challan\s*Date", "EWAY_BILL": r"E[-\s]?Way\s*Bill", "TRANSPORT_ID": r"Transport\s*ID",
    "VENDOR_CODE": r"Vendor\s*Code", "DBA_DATE": r"(?:DBA|OBA)\s*Date", "AC_NO": "A(?:/[ce]|ccount)", "INV_NO": r"Invoice\s*No|IN-\d|[A-Z]/\d|GST-\d|ITBG/", "INV_DATE": r"Invoice\s*Date|Issue\s*Date|Dated", "DISPATCH_DATE": r"Dispatch\s*Date",
    "DISPATCH_FROM": r"Dispatch\s*From", "TRANSPORT": "Transport", "UPI_ID": "UPI|@",
}
#: Words, lower case, of which each match of a pattern over the whole text has one, one by one; _total_tax: TOTAL_TAX.
TOTAL_TAX = r"Total\s*Tax"
TAXABLE_LEADS, IGST_LEADS, TOTAL_GST_LEADS = [("_total_tax",), ("taxable",), ("assessable",)], [("_total_tax",), ("igst",)], [("_total_tax",), ("_total_tax",), ("total",)]
TOTAL_LEADS, WORDS_LEADS = [("figure",), ("payable",), ("due",), ("after",), ("grand",)], [("indian",), ("words",), ("rupee",)]
RECIPIENT_LEADS = [("consignee",), ("buyer",), ("m",), ("client",)]
RATE_LEADS = {"CGST_RATE": [("cgst",)], "SGST_RATE": [("sgst",)], "IGST_RATE": [("igst",)] * 2, "GST_RATE": [("gst",), ("@",), ("gst",)]}
INV_NO_LINE = [
    label_line(r"Invoice\s*No\.?", r"\*?(?!Dated|Date|Delivery|Mode|Reference|Other)(?!\d{8,}[ \t]*(?:\n|\z))(?=[^\n]*\d)([^\n*]{3,})", 4),
    r"Invoice\s*No\.?\s*[:\-|]?\s*([A-Z]{1,8}/[\d/\-\.]{3,25})",
    r"Invoice\s*No\.?\s*[:\-|]?\s*(GST[-/]\d{3,6}[-/]\d{2,4})",
    r"Invoice\s*No\.?\s*[:\-|]?\s*(ITBG/[^\s\|I]{5,30})",
    r"Invoice\s*No\.?\s*[:\-|]?\s*(IN-\d+)",
    r"TAX\s+INVOICE\s+(IN-\d+)",
    r"^\s*(IN-\d+|[A-Z]{2,8}/\d{3,6}/\d{2,4}|GST-\d{4}-\d{2,4}|ITBG/[\d\-/A-Z]+)[ \t]*(?:\n|\z)",
]
INV_DATE_LINE = [
    label_line(r"Invoice\s*Date", rf"[^\n]*?({fixed.ANY_DATE})", 3),
    r"Invoice\s*Date\s*[:\.]?\s*(\d{1,2}[-/\.]\w{2,9}[-/\.]\d{2,4})",
    r"Invoice\s*Date\s*[:\.]?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"Invoice\s*Date:?(\d{2}[JjIil]\d{2}\d{4})",
    r"Invoice\s*Date:?(\d{8})",
    r"Invoice\s*Date:(\d{2}/0a/\d{4})",
    label_line(r"Issue\s*Date\s*[:\.]?", rf"[^\n]*?{DAY_SPACED}"),
    rf"Issue\s*Date\s*[:\.]?\s*{DAY_SPACED}",
    label_line("Dated", r"[^\n]*?(\d{1,2}-\w{3}-\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4})", 3),
]
DISPATCH_DATE_LINE = [
    label_line(r"Dispatch\s*Date\s*[:\.]?", rf"[^\n]*?{DAY_SPACED}", 2),
    label_line(r"Dispatch\s*Date\s*[:\.]?", r"[^\n]*?(\d{1,2}[-/]\w{2,9}[-/]\d{2,4})", 2),
    rf"Dispatch\s*Date\s*[:\-]?\s*{DAY_SPACED}",
    r"Dispatch\s*Date\s*[:\-]?\s*(\d{1,2}[-/]\w{2,9}[-/]\d{2,4})",
]
BANK_ROW_NAME = r"Bank\s*[:\-]?\s*([A-Za-z][A-Za-z\s.&]{1,20}?)\s+A/[ce]\s*No\.?\s*[:\-]?\s*\d{6,20}\s+IFSC\s*[:\-]?\s*[A-Z]{4}[0O][A-Z0-9]{5,6}"
BANK_ALONE = r"Bank\s*(?:Name)?\s*[:\-]?\s*([A-Za-z][A-Za-z\s.&LTD]{2,30}?)(?:\s+A/[ce]|\s+Account|\s*$)"
SUPPLIER_TEXT = [r"[Ff]or\s+((?:[A-Z][A-Z\s&.,()]+)(?:LTD|LIMITED|PVT)\.?)"]
RECIPIENT_TEXT = [
    r"Consignee\s*\(?Ship\s*to\)?\s*\n\s*\*?\*?([A-Za-z][A-Za-z\s&.,\-]{3,60})",
    r"Buyer\s*\(?Bill\s*to\)?\s*\n\s*\*?\*?([A-Za-z][A-Za-z\s&.,\-]{3,60})",
    r"M\s*/\s*[Ss]\s+([A-Za-z][A-Za-z\s&.,\-]{3,60})",
    r"Client\s*Name\s*\n\s*Same\s+State\s+GST\s+Client\s*\n\s*([A-Za-z][A-Za-z\s]{2,30})",
]
RECIPIENT_END = r"\s+(?:Plot|Road|Building|No\.|Address|Invoice|GSTIN|Phone|Challan|Buyer|\d{6})|\s*[•·]\s*"
TAXABLE_TEXT = [rf"Total\s*Taxable\s*Value\s*[:\.]?\s*[₹+]?\s*{NUM}", rf"Taxable\s*(?:Amount|Value)\s*[:\.]?\s*[₹+]?\s*{NUM}", rf"(?:Total\s*)?Assessable\s*Value\s*[:\.]?\s*{NUM}"]
ROW_TALLY = rf"(?:oo|00)\s+{NUM2}\]?\s*(\d{{1,2}})%\]?\s*{NUM2}\]?\s*(\d{{1,2}})%\]?\s*{NUM2}\]?\s*{NUM2}"
ROW_HSN = rf"(\d{{4,6}})\s+{NUM2}\s+(\d{{1,2}})%\s+{NUM2}\s+(\d{{1,2}})%\s+{NUM2}\s+{NUM2}"
ROW_TAX_TOTAL = r"TAX\s*TOTAL\s+([\d.]+)\s+([\d,.]+)"
ROW_SUMMARY = r"Taxable\s*Amount\s+([\d,]+\.?\d*)[\s\S]{0,100}?Total\s*Tax\s+([\d,]+\.?\d*)"
HALF_TAX = [r"(?m){}\s+([\d,]+\.\d{{2}})\s*$", r"{}\s*(?:Amount|Amt)?\s*[:\.]?\s*([\d,]+\.\d{{2}})(?!\d)"]
IGST_TEXT = [rf"Total\s*Tax\s*Amount\s*[:\.]?\s*[₹+]?\s*{NUM}", r"IGST\s*(?:Amount)?\s*[@\d\.%\s]*[:\.]?\s*([\d,]+\.\d{2})(?!\d)"]
TOTAL_GST_TEXT = [rf"Total\s*Tax\s*Amount\s*[:\.]?\s*[₹+]?\s*{NUM}", rf"Total\s*Tax\b[^\n]{{0,15}}[:\s]*{NUM}", rf"Total\s*GST\s*[:\.]?\s*{NUM}"]
TOTAL_TEXT = [
    rf"Total\s*Value\s*\(in\s*figure[s]?\)\s*[₹+]?\s*{NUM}",
    r"Net\s*Amount\s*Payable\s*[:\.]?\s*[₹+]?\s*([\d,]{3,}\.?\d*)",
    rf"Amount\s*Due\s*[:\.]?\s*[₹+]?\s*{NUM}",
    r"Total\s*Amount\s*After\s*Tax\s*[₹+]?\s*([\d,]{3,}\.?\d*)",
    r"Grand\s*Total\s*[:\.]?\s*[₹+]?\s*([\d,]{3,}\.?\d*)",
]
TOTAL_WORDS_TEXT = [r"Indian\s*Rupee\s+([A-Z][A-Za-z\s]+Only)", r"Total\s*in\s*words\s*:\s*([A-Z][A-Za-z\s]+(?:RUPEES)[A-Za-z\s]*(?:ONLY))", r"rupees?\s+((?:[A-Za-z]+\s+){1,10}(?:thousand|lakh|crore)[A-Za-z\s]+)"]
RATE_TEXT = {
    "CGST_RATE": [r"CGST\s*%?\s*[:\.]?\s*(\d+)\s*%"],
    "SGST_RATE": [r"SGST\s*%?\s*[:\.]?\s*(\d+)\s*%"],
    "IGST_RATE": [r"IGST\s*%?\s*[:\.]?\s*(\d+)\s*%", r"IGST\b[^\n]{0,20}(\d{1,2})%"],
    "GST_RATE": [r"GST\s*%\s*[:\.]?\s*(\d+)", r"@(\d{1,2})%", r"\bGST\b[^\n]{0,15}(\d+)\s*%"],
}
HSN_LABELLED = r"(?:HSN|SAC)\s*(?:/\s*(?:SAC|HSN))?\s*(?:Code)?\s*[:\-]?\s*(\d{4,8})"
HSN_ROW, HSN_ALONE = r"(?m)^\s*\d+\s+(\d{4,8})\s+[A-Za-z\d]", r"(?m)^[ \t]*(\d{4,6})[ \t]*[jJ|lI \t]*$"
QTY_TOTAL, QTY_ROW, QTY_ANY = r"Total\s+(\d{1,4})\s+NOS?\b", r"\b\d{4,6}\s+\d+\s+\w+\s+.*?\s+(\d{1,4})\s+Nos?\b", r"\b([1-9]\d{0,2})\s+(?:NOS?|MTS?|Nos?|Units?|Pcs?)\b"
UOM_TEXT = r"\b\d+\s+(Nos?|No\.?|MTS?|Units?|Pcs?|Kgs?)\b"
RATE_ALONE = [r"\b1\s+MTS?\s+([\d,]+\.\d{2})\b", r"\b1\s+NOS?\s+([\d,]+\.\d{2})\b", r"Rate\s*[:\.]?\s*([\d,]+\.\d{2})"]
DESC_SERVICE = r"9987\s+([\s\S]*?)\s+\d+\s+Nos?\b"
DESC_ROW = r"(?m)^\s*\d+\s+\d{4,8}\s+([A-Za-z\*][^\n]{3,80}?)\s+\d+\s+(?:No\.?|NOS?|MTS?)"
PLACE_LABEL = label_line(r"Place\s*of\s*(?:Supply)?\s*[:\.]?", r"[^\n]*?([A-Za-z][A-Za-z\s]{1,20})\s*\(\s*(\d{2})\.?\s*\)", 2)
PLACE_LABEL_BARE = label_line(r"Place\s*of\s*(?:Supply)?\s*[:\.]?", r"([A-Za-z][A-Za-z\s]{2,40})[ \t]*(?:\n|\z)", 2)
PLACE_SAME, PLACE_ALONE = r"Place\s*of\s*Supply\s*[:\-]?\s*([A-Z]{2,3})\s*\((\d{2})\)", r"([A-Za-z][A-Za-z\s]{2,20})\s*\(\s*(\d{2})\.?\s*\)"
UPI_LABEL, UPI_ANY = label_line(r"UPI\s*ID\s*[:\-]?", r"([^\n]*@[^\n]*)"), r"(\b[A-Za-z0-9._\-]{3,30}@[A-Za-z0-9]{2,20}\b)"
NOT_UPI = r"gmail|yahoo|hotmail|email|www"
GSTIN_LABELLED, GSTIN_BARE, GSTIN_PAN = rf"GSTIN?(?:/UIN)?\s*[:\s]+({fixed.GSTIN})", rf"(?=\d)\b({fixed.GSTIN})\b", rf"GSTIN\s*[:\s]+({fixed.GSTIN})\s+PAN\s*[:\s]+({fixed.PAN})"
GSTIN_EITHER, GSTIN_LONG = rf"GSTIN?(?:/UIN)?\s*[:\s]+{fixed.GSTIN}|(?=\d)\b{fixed.GSTIN}\b", 15
#: A GSTIN that a PAN follows and that stands labelled before: the paper's parties are one.
GSTIN_TWICE = rf"GSTIN\s*[:\s]+({fixed.GSTIN})\b(?s:.*)GSTIN\s*[:\s]+\1\s+PAN\s*[:\s]+{fixed.PAN}"
TRANSPORT_ALONE, TRANSPORT_GSTIN = r"Transport\s*(?:ID|GSTIN|No)?\s*[:\-]?\s*\n", rf"Transport\s*(?:ID|GSTIN)\s*[:\-]?\s*({fixed.GSTIN})"
DISPATCH_FROM_LINE = [label_line(r"Dispatch\s*From\s*[:\.]?", r"(\w[^\n]{0,49})"), r"Dispatch\s*From\s*[:\-]?\s*(\S[^\n]{0,40})"]
TRANSPORT_LINE = [label_line(r"Transport(?:er\s*Name)?", r"(?!\d+[ \t]*(?:\n|\z))([^\n]{4,80})"), r"Transporter?\s*Name\s*[:\-]?\s*([A-Za-z][A-Za-z\s&.,\-]{3,60})"]
SHIP_BY_LINE, PAN_LINE, CIN_LINE = r"Ship\s*by\s+([A-Za-z][A-Za-z\s]{2,20})", r"PAN\s*(?:No\.?)?\s*[:\-]?\s*[:\s]*([A-Z]{4,5}\d{4}[A-Z])", rf"(?=[UL]\d)\b({fixed.CIN})\b"
TERMS_LINE, IFSC_LINE = r"Payment\s*Terms?\s*[:\-]?\s*([A-Za-z][A-Za-z\s]{3,50})", r"IFSC\s*(?:Code)?\s*[:\-]?\s*([A-Z]{4}[0O][A-Z0-9]{5,6})"
OA_LINE, DBA_LINE = r"OA\s*No\.?\s*[:\-]?\s*[r]?([A-Z0-9/\-]{6,25})", r"(?:DBA|OBA)\s*No\.?\s*[:\-]?\s*[fF]?([A-Z0-9/\-]{6,25})"
IRN_PAIR, IRN_LABELLED = r"([a-f0-9]{30,})\s*[-\n]\s*([a-f0-9]{10,})", r"IRN\s*\n?\s*[:\-]?\s*([a-f0-9]{64})"
#: Every field but the total in words.
EXTRACTED = [f for f in fixed.FIELDS if f != "TOTAL_WORDS"]
NOT_BANK, NOT_ITEM = "holder|number|branch|code", "certified|declaration|gst act"


def gstins(text: Column, low: Column | None = None) -> Column:
    """Distinct GSTINs in the order they first stand; bare ones within 30 characters of a transport label are left out. ``low``: the text lower-cased."""
    low = F.lower(text) if low is None else low
    none = F.array().cast("array<struct<at:int,match:string>>")

    def unplaced(found: Column) -> Column:
        """Without transport labels places don't count; labels begin with a letter, bare GSTINs with a digit."""
        label = lambda m: ~m.rlike("^[0-9]")
        known = F.transform(F.filter(found, label), lambda m: F.upper(F.right(m, F.lit(GSTIN_LONG))))
        return let(known, lambda known: F.array_distinct(F.filter(F.transform(found, lambda m: F.when(label(m) | ~F.array_contains(known, F.upper(m)), F.upper(F.right(m, F.lit(GSTIN_LONG))))), lambda g: g.isNotNull())))

    placed = lambda pattern: F.transform(match_places(text, pattern), lambda z: F.struct(z["at"].alias("at"), F.upper(find(z["match"], pattern)).alias("gstin")))
    transport = lambda pattern: F.when(low.contains("transport"), match_places(text, pattern)).otherwise(none)
    ends = F.transform(transport(TRANSPORT_ALONE), lambda z: z["at"] + F.char_length(z["match"]))
    near = F.concat(ends, F.transform(transport(TRANSPORT_GSTIN), lambda z: z["at"]))

    def merged(labelled: Column) -> Column:
        apart = lambda known, near: F.filter(placed(GSTIN_BARE), lambda z: ~F.array_contains(known, z["gstin"]) & ~F.exists(near, lambda t: F.abs(t - z["at"]) < 30))
        others = let(F.transform(labelled, lambda z: z["gstin"]), lambda known: let(near, lambda near: apart(known, near)))
        return F.array_distinct(F.transform(F.array_sort(F.concat(labelled, others)), lambda z: z["gstin"]))

    return F.when(low.contains("transport"), let(placed(GSTIN_LABELLED), merged)).otherwise(let(find_all(text, GSTIN_EITHER, 0), unplaced))


def _line_rules() -> dict:
    """Per field the function of a text that gives its value."""
    out = {f: lambda t, f=f, patterns=patterns: line_first(t, *patterns, head=HEADS.get(f)) for f, patterns in LINE_PATTERNS.items()}
    out["INV_NO"] = lambda t: line_first(t, *INV_NO_LINE, head=HEADS["INV_NO"], clean=lambda v: strip(sub(sub(strip(v), r"[.,;| ]+$", "", EXACT), "^[!|]", "I", EXACT)))
    out["INV_DATE"] = lambda t: line_first(t, *INV_DATE_LINE, head=HEADS["INV_DATE"], clean=S.normal_date)
    out["DISPATCH_DATE"] = lambda t: line_first(t, *DISPATCH_DATE_LINE, head=HEADS["DISPATCH_DATE"], clean=S.normal_date)
    out["DISPATCH_FROM"] = lambda t: line_first(t, *DISPATCH_FROM_LINE, head=HEADS["DISPATCH_FROM"], clean=strip)
    out["TRANSPORT"] = lambda t: line_first(t, *TRANSPORT_LINE, head=HEADS["TRANSPORT"], clean=lambda v: F.substring(sub(strip(v), "[.,;]+$", "", EXACT), 1, 80))
    out["SHIP_BY"] = lambda t: line_first(t, SHIP_BY_LINE, clean=lambda v: F.substring(strip(v), 1, 30))
    out["PAN"] = lambda t: F.upper(line_first(t, PAN_LINE))
    out["CIN"] = lambda t: F.upper(line_first(t, CIN_LINE))
    out["PAYMENT_TERMS"] = lambda t: line_first(t, TERMS_LINE, clean=strip)
    out["OA_NO"], out["DBA_NO"] = (lambda t, p=p: line_first(t, p, clean=S.fix_reference) for p in (OA_LINE, DBA_LINE))
    bank = lambda t: line_first(t, BANK_ALONE, clean=strip, guard=lambda v: F.length(v).between(2, 30) & ~has(v, NOT_BANK))
    out["BANK"] = lambda t: F.coalesce(strip(line_first(t, BANK_ROW_NAME)), bank(t))
    out["IFSC"] = lambda t: S.fix_ifsc(line_first(t, IFSC_LINE))
    out["UPI_ID"] = lambda t: F.substring(strip(line_first(t, UPI_LABEL, UPI_ANY, head=HEADS["UPI_ID"], guard=lambda v: ~has(v, NOT_UPI))), 1, 60)
    return out


def _place(labels: Mentioned) -> Column:
    labelled = labels.behind(("place",), lambda t: let(find(t, "(?m)" + PLACE_LABEL, 0), lambda m: S.state_name(find(m, PLACE_LABEL, 2), strip(find(m, PLACE_LABEL, 1)))))
    bare = labels.behind(("place",), lambda t: let(strip(find(t, "(?m)" + PLACE_LABEL_BARE)), lambda v: F.when(S.is_place(v), v)))
    same = labels.behind(("place",), lambda t: let(find(t, PLACE_SAME, 0), lambda m: S.state_name(find(m, PLACE_SAME, 2), find(m, PLACE_SAME, 1))))
    line = F.get(F.filter(lines_of(labels.text), lambda x: has(x, PLACE_ALONE) & ~has(x, "GSTIN|PAN|Invoice|State|Code") & S.is_place(find(x, PLACE_ALONE))), 0)
    alone = F.when(labels.has("("), let(line, lambda x: S.state_name(find(x, PLACE_ALONE, 2), strip(find(x, PLACE_ALONE)))))
    return F.coalesce(labelled, bare, same, alone)


def _parties(t: Column, tenant: bool = False, labels: Mentioned | None = None) -> dict[str, Column]:
    before, after = (fixed.TENANT_SUPPLIERS[:4], fixed.TENANT_SUPPLIERS[4:]) if tenant else ([], [])
    supplier_guard = lambda v: (F.length(v) > 4) & ~contains_any(v, fixed.NOT_SUPPLIER)
    supplier = lambda t: first_of(t, *before, *SUPPLIER_TEXT, *after, clean=lambda v: trim_tail(squeeze(v)), guard=supplier_guard)
    known = [*RECIPIENT_TEXT[:3], *fixed.TENANT_RECIPIENTS, *RECIPIENT_TEXT[3:]] if tenant else RECIPIENT_TEXT
    clean, guard = lambda v: S.cut_at(strip(v), RECIPIENT_END, 150), lambda v: (F.length(v) > 3) & ~contains_any(v, fixed.NOT_RECIPIENT)
    # tenant names may stand on any line
    narrow = labels is not None and not tenant
    got = (labels.behind(("for",), supplier), labels.first_of(list(zip(RECIPIENT_LEADS, known, strict=True)), clean=clean, guard=guard)) if narrow else (supplier(t), first_of(t, *known, clean=clean, guard=guard))
    return {"SUPPLIER": F.substring(got[0], 1, 200), "RECIPIENT": got[1]}


def _irn(labels: Mentioned) -> Column:
    joined = lambda t: let(find(t, IRN_PAIR, 0), lambda m: sub(m, "[^a-f0-9]", "", EXACT))
    return F.coalesce(labels.behind(("irn",), lambda t: find(t, IRN_LABELLED)), let(joined(labels.text), lambda j: F.when(F.length(j) >= 60, j)))


def _over(labels: Mentioned, least: float, patterns: list[str], leads: list[tuple[str, ...]]) -> Column:
    """The first pattern's amount above ``least``."""
    return labels.first_of(list(zip(leads, patterns, strict=True)), clean=lambda v: S.clean_amount(v).cast("string"), guard=lambda v: v.cast("decimal(18,4)") > least).cast("decimal(18,4)")


def _rows_of_tax(labels: Mentioned) -> dict[str, Column]:
    """What the kinds of tax rows and labels give, each pattern run once."""

    def row(t: Column, pattern: str, groups: dict[str, int]) -> Column:
        """Groups of the first match, found in the match alone."""
        return let(find(t, pattern, 0), lambda m: F.struct(*[(find(m, pattern, g) if n in ("cr", "sr", "hsn") else S.clean_amount(find(m, pattern, g))).alias(n) for n, g in groups.items()]))

    percent = lambda words, body: F.when(labels.has("%"), labels.behind(words, body) if words else body(labels.text))
    return {
        "_labelled": _over(labels, 0, TAXABLE_TEXT, TAXABLE_LEADS),
        "_tally": percent(("oo", "00"), lambda t: row(t, ROW_TALLY, {"taxable": 1, "cr": 2, "cgst": 3, "sr": 4, "sgst": 5})),
        "_row": percent((), lambda t: row(t, ROW_HSN, {"hsn": 1, "taxable": 2, "cr": 3, "cgst": 4, "sr": 5, "sgst": 6})),
        "_tax_total": F.when(labels.has("total"), labels.behind(("tax",), lambda t: row(t, ROW_TAX_TOTAL, {"first": 1}))),
        "_summary": labels.behind(("_total_tax",), lambda t: row(t, ROW_SUMMARY, {"taxable": 1, "tax": 2})),
    }


def _amount_stages(labels: Mentioned) -> list[dict[str, Column]]:
    stages = [_rows_of_tax(labels)]
    stages.append({"_sum_taxable": F.col("_summary.taxable"), "_sum_tax": F.col("_summary.tax"), "_tax_total": F.when(F.col("_tax_total.first") > 1, F.col("_tax_total.first"))})
    tally = F.col("_tally.taxable").isNotNull() & F.col("_tally.cgst").isNotNull() & F.col("_tally.sgst").isNotNull()
    row = ~tally & F.col("_row.taxable").isNotNull() & F.col("_row.cgst").isNotNull() & F.col("_row.sgst").isNotNull()
    pick = lambda name: F.when(tally, F.col(f"_tally.{name}")).when(row, F.col(f"_row.{name}"))
    below_half = lambda v: (v > 1) & (F.col("_labelled").isNull() | (v < F.col("_labelled") * 0.5))
    half = lambda name: labels.behind((name.lower(),), lambda t: first_of(t, *[p.format(name) for p in HALF_TAX], clean=lambda v: S.clean_amount(v).cast("string"), guard=lambda v: below_half(v.cast("decimal(18,4)")))).cast("decimal(18,4)")
    stages.append({
        "_v_taxable": F.coalesce("_labelled", pick("taxable"), "_sum_taxable"),
        "_v_cgst": F.coalesce(pick("cgst"), "_tax_total", half("CGST")), "_v_sgst": F.coalesce(pick("sgst"), "_tax_total", half("SGST")),
        "_v_cgst_rate": F.concat(pick("cr"), F.lit("%")), "_v_sgst_rate": F.concat(pick("sr"), F.lit("%")), "_row_hsn": F.when(row, F.col("_row.hsn")),
        "_row_gst": F.coalesce(pick("cgst") + pick("sgst"), F.col("_tax_total") * 2, "_sum_tax"),
    })
    total_words = labels.first_of(list(zip(WORDS_LEADS, TOTAL_WORDS_TEXT, strict=True)), clean=lambda v: S.words_to_number(v).cast("string"), guard=lambda v: v.cast("long") > 100)
    stages.append({
        "_v_igst": F.when(F.col("_v_cgst").isNull() & F.col("_v_sgst").isNull(), _over(labels, 50, IGST_TEXT, IGST_LEADS)),
        "_v_total_gst": F.coalesce("_row_gst", _over(labels, 1, TOTAL_GST_TEXT, TOTAL_GST_LEADS)),
        "_v_total": F.coalesce(_over(labels, 99.9999, TOTAL_TEXT, TOTAL_LEADS), total_words.cast("decimal(18,4)")),
    })
    stages.append({"_v_total": F.coalesce("_v_total", F.round(F.col("_v_taxable") + F.col("_v_total_gst"), 2))})
    return stages


def _rate_stages(labels: Mentioned) -> list[dict[str, Column]]:
    found = {f: labels.first_of(list(zip(RATE_LEADS[f], p, strict=True)), guard=lambda v: v.cast("int").between(1, 100), clean=lambda v: F.substring(v, 1, 9)) for f, p in RATE_TEXT.items()}
    stages = [{f"_{f}": F.coalesce(*([F.col(f"_v_{f.lower()}")] if f in ("CGST_RATE", "SGST_RATE") else []), F.concat(v, F.lit("%"))) for f, v in found.items()}]
    both = S.show_rate(F.floor(S.rate_of(F.col("_CGST_RATE")) + S.rate_of(F.col("_SGST_RATE"))))
    stages.append({"_GST_RATE": F.coalesce("_GST_RATE", F.when(F.col("_SGST_RATE").isNotNull(), both), "_IGST_RATE")})
    halved = F.when(F.col("_CGST_RATE").isNull() & F.col("_IGST_RATE").isNull(), S.show_rate(S.rate_of(F.col("_GST_RATE")) / 2))
    return [*stages, {"_SGST_RATE": F.coalesce("_SGST_RATE", halved), "_CGST_RATE": F.coalesce("_CGST_RATE", halved)}]


def hsn_codes(text: Column, taken: Column) -> Column:
    """HSN codes in order: labelled and in table rows, else alone on a line; years and taken numbers are none."""
    low = F.lower(text)
    printed = F.when(low.contains("hsn") | low.contains("sac"), find_all(text, HSN_LABELLED)).otherwise(F.array().cast("array<string>"))
    labelled = F.array_distinct(F.concat(printed, find_all(text, HSN_ROW)))
    excluded = const_array(fixed.EXCLUDED_NUMBERS)
    alone = F.filter(F.array_except(F.array_distinct(find_all(text, HSN_ALONE)), excluded), lambda c: ~F.array_contains(taken, c))
    # the text is searched for labels once, not for the test and again for the codes
    found = let(F.array_except(labelled, excluded), lambda known: F.when(F.size(known) > 0, known).otherwise(alone))
    return F.filter(found, lambda c: F.length(c).between(4, 6) & ~c.rlike(r"^(19|20)\d{2}$") & ~F.array_contains(taken, c) & ~((F.length(c) == 6) & (c.cast("int") > 99999)) & ~((F.length(c) == 5) & c.startswith("1") & (c.cast("int") > 19999)))


def _item_stages(t: Column) -> list[dict[str, Column]]:
    taken = F.filter(F.array(F.substring("_TRANSPORT_ID", 1, 8), F.when(F.col("_DISPATCH_FROM").rlike(r"^\d{3,6}$"), F.col("_DISPATCH_FROM")), F.col("_VENDOR_CODE")), lambda x: x.isNotNull())
    stages = [{"_codes": hsn_codes(t, taken)}]
    quantity = first_of(t, QTY_TOTAL, QTY_ROW, QTY_ANY, guard=lambda v: (v.cast("int") < 1000) & ~F.array_contains(F.col("_codes"), v), clean=lambda v: v.cast("int").cast("string"))
    rows = F.filter(F.transform(find_all(t, DESC_ROW), lambda x: strip(x)), lambda d: ~has(d, NOT_ITEM) & (d != ""))
    service = let(mentioning(t, ("9987",), squeeze(find(t, DESC_SERVICE))), lambda d: F.when(F.length(d) > 3, F.array(d)).otherwise(F.array().cast("array<string>")))
    described = F.array_distinct(F.concat(rows, service))
    stages.append({
        "_HSN": F.coalesce("_row_hsn", blank_to_null(F.array_join(F.slice("_codes", 1, 3), ", "))),
        "_QTY": quantity, "_UOM": F.initcap(find(t, UOM_TEXT)),
        "_RATE": first_of(t, *RATE_ALONE, clean=lambda v: S.show(S.clean_amount(v)), guard=lambda v: v.cast("decimal(18,4)") < 10000000),
        "_ITEM_DESC": F.substring(blank_to_null(F.array_join(F.slice(described, 1, 3), " | ")), 1, 250),
    })
    return stages


def _stages(tenant: bool) -> list[dict[str, Column]]:
    """All rules as columns of a text _t, in stages of which each uses what the ones before gave."""
    t = F.col("_t")
    labels = Mentioned(t, F.col("_low"))
    # of a text that is absent no rule is evaluated
    given = lambda value: F.when(t.isNotNull(), value)
    by_line = {f"_{f}": labels.behind(MENTIONS[f], rule) for f, rule in _line_rules().items()}
    pair = F.col("_gstin_pan")
    by_text = {"_gstins": gstins(t, labels.low), "_PLACE": _place(labels), "_IRN": _irn(labels), "_gstin_pan": F.when(labels.has("pan"), labels.behind(("gstin",), lambda t: find(t, GSTIN_PAN, 0)))} | {f"_{k}": v for k, v in _parties(t, tenant, labels).items()}
    parties = {"_GSTIN_S": F.get("_gstins", 0), "_GSTIN_R": F.coalesce(F.get("_gstins", 1), F.nullif(F.upper(find(pair, GSTIN_PAN, 1)), F.get("_gstins", 0)), F.when(pair.isNotNull(), F.upper(find(t, GSTIN_TWICE)))), "_RECIPIENT_PAN": F.upper(find(pair, GSTIN_PAN, 2))}
    shown = {f"_{f}": S.show(F.col(f"_v_{f.lower()}")) for f in ("TAXABLE", "CGST", "SGST", "IGST", "TOTAL_GST", "TOTAL")}
    total_tax = {"_total_tax": F.when(labels.has("total"), has(t, TOTAL_TAX))}
    rules = [by_line | by_text | total_tax, *_amount_stages(labels), *_rate_stages(labels), parties | shown, *_item_stages(t), {"_STATE_CODE": F.coalesce("_STATE_CODE", S.state_code(F.col("_GSTIN_S")))}]
    # token markers are beyond ASCII, and what rules add is ASCII
    clean = lambda f: F.when(F.col("_ascii") | ~has(strip(F.col(f"_{f}")), fixed.TOKEN_MARKERS, EXACT), blank_to_null(F.col(f"_{f}")))
    return [{"_low": F.lower(t), "_ascii": F.octet_length(t) == F.char_length(t)}, *[{f: given(v) for f, v in stage.items()} for stage in rules], {f"_{f}": given(clean(f)) for f in EXTRACTED}]


def _extracted(df: DataFrame, text: str, into: str, tenant: bool) -> DataFrame:
    """df with a column ``<into>_<field>`` for each field."""
    out = df.withColumn("_t", F.col(text))
    for stage in once(_stages, tenant):
        out = out.withColumns(stage)
    return out.select(*df.columns, *[F.col(f"_{f}").alias(f"{into}_{f}") for f in EXTRACTED])


def full_extract(df: DataFrame, text: str, into: str, tenant: bool = False) -> DataFrame:
    """df with a struct column ``into`` of all extracted fields (null where absent). Null text gives all null. Columns of df that begin with an underscore may not be named like the rules' own."""
    out = _extracted(df, text, "_x", tenant)
    return out.select(*df.columns, F.when(F.col(text).isNotNull(), F.struct(*[F.col(f"_x_{f}").alias(f) for f in EXTRACTED])).alias(into))


def two_pass(df: DataFrame, text: str = "raw_text", tenant: bool = False, strict: bool = False) -> DataFrame:
    """df with one column per field: what the repaired text gives first, then what the raw text gives."""
    before = df.columns
    df = df.withColumn("_plain_text", plain_spaces(F.col(text)))
    repaired = once(lambda *how: S.fix_noise(F.col("_plain_text"), *how), tenant, strict)
    df = _extracted(df.withColumn("_clean_text", repaired), "_clean_text", "_a", tenant)
    # where repair changed nothing the second pass would find the same again
    df = _extracted(df.withColumn("_raw_text", F.when(F.col("_clean_text") != F.col("_plain_text"), F.col("_plain_text"))), "_raw_text", "_b", tenant)
    return df.select(*before, *[F.coalesce(F.col(f"_a_{f}"), F.col(f"_b_{f}")).alias(f) for f in EXTRACTED])

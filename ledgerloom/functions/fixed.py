"""Names, codes, word lists and formats that results depend on. No logic here."""

# ---- states ----

STATES = {
    "01": "Jammu & Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana", "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar",
    "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland", "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand",
    "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "25": "Daman & Diu", "26": "Dadra & Nagar Haveli", "27": "Maharashtra", "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa",
    "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry", "35": "Andaman & Nicobar", "36": "Telangana", "37": "Andhra Pradesh (New)",
}
#: Where a supplier's state is compared with the place of supply, code 37 has no suffix.
STATES_FOR_TAX = {k: v.lower() for k, v in STATES.items()} | {"37": "andhra pradesh"}
PLACE_WORDS = [
    "jammu", "kashmir", "himachal", "punjab", "chandigarh", "uttarakhand", "haryana", "delhi", "new delhi", "rajasthan", "bihar", "sikkim", "nagaland", "manipur", "mizoram", "tripura", "meghalaya", "assam", "bengal",
    "jharkhand", "odisha", "chhattisgarh", "gujarat", "maharashtra", "andhra", "karnataka", "goa", "lakshadweep", "kerala", "telangana",
]

# ---- numbers ----

EXCLUDED_NUMBERS = ["2017", "2018", "2019", "2020", "2021", "2022", "2023", "2024", "2025", "2026", "1319", "1972", "330411", "1328", "0724", "1384", "29338", "987654321"]
EXCLUDED_NUMBERS_V1 = ["2017", "2018", "2019", "2020", "2021", "2022", "2023", "2024", "2025", "2026", "1319", "1972", "0724", "1384"]
UNITS = ["", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen", "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen"]
TENS = ["", "", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety"]
#: Misread number words and their values.
MISREAD_WORDS = {"tltty": 50, "titty": 50, "tifty": 50, "fitty": 50, "ttty": 50, "mght": 8, "nght": 8, "aight": 8, "rune": 9, "nune": 9, "sovcnty": 70, "sevcnty": 70, "soventy": 70, "su": 6}
MULTIPLIERS = {"hundred": 100, "thousand": 1000, "lakh": 100000, "lac": 100000, "crore": 10000000}
CGST_SNAP, IGST_SNAP, GST_SNAP = [5, 9, 12, 14, 18, 28], [5, 12, 18, 28], [5, 12, 18, 28]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# ---- fields ----

SECTIONS = {
    "Supplier Details": {"SUPPLIER": "Supplier Name", "GSTIN_S": "GSTIN", "PAN": "PAN", "CIN": "CIN", "STATE_CODE": "State Code", "SERVICE_TAX": "Service Tax No.", "FSSAI": "FSSAI", "LUT_BOND": "LUT Bond", "MSME_NO": "MSME No.", "TAN": "TAN"},
    "Buyer / Recipient": {"RECIPIENT": "Recipient Name", "GSTIN_R": "Recipient GSTIN", "RECIPIENT_PAN": "Recipient PAN", "PLACE": "Place of Supply", "VENDOR_CODE": "Vendor Code"},
    "Invoice Details": {
        "INV_NO": "Invoice No.", "INV_DATE": "Invoice Date", "IRN": "IRN", "ACK_NO": "Ack No.", "ACK_DATE": "Ack Date", "CHALLAN_NO": "Challan No.", "CHALLAN_DATE": "Challan Date", "EWAY_BILL": "E-Way Bill", "TRANSPORT": "Transport",
        "TRANSPORT_ID": "Transport ID", "VEHICLE_NO": "Vehicle No.", "SHIP_BY": "Ship By", "DISPATCH_FROM": "Dispatch From", "DISPATCH_DATE": "Dispatch Date", "CUST_ORDER": "Cust. Order No.", "OA_NO": "OA No.", "OA_DATE": "OA Date",
        "DBA_NO": "DBA No.", "DBA_DATE": "DBA Date", "PAYMENT_TERMS": "Payment Terms",
    },
    "Item / Goods": {"HSN": "HSN / SAC Code", "ITEM_DESC": "Description", "QTY": "Quantity", "UOM": "Unit", "RATE": "Rate (₹)", "GST_RATE": "GST Rate %"},
    "Tax & Amounts": {
        "TAXABLE": "Taxable Value (₹)", "CGST_RATE": "CGST Rate %", "CGST": "CGST (₹)", "SGST_RATE": "SGST Rate %", "SGST": "SGST (₹)", "IGST_RATE": "IGST Rate %", "IGST": "IGST (₹)", "TOTAL_GST": "Total GST (₹)", "TOTAL": "Net Payable (₹)", "TOTAL_WORDS": "In Words",
    },
    "Bank & Payment": {"BANK": "Bank", "AC_NO": "Account No.", "IFSC": "IFSC", "UPI_ID": "UPI ID"},
}
FIELDS = [f for s in SECTIONS.values() for f in s]
#: Fields the detection score counts.
SCORED = [f for f in FIELDS if f != "TOTAL_WORDS"] + ["DELIVERY_ADDR", "MODE_OF_DISPATCH", "DISCOUNT"]
REGISTER = ["SUPPLIER", "GSTIN_S", "RECIPIENT", "GSTIN_R", "INV_NO", "INV_DATE", "PLACE", "TAXABLE", "CGST", "SGST", "IGST", "TOTAL_GST", "TOTAL", "BANK", "IFSC", "HSN", "QTY", "UOM", "RATE"]
REGISTER_SUMS = ["TAXABLE", "CGST", "SGST", "IGST", "TOTAL_GST", "TOTAL"]
AMOUNTS = ["TAXABLE", "CGST", "SGST", "IGST", "TOTAL", "TOTAL_GST", "RATE", "DISCOUNT"]
RATES = ["CGST_RATE", "SGST_RATE", "IGST_RATE", "GST_RATE"]
LABELS = ["O"] + [f"{p}-{f}" for f in ("GSTIN_S", "GSTIN_R", "INV_NO", "INV_DATE", "TAXABLE", "CGST", "SGST", "IGST", "TOTAL", "HSN", "ITEM_DESC", "SUPPLIER", "RECIPIENT", "PLACE", "RATE", "QTY", "CGST_RATE", "SGST_RATE") for p in "BI"]
VALID_HSN = ["1005", "4017", "8302", "9987", "9988", "8471", "8523", "8524", "9983", "9984", "9985", "9986", "0101", "3004", "3305", "6109", "6203", "7214", "7308", "8414", "8482", "8544", "9506"]
UPLOAD_SUFFIXES = ["pdf", "jpg", "jpeg", "png", "tiff", "tif", "webp", "bmp"]
UPLOAD_BYTES, UPLOAD_FILES = 20 * 1024 * 1024, 20

# ---- formats (regular expressions) ----

GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}"
GSTIN_STRICT = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]"
PAN = r"[A-Z]{5}\d{4}[A-Z]"
CIN = r"[UL]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}"
ANY_DATE = r"\d{1,2}[-/\.]\w{2,9}[-/\.]\d{2,4}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
MARKER_CHARS = r"[Ġ▁�ġĀ‘’“”]"
TOKEN_MARKERS = r"[Ġ▁�]"
FAKE_PATTERNS = ["AAAAA0000A", r"Insert\s+Logo", "ExcelDataPro", "DO/MMYYYY", "TRAINING USE ONLY", "Wear Your Opinion", "GogstBill", "Street Address, Phone 1234567890", "ABC Building, DEF Street", "Your Company Name", "SAMPLE INVOICE", "TEST INVOICE", "dummy", "000-000-0000"]
FAKE_GSTIN = "AAAAA|0000A"

# ---- block lists ----

NOT_SUPPLIER = ["certified", "declaration", "authorised", "consignee", "buyer", "bill to", "we declare", "original for", "billing made easier", "in words"]
NOT_RECIPIENT = ["same state", "client name", "ship to", "bill to", "consignee", "buyer", "dispatch", "destination", "kochi", "kerala - ", "mumbai", "bangalore"]
NOT_RECIPIENT_LATE = ["customer order", "invoice no", "delivery address", "gstin", "1692", "invoice date", "same state gst", "same state other", "client name", "dispatched", "destination", "billing made easier", "tax invoice in", "original for", "kochi", "kerala - ", "mumbai"]
NOT_DESCRIPTION = ["certified", "particulars", "tax invoice", "true and correct", "gst act", "registration", "suspension", "declaration", "authorised signatory", "sp charges@", "charges@"]

# ---- noise rules: (pattern, replacement, scope) in order; scope tenant: one company's papers, off by default ----

NOISE = [
    (r"\b(\d{2}[A-Z]{1,4})0([A-Z]{1,4}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b", "$1O$2", "generic"),
    (r"\b(\d{2}[A-Z]{5}\d{4})8([1-9A-Z]Z[0-9A-Z])\b", "$1B$2", "generic"),
    (r":\s*2Q([A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])", ": 29$1", "generic"),
    (r"[!|]TBG/(\d{2}-\d{2})/(\d{4})11([A-Z]{2})/(\d{4})", "ITBG/$1/$2/$3/$4", "tenant"),
    (r"[!|]T8G/", "ITBG/", "tenant"),
    (r"(\d{4})A([A-Z]{2})/(\d{4})", "$1/$2/$3", "tenant"),
    (r"(ITBG/\d{2}-\d{2}/\d{4})\s*\n\s*([\dA-Z]{0,2}TP/\d{4})", "$1/TP/$2", "tenant"),
    (r"[!|]TBG/(\d{2}-\d{2}/\d+)", "ITBG/$1", "tenant"),
    (r"(ITBG/[\d\-/A-Z]+)\s+I\b", "$1", "tenant"),
    (r"\b(\d{2})/0a/(\d{4})\b", "$1/08/$2", "generic"),
    (r"\b(\d{2})[JjIil](\d{2})(\d{4})\b", "$1/$2/$3", "generic"),
    (r"\b(\d{2}/\d{2})(\d{4})\b", "$1/$2", "generic"),
    ("-Ju-", "-Jul-", "generic"),
    ("-Ja-", "-Jan-", "generic"),
    ("-Fe-", "-Feb-", "generic"),
    (r"-Ma-(?=\d)", "-Mar-", "generic"),
    ("-Ap-", "-Apr-", "generic"),
    ("-Au-", "-Aug-", "generic"),
    ("-Se-", "-Sep-", "generic"),
    ("-Oc-", "-Oct-", "generic"),
    ("-No-", "-Nov-", "generic"),
    ("-De-", "-Dec-", "generic"),
    ("ICICOQ", "pad", "ifsc"),
    (r"\bICICO(\d{6})\b", "ICIC0$1", "generic"),
    (r"\bICICO(\d{2}[A-Z])\b", "ICIC0$1", "generic"),
    (r"\bIClCl\b", "ICICI", "generic"),
    (r"\bIClC0", "ICIC0", "generic"),
    (r"\bIClC(\d)", "ICIC$1", "generic"),
    (r"Account\s*Number\s*;", "Account Number:", "generic"),
    (r"A/e\s*No\.?", "A/c No.", "generic"),
    (r"[%€\$¥¢]\s*(\d)", "$1", "currency"),
    (r"\b(\d{4}),(\d{2})\b", "$1.$2", "generic"),
    (r"\bAA8CK(\d{4}[A-Z])\b", "AABCK$1", "tenant"),
    (r"(KERALA[^\n]{0,50})in\s+words\s*:\s*(DEVELOPMENT[^\n]{0,50})", "$1 $2", "tenant"),
    (r"(?<![\d%])%([0-9]{1,2})(?![%\d])", "$1%", "percent"),
    (r"\blnvoice\b", "Invoice", "generic"),
    (r"\bInvolce\b", "Invoice", "generic"),
    (r"\b!([A-Z]{2,})", "I$1", "generic"),
    (r"\bflet\b", "Net", "generic"),
    (r"\bNlNETY\b", "NINETY", "generic"),
    (r"\b(27AAFCV2449G1)27\b", "$1Z7", "tenant"),
]
#: Lower-case texts of which a rule's match has one; rules that aren't here can match where digits are.
NOISE_NEEDS = {
    r":\s*2Q([A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z])": ["2q"],
    r"[!|]TBG/(\d{2}-\d{2})/(\d{4})11([A-Z]{2})/(\d{4})": ["tbg/"],
    r"[!|]T8G/": ["t8g/"],
    r"(ITBG/\d{2}-\d{2}/\d{4})\s*\n\s*([\dA-Z]{0,2}TP/\d{4})": ["itbg/"],
    r"[!|]TBG/(\d{2}-\d{2}/\d+)": ["tbg/"],
    r"(ITBG/[\d\-/A-Z]+)\s+I\b": ["itbg/"],
    r"\b(\d{2})/0a/(\d{4})\b": ["/0a/"],
    "-Ju-": ["-ju-"],
    "-Ja-": ["-ja-"],
    "-Fe-": ["-fe-"],
    r"-Ma-(?=\d)": ["-ma-"],
    "-Ap-": ["-ap-"],
    "-Au-": ["-au-"],
    "-Se-": ["-se-"],
    "-Oc-": ["-oc-"],
    "-No-": ["-no-"],
    "-De-": ["-de-"],
    "ICICOQ": ["icicoq"],
    r"\bICICO(\d{6})\b": ["icico"],
    r"\bICICO(\d{2}[A-Z])\b": ["icico"],
    r"\bIClCl\b": ["iclcl"],
    r"\bIClC0": ["iclc0"],
    r"\bIClC(\d)": ["iclc"],
    r"Account\s*Number\s*;": [";"],
    r"A/e\s*No\.?": ["a/e"],
    r"[%€\$¥¢]\s*(\d)": ["%", "€", "$", "¥", "¢"],
    r"\b(\d{4}),(\d{2})\b": [","],
    r"\bAA8CK(\d{4}[A-Z])\b": ["aa8ck"],
    r"(KERALA[^\n]{0,50})in\s+words\s*:\s*(DEVELOPMENT[^\n]{0,50})": ["kerala"],
    r"(?<![\d%])%([0-9]{1,2})(?![%\d])": ["%"],
    r"\blnvoice\b": ["lnvoice"],
    r"\bInvolce\b": ["involce"],
    r"\b!([A-Z]{2,})": ["!"],
    r"\bflet\b": ["flet"],
    r"\bNlNETY\b": ["nlnety"],
    r"\b(27AAFCV2449G1)27\b": ["27aafcv2449g127"],
}
NOISE_V1 = [
    (r"(Invoice\s*Date\s*[:\.]?\s*)(\d{2})[JjIil](\d{2})1?(\d{4})", "$1$2/$3/$4"),
    (r"\b(\d{2})[JjIil](\d{2})1?(\d{4})\b", "$1/$2/$3"),
    (r"\b(\d{3,6})\s+9[(\[{]", "$1.97"),
    (r"\b(\d{2,4})\s+(\d{2})\b", "$1.$2"),
    (r"\b(\d{4}),(\d{2})\b", "$1.$2"),
    (r"\blnvoice\b", "Invoice"),
    (r"\b!([A-Z]{2,})", "I$1"),
    (r"Ne\\+", "Net"),
    (r"\bflet\b", "Net"),
    (r"Ass[ae]+ss?[ao]+ble", "Assessable"),
    (r"\btl?[ti]tty\b", "fifty"),
    (r"\brune\b", "nine"),
    (r"\bsovcnty\b", "seventy"),
    (r"\b[mn]ght\b", "eight"),
    (r"(\d{4})11([A-Z]{2})", "$1/$2"),
    (r"AA8CK(\d{4}[A-Z])", "AABCK$1"),
    (r"%(\d)", "₹$1"),
]
#: As NOISE_NEEDS, for the older rules.
NOISE_NEEDS_V1 = {
    r"(Invoice\s*Date\s*[:\.]?\s*)(\d{2})[JjIil](\d{2})1?(\d{4})": ["date"],
    r"\blnvoice\b": ["lnvoice"],
    r"\b!([A-Z]{2,})": ["!"],
    r"Ne\\+": ["ne\\"],
    r"\bflet\b": ["flet"],
    r"Ass[ae]+ss?[ao]+ble": ["ass"],
    r"\btl?[ti]tty\b": ["tty"],
    r"\brune\b": ["rune"],
    r"\bsovcnty\b": ["sovcnty"],
    r"\b[mn]ght\b": ["ght"],
    r"AA8CK(\d{4}[A-Z])": ["aa8ck"],
    r"%(\d)": ["%"],
}

# ---- names of single companies, looked for only where a caller asks for tenant rules; the first four come before the general rule ----

TENANT_SUPPLIERS = [
    r"[Ff]or\s+(Surabhi\s+Hardwares[^\n]{0,30})",
    r"[Ff]or\s+(KERALA\s+STATE\s+ELECTRONICS[^\n]{0,80}(?:LTD|LIMITED)\.?)",
    r"[Ff]or\s+(Gujarat\s+Freight\s+Tools[^\n]{0,20})",
    r"[Ff]or\s+(V\s+K\s+Control\s+System[^\n]{0,40})",
    r"(?m)^(Gujarat\s+Freight\s+Tools)\s*[.\s]*$",
    r"(?m)^(V\s+K\s+Control\s+System\s+Private\s+Limited)[\s.]*$",
    r"(?m)^(Surabhi\s+Hardwares[^\n]{0,40})",
]
TENANT_RECIPIENTS = [r"Sold\s*To\s*[^\n]{0,10}\n\s*(30\s+K\s+BN[^\n]{5,80})"]

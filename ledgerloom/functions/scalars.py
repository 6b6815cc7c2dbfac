"""Scalar functions on columns: amounts, dates, number words, identifiers, repairs, JSON.

Amounts are decimal(18,2) or decimal(18,4), rounded half up; unreadable values are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import EXACT, FOLDED, blank_to_null, const_array, const_map, find, first_of, has, let, squeeze, strip, sub, trim_tail

MONEY = "decimal(18,2)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Numbers that are the same decimal with and without a double between.
PLAIN = r"^\d{1,11}(\.\d{1,4})?$"


def to_decimal(t: Column) -> Column:
    """as_number of a stripped text that costs nothing to name twice."""
    return F.when(t.rlike(PLAIN), t.try_cast("decimal(18,4)")).when(t.rlike(NUMBER), t.try_cast("double").try_cast("decimal(18,4)"))


def as_number(c: Column) -> Column:
    """decimal(18,4) of a plain number, null otherwise (Spark alone would also read '5d')."""
    return let(strip(c), to_decimal)


def _bare(c: Column) -> Column:
    return sub(c, r"[₹€\$¥¢%\+]", "", EXACT)


def clean_amount(c: Column, excluded: list[str] = fixed.EXCLUDED_NUMBERS) -> Column:
    """An amount above 0 without currency signs, brackets and commas; the excluded numbers are none."""
    s = strip(_bare(c))
    s = sub(sub(s, r"^[|(\[]+", "", EXACT), r"[|)\]]+$", "", EXACT)
    return let(strip(F.replace(s, F.lit(","), F.lit(""))), lambda t: let(as_number(t), lambda n: F.when(~t.isin(excluded) & (n > 0), n)))


def to_amount(c: Column) -> Column:
    """Any number without currency signs and commas."""
    return let(c, lambda t: F.when(t.rlike(PLAIN), t.try_cast("decimal(18,4)")).otherwise(as_number(strip(F.replace(_bare(t), F.lit(","), F.lit(""))))))


def parse_amount(c: Column) -> Column:
    """The older parser: also without white space and a leading Rs or INR; above 0, not excluded."""
    s = sub(sub(c, r"[₹%\s]", "", EXACT), r"^(?:Rs\.?|INR)", "")
    return let(F.replace(strip(s), F.lit(","), F.lit("")), lambda t: let(as_number(t), lambda n: F.when(~t.isin(fixed.EXCLUDED_NUMBERS_V1) & (n > 0), n)))


def loose_number(c: Column) -> Column:
    """Commas, white space and signs dropped, then a number."""
    return as_number(sub(c, r"[,\s₹%]", "", EXACT))


def show(c: Column, decimals: int = 2) -> Column:
    """Text with a fixed number of decimals, half up; null stays null."""
    return F.round(c, decimals).cast(f"decimal(18,{decimals})").cast("string")


def show_rate(c: Column) -> Column:
    """'9%', or '2.5%' where the rate has a fraction."""
    text = sub(sub(c.cast("decimal(9,2)").cast("string"), r"0+$", "", EXACT), r"\.$", "", EXACT)
    return F.concat(text, F.lit("%"))


def rate_of(c: Column) -> Column:
    """The number of a rate like '9%'."""
    return as_number(sub(c, "%+$", "", EXACT))


def close(a: Column, b: Column, share: float) -> Column:
    """Whether two amounts differ by at most a share of the larger; false where one is null or 0."""
    apart = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(share).cast("decimal(9,4)")
    return F.coalesce((a != 0) & (b != 0) & apart, F.lit(False))


# ---- number words ----


def words_to_number(c: Column) -> Column:
    """Value of Indian number words, misread ones among them; null where they give 0."""
    ones = {u.lower(): i for i, u in enumerate(fixed.UNITS) if u} | {t.lower(): 10 * i for i, t in enumerate(fixed.TENS) if t} | {"zero": 0} | fixed.MISREAD_WORDS
    value = F.transform_values(const_map({k: str(v) for k, v in ones.items()}), lambda k, v: v.cast("int"))
    times = F.transform_values(const_map({k: str(v) for k, v in fixed.MULTIPLIERS.items()}), lambda k, v: v.cast("int"))
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("sum"))

    def step(state: Column, word: Column) -> Column:
        one, many = F.element_at(value, word), F.element_at(times, word)
        now, total = state["now"], state["sum"]
        some = F.when(now == 0, F.lit(1)).otherwise(now)
        return F.struct(
            F.when(one.isNotNull(), now + one).when(many == 100, some * 100).when(many.isNotNull(), F.lit(0)).otherwise(now).cast("long").alias("now"),
            F.when(many > 100, total + some * many).otherwise(total).cast("long").alias("sum"),
        )

    return F.nullif(F.aggregate(words, zero, step, lambda s: s["now"] + s["sum"]), F.lit(0))


def _say(n: Column) -> Column:
    """Words of 1 to 999; empty for 0."""
    units, tens = const_array(fixed.UNITS), const_array(fixed.TENS)
    below = lambda m: F.when(m < 20, F.get(units, m)).otherwise(F.concat_ws(" ", F.get(tens, F.floor(m / 10).cast("int")), blank_to_null(F.get(units, m % 10))))
    n = n.cast("int")
    hundreds = F.floor(n / 100).cast("int")
    return F.when(n < 100, below(n)).otherwise(F.concat_ws(" ", F.get(units, hundreds), F.lit("Hundred"), blank_to_null(below(n % 100))))


def number_to_words(c: Column) -> Column:
    """'One Lakh Two Thousand Rupees and Five Paise Only'; null from 1000 crore on, for 0 and for null."""
    paise_all = F.round(c * 100, 0).cast("decimal(20,0)")
    rupees, paise = F.floor(paise_all / 100).cast("long"), (paise_all % 100).cast("int")
    parts = [
        (F.floor(rupees / 10000000) % 1000, " Crore"),
        (F.floor(rupees / 100000) % 100, " Lakh"),
        (F.floor(rupees / 1000) % 100, " Thousand"),
        (rupees % 1000, ""),
    ]
    said = F.concat_ws(" ", *[F.when(n > 0, F.concat(_say(n), F.lit(unit))) for n, unit in parts])
    whole = F.when(rupees == 0, F.lit("Zero")).otherwise(said)
    text = F.concat(whole, F.lit(" Rupees"), F.when(paise > 0, F.concat(F.lit(" and "), _say(paise), F.lit(" Paise"))).otherwise(F.lit("")), F.lit(" Only"))
    return F.when((c > 0) & (rupees < 10000000000), text)


# ---- dates ----


def normal_date(c: Column) -> Column:
    """The newer form: text cleaned, two-digit years of named months expanded, years 2000 to 2030 only."""

    def cleaned(s: Column) -> Column:
        s = sub(s, r"\s*[-–]\s*", "-", EXACT)
        s = sub(s, r"^(\d{2})[JjIil](\d{2})(\d{4})$", "$1/$2/$3", EXACT)
        s = sub(s, r"^(\d{2})(\d{2})(\d{4})$", "$1/$2/$3", EXACT)
        s = sub(s, r"^(\d{2}/\d{2})(\d{4})$", "$1/$2", EXACT)
        return let(s, lambda x: F.when(has(x, r"^\d{1,2}-[A-Za-z]{3,9}-\d{2}$", EXACT), F.concat(F.substr(x, F.lit(1), F.length(x) - 2), F.lit("20"), F.right(x, F.lit(2)))).otherwise(x))

    def checked(x: Column) -> Column:
        year = find(x, r"(\d{4})", flags=EXACT).cast("int")
        return F.when(let(year, lambda y: y.isNull() | y.between(2000, 2030)) & has(x, fixed.ANY_DATE, EXACT), x)

    return let(strip(c), lambda t: F.when(~has(t, r"[^\w\s\-/\.]", EXACT), let(cleaned(t), checked)))


def slash_date(c: Column) -> Column:
    """The older form: DD/MM/YYYY from named or numbered months; impossible years are null, unknown forms stay."""
    s = sub(strip(c), r"\s*-\s*", "-", EXACT)
    months = F.create_map(*[F.lit(x) for i, m in enumerate(fixed.MONTHS) for x in (m, f"{i + 1:02d}")])
    named = r"^(\d{1,2})[-/\s](" + "|".join(fixed.MONTHS) + r")[a-z]*[-/\s](\d{2,4})$"
    plain, run = r"^(\d{1,2})[/\-\.](\d{1,2})[/\-\.](\d{2,4})$", r"^(\d{2})(\d{2})(\d{4})$"

    def made(pattern: str, month: Column, keep_bad: bool) -> Column:
        year = find(s, pattern, 3)
        year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
        out = F.concat_ws("/", F.lpad(find(s, pattern, 1), 2, "0"), F.lpad(month, 2, "0"), year)
        good = year.cast("int").between(2000, 2030)
        return F.when(good, out).otherwise(s if keep_bad else F.lit(None))

    by_name = made(named, F.element_at(months, F.lower(find(s, named, 2))), False)
    return blank_to_null(F.when(has(s, named), by_name).when(has(s, plain), made(plain, find(s, plain, 2), False)).when(has(s, run), made(run, find(s, run, 2), True)).otherwise(s))


def record_date(c: Column) -> Column:
    """The older record pass over a date field: like slash_date, but an impossible year only blanks unknown forms."""
    s = sub(strip(c), r"\s*[-/]\s*", "-", EXACT)
    named = r"^\d{1,2}-(?:" + "|".join(fixed.MONTHS) + r")[a-z]*-\d{2,4}$"
    short = r"^\d{1,2}-\d{1,2}-\d{2}$"
    year = find(s, r"(\d{4})", flags=EXACT).cast("int")
    return F.when(has(s, named), F.coalesce(slash_date(s), c)).when(has(s, short), slash_date(s)).when(year.isNull() | year.between(2000, 2030), c)


# ---- identifiers ----


def is_gstin(c: Column, strict: bool = False) -> Column:
    return has(c, f"^{fixed.GSTIN_STRICT if strict else fixed.GSTIN}$")


def state_code(gstin: Column) -> Column:
    """The two digits a GSTIN begins with."""
    return find(gstin, r"^(\d{2})", flags="")


def state_name(code: Column, otherwise: Column | None = None) -> Column:
    names = const_map(fixed.STATES)
    return F.coalesce(F.element_at(names, code), otherwise) if otherwise is not None else F.element_at(names, code)


def state_for_tax(code: Column) -> Column:
    names = const_map(fixed.STATES_FOR_TAX)
    return F.element_at(names, code)


def is_place(c: Column) -> Column:
    """Whether a lower-cased place and a known one contain each other, either way."""
    known = const_array(sorted({*fixed.STATES_FOR_TAX.values(), *fixed.PLACE_WORDS}))
    low = F.lower(strip(c))
    return F.exists(known, lambda k: k.contains(low) | low.contains(k))


def eight_to_b(pan: Column) -> Column:
    """The third character of a PAN read as B where it is 8."""
    return F.when(F.substring(pan, 3, 1) == "8", F.concat(F.substring(pan, 1, 2), F.lit("B"), F.substring(pan, 4, 100))).otherwise(pan)


def fix_pan(pan: Column, raw: Column) -> Column:
    """A valid PAN after repair, else one from the raw text."""
    own = F.upper(pan)
    labelled = [eight_to_b(F.upper(find(raw, p))) for p in (r"PAN\s*(?:No\.?)?\s*[:\-]?\s*([A-Z]{5}\d{4}[A-Z])", r"PAN\s*[:\-]?\s*([A-Z]{4,5}\d{4}[A-Z])")]
    valid = lambda c, p=fixed.PAN: F.when(has(c, f"^{p}$", EXACT), c)
    return F.coalesce(valid(eight_to_b(own)), valid(own), valid(labelled[0]), valid(labelled[1], r"[A-Z]{4,5}\d{4}[A-Z]"))


def fix_pan_v1(pan: Column, raw: Column) -> Column:
    repaired = sub(pan, r"([A-Z]{2})8([A-Z]{2}\d{4}[A-Z])", "$1B$2", EXACT)
    found = [eight_to_b(F.upper(find(raw, p))) for p in (r"PAN\s*(?:No\.?)?\s*[:\-]?\s*:?\s*([A-Z]{5}\d{4}[A-Z])", r"PAN\s*(?:No\.?)?\s*[:\-]?\s*:?\s*([A-Z]{2}[0-9][A-Z]{2}\d{4}[A-Z])")]
    return F.coalesce(repaired, *[F.when(has(f, f"^{fixed.PAN}$", EXACT), f) for f in found])


def fix_cin(cin: Column, raw: Column) -> Column:
    return F.coalesce(F.when(has(cin, f"^{fixed.CIN}$"), cin), F.upper(find(raw, rf"\b({fixed.CIN})\b")), F.upper(find(raw, rf"CIN\s*[:\s]+({fixed.CIN})")))


def fix_ifsc(ifsc: Column) -> Column:
    """Upper case, the bank code's misreadings undone, a zero in fifth place."""
    s = F.upper(strip(ifsc))
    s = sub(s, "^ICICOQ", "ICIC0", EXACT)
    return F.when(F.substring(s, 5, 1) == "O", F.concat(F.substring(s, 1, 4), F.lit("0"), F.substring(s, 6, 100))).otherwise(s)


def fix_invoice_number(c: Column, raw: Column, tenant: bool = False) -> Column:
    """Leading marks read as I, a stray I dropped; with ``tenant`` one company's number family is completed too."""
    s = sub(c, "^[!|]", "I", EXACT)
    if tenant:
        s = sub(sub(c, "^[!|]T[B8]G/", "ITBG/", EXACT), "^[!|]", "I", EXACT)
        s = sub(sub(s, r"(\d{4})11([A-Z]{2})", "$1/$2", EXACT), r"(\d{4})A([A-Z]{2})/(\d{4})", "$1/$2/$3", EXACT)
    s = strip(sub(strip(s), r"\s+I$", "", EXACT))
    if tenant:
        whole = find(raw, r"ITBG/(\d{2}-\d{2}/\d{4}/[A-Z]{2}/\d{4})")
        a, b = (find(raw, r"(ITBG/\d{2}-\d{2}/\d{4})\D{0,5}([A-Z]{2}/\d{4})", i) for i in (1, 2))
        s = F.when(has(s, r"^ITBG/\d{2}-\d{2}/\d{4}$", EXACT), F.coalesce(F.concat(F.lit("ITBG/"), whole), F.concat(a, F.lit("/"), b), s)).otherwise(s)
    return s


def fix_reference(c: Column) -> Column:
    """Order and delivery references: a misread first letter, a missing I, stray brackets."""
    s = sub(c, r"^r([A-Z])", "I$1", EXACT)
    s = sub(s, r"^[fF]([A-Z])", "I$1", EXACT)
    s = F.when(s.startswith("TP/"), F.concat(F.lit("I"), s)).otherwise(s)
    return strip(sub(s, r"[{}\[\]()]", "", EXACT))


def cut_at(c: Column, words: str, limit: int) -> Column:
    """What stands before the first of the words, at most limit characters."""
    return F.substring(strip(F.get(F.split(c, FOLDED + words, 2), 0)), 1, limit)


def fix_transport(c: Column) -> Column:
    return F.substring(sub(strip(sub(c, r"^er\s+Name\s+", "")), r"\bGiobal\b", "Global", EXACT), 1, 100)


def fix_payment_terms(c: Column) -> Column:
    """Null where a GSTIN was taken for the terms."""
    return F.when(~has(c, "^[0-9]{2}[A-Z]{5}"), c)


def find_dba_date(c: Column, raw: Column) -> Column:
    return F.coalesce(c, first_of(raw, r"(?:DBA|OBA)\s*Date\s*[:\-]?\s*(\d{1,2}-[A-Z]{3}-\d{2,4})", r"(?:DBA|OBA)\s*Date\s*[:\-]?\s*(\d{1,2}/\d{2}/\d{2,4})", r"(?:DBA|OBA)\s*Date:?\s*(\d{1,2}-\w{3}-\d{2,4})"))


def tidy_value(c: Column) -> Column:
    """A record value trimmed, or null where it has marker characters or isn't printable Latin."""
    odd = r"[^\x20-\x7E\u00A0-\u024F\u20B9]"
    return let(trim_tail(c), lambda s: F.when((s != "") & ~has(s, fixed.MARKER_CHARS, EXACT) & ~has(s, odd, EXACT), s))


# ---- noise ----


def fix_noise(text: Column, tenant: bool = False, strict: bool = False) -> Column:
    """Recognition noise repaired by the ordered rules, each applied to what the one before left.

    ``strict`` keeps the order in which a currency sign before a digit goes first, which joins '9%' with
    the amount after it; otherwise percent signs stay unless they stand before a number and are turned.
    ``tenant`` adds one company's rules. A text that no rule matches is not rewritten.
    """
    digits, needs, rules = [], [], []
    for pattern, replacement, scope in fixed.NOISE:
        if scope == "tenant" and not tenant:
            continue
        marks = fixed.NOISE_NEEDS.get(pattern)
        if scope == "currency" and not strict:
            pattern, marks = pattern.replace("%", ""), marks[1:]
        if scope == "ifsc":
            # zeros up to six digits, then the digits: the first match keeps seven places at least
            rules.append((marks, [(rf"\bICICOQ0*([1-9]\d{{{zeros}}})\b", "ICIC0" + "0" * (5 - zeros) + "$1", EXACT) for zeros in range(6)] + [(r"\bICICOQ0*(\d+)\b", "ICIC0$1", EXACT)]))
        else:
            rules.append((marks, [(pattern, replacement)]))
        if marks:
            needs.append((marks, pattern))
        else:
            digits.append(pattern)

    def contains(low: Column, marks: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(m) for m in marks])

    def look_of(marks: list[str]):
        """One look stands for the marks that begin alike."""
        return next((m for m in ("icico", "iclc") if marks[0].startswith(m)), None) or ("-" if all(m.startswith("-") for m in marks) else tuple(marks))

    def looked(t: Column, low: Column, look) -> Column:
        return has(t, "-[a-z]{2}-") if look == "-" else contains(low, [look] if isinstance(look, str) else look)

    looks, grouped = {}, []
    for marks, pattern in needs:
        # a look behind a sign costs less than one before each character
        looks.setdefault(look_of(marks), []).append(pattern.replace(r"(?<![\d%])%", r"%(?<![\d%]%)"))
    for marks, steps in rules:
        look = look_of(marks) if marks else None
        if grouped and look and grouped[-1][0] == look:
            grouped[-1][1].extend(steps)
        else:
            grouped.append((look, list(steps)))
    tied = digits and all(p.startswith(r"\b") for p in digits)
    first = r"(?=\d)\b" if tied else r"(?=\d)"

    def matches(t: Column) -> Column:
        """Whether any rule matches: a look for the marks of some, and a search only where they are."""
        found = lambda patterns: has(t, "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
        marked = lambda low: reduce(lambda a, b: a | b, [looked(t, low, look) & found(patterns) for look, patterns in looks.items()])
        return has(t, first + "(?:" + "|".join(f"(?:{p[2 * tied:]})" for p in digits) + ")") | let(F.lower(t), marked)

    def repaired(t: Column) -> Column:
        """All rules in order; those in a row with one look are passed over together."""
        for look, steps in grouped:
            apply = lambda t, steps=steps: reduce(lambda t, s: sub(t, *s), steps, t)
            t = let(t, lambda t, look=look, apply=apply: F.when(looked(t, F.lower(t), look), apply(t)).otherwise(t)) if look else apply(t)
        return t

    return let(text, lambda t: F.when(matches(t), repaired(t)).otherwise(t))


def fix_noise_v1(text: Column) -> Column:
    """The older rules in order. A text that no rule matches is not rewritten: the rules without words begin with digits and are looked for in one search."""
    digits = "|".join(f"(?:{p})" for p, _ in fixed.NOISE_V1 if p not in fixed.NOISE_NEEDS_V1)
    marked = lambda t, low: reduce(lambda a, b: a | b, [reduce(lambda a, b: a | b, [low.contains(w) for w in words]) & has(t, p) for p, words in fixed.NOISE_NEEDS_V1.items()])
    matches = lambda t: has(t, rf"(?=\d)(?:{digits})") | let(F.lower(t), lambda low: marked(t, low))
    return let(text, lambda t: F.when(matches(t), reduce(lambda t, rule: sub(t, *rule), fixed.NOISE_V1, t)).otherwise(t))


# ---- boxes, JSON, maps ----


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box on a page as whole thousandths, kept within 0 and 1000."""
    low = lambda v, size: F.greatest(F.lit(0), F.floor(1000 * v / size).cast("int"))
    high = lambda v, size: F.least(F.lit(1000), F.floor(1000 * v / size).cast("int"))
    return F.array(low(x0, width), low(y0, height), high(x1, width), high(y1, height))


def repair_json(c: Column) -> Column:
    """Model output as JSON text: fences and what surrounds the outermost braces go, and trailing commas."""
    inner = find(c, r"(\{[\s\S]*\})", flags=EXACT)
    return sub(F.coalesce(inner, strip(c)), r",(\s*[}\]])", "$1", EXACT)


RENAMED = {"PLACE_OF_SUPPLY": "PLACE"}


def normal_record(record: Column) -> Column:
    """A model's flat record (map of text): keys renamed, amounts bare, rates with '%', empty values dropped, state code derived."""
    renamed = F.transform_keys(record, lambda k, v: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv]), k), k))
    money = [f for f in fixed.AMOUNTS]

    def clean(k: Column, v: Column) -> Column:
        bare = strip(sub(sub(v, r"[₹\s,]", "", EXACT), r"^(?:INR|Rs\.?)", ""))
        rate = F.when(strip(v).endswith("%"), strip(v)).otherwise(F.concat(strip(v), F.lit("%")))
        return F.when(k.isin(money), bare).when(k.isin(fixed.RATES), rate).otherwise(strip(v))

    kept = F.map_filter(renamed, lambda k, v: F.coalesce(strip(v), F.lit("")) != "")

    def coded(done: Column) -> Column:
        code = state_code(F.element_at(done, "GSTIN_S"))
        return F.when(F.element_at(done, "STATE_CODE").isNull() & code.isNotNull(), F.map_concat(done, F.create_map(F.lit("STATE_CODE"), code))).otherwise(done)

    return let(F.transform_values(kept, clean), coded)


def get_item(record: Column, key: str) -> Column:
    return F.element_at(record, key)


def encode_record(record: Column) -> Column:
    return F.to_json(record)


def decode_record(c: Column) -> Column:
    """A JSON object as a map of text; broken JSON gives an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def tidy_words(c: Column) -> Column:
    return squeeze(c)

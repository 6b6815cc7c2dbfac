"""Format-preserving pseudonyms for personal numbers, dates and addresses, in built-in functions only.

Values are found by patterns and validated; a Feistel network keyed with SHA-256 permutes each
within its own format, so the same value gets the same pseudonym in any document and two values of a kind
never share one (dates: of one order and separator; a date whose day may be its month is read day first). Everything happens inside the row: nothing is exploded, shuffled or sent to Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Longest parts before and after the @ of a valid address.
LOCAL_MOST, DOMAIN_MOST = 64, 255
#: What is looked for, in the order of precedence at one place. Repeats without a bound are
#: possessive and begin where a run of their characters begins, so a text is searched in linear time and no stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
FIND = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Dates keep within 400 years of the same calendar: 146097 days, 189 times 773.
CYCLE, CYCLE_L, CYCLE_R = 146097, 189, 773
CYCLE_FROM = "1800-01-01"
#: Of these 88497 lie behind the twelfth of their month, 9 times 9833: only they can be read in one way with the month first.
LATE, LATE_L, LATE_R = 88497, 9, 9833


def _sha(key: str, *parts: str) -> str:
    return f"sha2(concat_ws('|', {key}, {', '.join(parts)}), 256)"


def _class_add(text: str, digest: str) -> str:
    """SQL: every ASCII digit and letter of text moved on within its class by the digest's bytes."""
    code = f"ascii(substring({text}, j, 1))"
    step = f"cast(conv(substring({digest}, 2 * pmod(j - 1, 32) + 1, 2), 16, 10) as int)"
    moved = f"CASE WHEN {code} BETWEEN 48 AND 57 THEN char(48 + ({code} - 48 + {step}) % 10) WHEN {code} BETWEEN 65 AND 90 THEN char(65 + ({code} - 65 + {step}) % 26) WHEN {code} BETWEEN 97 AND 122 THEN char(97 + ({code} - 97 + {step}) % 26) ELSE substring({text}, j, 1) END"
    return f"CASE WHEN {text} = '' THEN '' ELSE array_join(transform(sequence(1, length({text})), j -> {moved}), '') END"


def feistel_text(value: str, key: str, tweak: str) -> str:
    """SQL: value permuted among the texts with its length and character classes."""
    start = f"named_struct('l', substring({value}, 1, length({value}) div 2), 'r', substring({value}, length({value}) div 2 + 1))"
    turned = _class_add("s.l", _sha(key, repr(tweak), f"length({value})", "cast(i as string)", "s.r"))
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> named_struct('l', s.r, 'r', {turned}), s -> concat(s.l, s.r))"


def feistel_number(value: str, left: int, right: int, key: str, tweak: str) -> str:
    """SQL: an integer below left * right permuted among those."""
    step = lambda other, modulus, part: f"(s.{part} + cast(conv(substring({_sha(key, repr(tweak), 'cast(i as string)', repr(part), f'cast(s.{other} as string)')}, 1, 12), 16, 10) as bigint)) % {modulus}"
    start = f"named_struct('l', cast({value} as bigint) div {right}, 'r', cast({value} as bigint) % {right})"
    turned = f"CASE WHEN i % 2 = 1 THEN named_struct('l', {step('r', left, 'l')}, 'r', s.r) ELSE named_struct('l', s.l, 'r', {step('l', right, 'r')}) END"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {turned}, s -> s.l * {right} + s.r)"


def _digit(text: str, at: str) -> str:
    return f"(ascii(substring({text}, {at}, 1)) - 48)"


def luhn_sum(text: str, shift: int) -> str:
    """SQL: Luhn sum of digits; shift 0 where the last digit is the check digit, 1 where that is still to come."""
    d = _digit(text, f"length({text}) - k + 1")
    doubled = f"(k + {shift}) % 2 = 0"
    return f"aggregate(sequence(1, length({text})), 0, (a, k) -> a + CASE WHEN {doubled} THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END)"


def iban_rest(text: str) -> str:
    """SQL: an IBAN's remainder by 97 (1 where it is valid), its first four characters moved to its end."""
    turned = f"concat(substring({text}, 5), substring({text}, 1, 4))"
    c = f"ascii(substring({turned}, k, 1))"
    return f"aggregate(sequence(1, length({turned})), 0, (a, k) -> CASE WHEN {c} < 58 THEN (a * 10 + {c} - 48) % 97 ELSE (a * 100 + {c} - 55) % 97 END)"


def _refill(shape: str, chars: str, kind: str) -> str:
    """SQL: shape with its characters of a class replaced in turn by those of chars."""
    pieces = f"split({shape}, '{kind}', -1)"
    return f"array_join(zip_with({pieces}, split(concat(regexp_replace({chars}, '(.)', '$1\\u0001')), '\\u0001', -1), (p, c) -> concat(coalesce(p, ''), coalesce(c, ''))), '')"


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a found text m, or m where it isn't valid; key is SQL too."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    full = lambda kind: f"{m} RLIKE '^(?:{PATTERNS[kind]})$'".replace("\\", "\\\\")
    lead = f"regexp_extract({m}, '^[._%+-]*+', 0)"
    local = f"substring(substring_index({m}, '@', 1), length({lead}) + 1)"
    domain = f"substring_index({m}, '@', -1)"
    email_valid = f"length({local}) BETWEEN 1 AND {LOCAL_MOST} AND length({domain}) <= {DOMAIN_MOST}"
    email = f"concat({lead}, {feistel_text(local, key, 'email')}, '@', {domain})"

    bare = f"regexp_replace({m}, ' ', '')"
    account = f"concat(substring({bare}, 1, 2), '00', {feistel_text(f'substring({bare}, 5)', key, 'iban')})"
    checked = f"element_at(transform(array({account}), b -> concat(substring(b, 1, 2), lpad(cast(98 - {iban_rest('b')} as string), 2, '0'), substring(b, 5))), 1)"
    iban = _refill(m, checked, "[A-Z0-9]")

    octet = lambda i: f"cast(split({m}, '[.]')[{i}] as int)"
    as_number = f"((({octet(0)} * 256L + {octet(1)}) * 256L + {octet(2)}) * 256L + {octet(3)})"
    ip = f"element_at(transform(array({feistel_number(as_number, 65536, 65536, key, 'ipv4')}), n -> concat_ws('.', cast(n div 16777216 as string), cast(n div 65536 % 256 as string), cast(n div 256 % 256 as string), cast(n % 256 as string))), 1)"
    ip_valid = f"forall(split({m}, '[.]'), o -> cast(o as int) < 256 AND (o = '0' OR o NOT LIKE '0%'))"

    sep = f"substring({m}, 3, 1)"
    iso = f"substring({m}, 5, 1) = '-'"
    year = f"CASE WHEN {iso} THEN substring({m}, 1, 4) ELSE substring({m}, 7, 4) END"
    day_first = f"try_to_timestamp(concat({year}, '-', substring({m}, 4, 2), '-', substring({m}, 1, 2)), 'yyyy-MM-dd')"
    month_first = f"try_to_timestamp(concat({year}, '-', substring({m}, 1, 2), '-', substring({m}, 4, 2)), 'yyyy-MM-dd')"
    iso_date = f"try_to_timestamp({m}, 'yyyy-MM-dd')"
    parsed = f"CASE WHEN {iso} THEN {iso_date} ELSE coalesce({day_first}, {month_first}) END"
    day = f"datediff(cast({parsed} as date), date'{CYCLE_FROM}')"
    moved = f"date_add(date'{CYCLE_FROM}', cast({feistel_number(f'pmod({day}, {CYCLE})', CYCLE_L, CYCLE_R, key, 'date')} + {CYCLE} * floor({day} / {CYCLE}) as int))"
    moved_text = f"element_at(transform(array({moved}), d -> CASE WHEN {iso} THEN date_format(d, 'yyyy-MM-dd') ELSE concat(date_format(d, 'dd'), {sep}, date_format(d, 'MM'), {sep}, date_format(d, 'yyyy')) END), 1)"
    # a date with its month first is one whose day is above 12, else it is read day first; such dates are permuted among themselves
    months = "months_between(trunc({}, 'MM'), date'" + CYCLE_FROM + "')"
    late_start = lambda m: f"(datediff(add_months(date'{CYCLE_FROM}', cast({m} as int)), date'{CYCLE_FROM}') - 12 * {m})"
    month = f"cast(round({months.format(f'cast({month_first} as date)')}) as bigint)"
    rank = f"(datediff(cast({month_first} as date), date'{CYCLE_FROM}') - 12 * ({month} + 1))"
    guess = f"(x * 4800 div {LATE})"
    its_month = f"array_max(filter(sequence(greatest({guess} - 3, 0L), least({guess} + 3, 4799L)), m -> {late_start('m')} <= x))"
    back = f"element_at(transform(array({its_month}), m -> date_add(add_months(date'{CYCLE_FROM}', cast(m as int)), cast(12 + x - {late_start('m')} as int))), 1)"
    late = f"element_at(transform(array({feistel_number(rank, LATE_L, LATE_R, key, 'late date')}), x -> date_format({back}, concat('MM', {sep}, 'dd', {sep}, 'yyyy'))), 1)"
    shown = f"CASE WHEN NOT {iso} AND {day_first} IS NULL THEN {late} ELSE {moved_text} END"
    date_valid = f"({parsed}) IS NOT NULL AND cast({year} as int) BETWEEN 1800 AND 2199"

    area, group, serial = (f"cast(substring({m}, {a}, {n}) as bigint)" for a, n in ((1, 3), (5, 2), (8, 4)))
    ssn_valid = f"{area} NOT IN (0, 666) AND {area} < 900 AND {group} > 0 AND {serial} > 0"
    ssn_rank = f"((({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END) * 99 + {group} - 1) * 9999 + {serial} - 1)"
    ssn = f"element_at(transform(array({feistel_number(ssn_rank, 898 * 99, 9999, key, 'ssn')}), n -> concat(lpad(cast(n div 989901 + CASE WHEN n div 989901 >= 665 THEN 2 ELSE 1 END as string), 3, '0'), '-', lpad(cast(n div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(n % 9999 + 1 as string), 4, '0'))), 1)"

    country = f"regexp_extract({m}, '^([+][0-9]{{1,3}})[ .(-]', 1)"
    national = f"regexp_replace(substring({m}, length({country}) + 1), '[^0-9]', '')"
    phone = f"concat({country}, {_refill(f'substring({m}, length({country}) + 1)', feistel_text(national, key, 'phone'), '[0-9]')})"
    phone_valid = f"length({digits}) BETWEEN 8 AND 15"

    payload = f"substring({digits}, 1, length({digits}) - 1)"
    numbered = f"element_at(transform(array({feistel_text(payload, key, 'card')}), p -> concat(p, cast((10 - {luhn_sum('p', 1)} % 10) % 10 as string))), 1)"
    card = _refill(m, numbered, "[0-9]")
    card_valid = f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sum(digits, 0)} % 10 = 0"

    return f"""CASE
        WHEN contains({m}, '@') THEN CASE WHEN {email_valid} THEN {email} ELSE {m} END
        WHEN {full('iban')} THEN CASE WHEN length({bare}) BETWEEN 15 AND 34 AND {iban_rest(bare)} = 1 THEN {iban} ELSE {m} END
        WHEN {full('ipv4')} THEN CASE WHEN {ip_valid} THEN {ip} ELSE {m} END
        WHEN {full('date')} THEN CASE WHEN {date_valid} THEN {shown} ELSE {m} END
        WHEN {full('ssn')} THEN CASE WHEN {ssn_valid} THEN {ssn} ELSE {m} END
        WHEN {full('phone')} THEN CASE WHEN {phone_valid} THEN {phone} ELSE {m} END
        WHEN {card_valid} THEN {card}
        ELSE {m} END"""


def kind_of(m: Column) -> Column:
    """Name of the pattern that a found text matches first."""
    out = F.lit("card")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def secret(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery: plans, the event log and the UI show the subquery, not its value."""
    return spark.sql("SELECT * FROM VALUES (:secret) AS keys(secret)", args={"secret": key}).scalar()


def free_name(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text's personal values replaced; all other columns and rows as they were.

    Added (an input column of such a name is replaced): found (values as they stood, in order) and
    pseudonyms (what stands there now; equal to found where validation failed). Valid: up to 64 characters before
    an address's @ and 255 after it, Luhn for card numbers, modulo 97 for IBANs, octets for network addresses, the
    calendar for dates (1800 to 2199), the allotted ranges for social-security numbers, 8 to 15 digits for telephone
    numbers. Punctuation before an address's first letter or digit is found with it and stays. Null and empty texts
    stay null and empty with no values found; repeated rows get the same pseudonyms. Time is linear in a text's length.
    """
    text = F.col(text_col)
    rest = [c for c in docs.columns if c not in ("found", "pseudonyms")]
    name = free_name("_secret", rest)
    candidate = text.rlike("[0-9]|@")
    none = F.array().cast("array<string>")
    found = docs.select(*rest, secret(docs.sparkSession, key).alias(name)).withColumn("found", F.when(candidate, F.regexp_extract_all(text, F.lit(FIND), F.lit(0))).otherwise(none))
    made = found.withColumn("pseudonyms", F.when(F.size("found") > 0, F.expr(f"transform(found, m -> {pseudonym('m', f'`{name}`')})")).otherwise(none)).drop(name)
    pieces = F.split(text, FIND, -1)
    rebuilt = F.array_join(F.zip_with(pieces, "pseudonyms", lambda p, c: F.concat(F.coalesce(p, F.lit("")), F.coalesce(c, F.lit("")))), "")
    return made.withColumn(text_col, F.when(F.size("found") > 0, rebuilt).otherwise(text))

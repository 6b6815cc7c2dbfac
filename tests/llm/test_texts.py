import base64
import hashlib
import io
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, html_main, license_scan, mixing, pii, tokens, toxicity, warc

from .helpers import docs, lowered, odd_rows, words

# ---- decontamination ----


def tiles_brute(item, text, least):
    """Greedy string tiling by comparing everything with everything, the longest first; of equal ones the first in the text, then in the item."""
    free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_i[i + n] and free_t[j + n]:
                    n += 1
                best = max(best, (n, -j, -i))
        n, j, i = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        free_i[i : i + n] = free_t[j : j + n] = [False] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("seed", range(60))
def test_greedy_tiles_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    item, text = [rng.randrange(2 + seed % 5) + 1 for _ in range(25)], [rng.randrange(2 + seed % 5) + 1 for _ in range(60)]
    text[10:10] = item[12:] + [99] + item[:12]
    got = decontaminate.greedy_tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
    assert got == tiles_brute(item, text, 3)


def pairs_brute(rows, items):
    """(doc_id, item_id, matched words) of the contaminated pairs."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    number = {}
    code = lambda t: [number.setdefault(x, len(number) + 1) for x in cut(t)]
    out = []
    for d, t in rows:
        for i, b in items:
            own = code(b)
            if len(own) >= decontaminate.MIN_MATCH:
                n = sum(x[2] for x in tiles_brute(own, code(t), decontaminate.MIN_MATCH))
                if n >= decontaminate.THRESHOLD * len(own):
                    out.append((d, i, n))
    return sorted(out)


def test_pairs_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    hot = ["which", "of", "the", "following", "is", "true"]
    items = [(i, " ".join(hot + words(rng, rng.randrange(0, 14), 40))) for i in range(40)] + [(50, "a b c d"), (51, "a a a a a a a a"), (52, None)]
    rows = []
    for i in range(50):
        own = words(rng, rng.randrange(0, 30), 40)
        if i % 2:
            picked = items[rng.randrange(40)][1].split()
            k = rng.randrange(len(picked))
            own[len(own) // 2 : len(own) // 2] = picked[k:] + ["zz"] * (i % 3) + picked[:k]
        rows.append((i, " ".join(own)))
    rows += [(60, "a a a a a a"), (61, " ".join(hot))]
    want = pairs_brute(rows, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(want) > 20 and {i for _, i, _ in want} >= {51}
    for most in (28, 16):
        monkeypatch.setattr(decontaminate, "FILTER_MOST", most)
        got = decontaminate.contaminated_pairs(docs(spark, rows), bench).collect()
        assert sorted((r.doc_id, r.item_id, r.matched_words) for r in got) == want
    kept = decontaminate.keep_clean(docs(spark, rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, *_ in want}


def test_contaminated_pairs(spark):
    rng = random.Random(0)
    item = words(rng, 30, 10_000)
    other = words(rng, 30, 10_000)
    reordered = item[15:] + ["x"] * 4 + item[:15]
    rows = [(1, " ".join(["a"] * 50 + item + ["b"] * 9)), (2, " ".join(reordered).upper().replace(" ", ", ")), (3, " ".join(item[:10])), (4, " ".join(words(rng, 200, 10_000))), *[(100 + i, t) for i, t in odd_rows() if i]]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(other)), (9, None), (10, ""), (11, "one two"), (7, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated_pairs(docs(spark, rows, "coverage item_id"), bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(1, 7), (2, 7)]
    assert len(got) == 4 and {len(r.tiles) for r in got if r.doc_id == 2} == {2}
    kept = decontaminate.keep_clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) - 2
    assert decontaminate.contaminated_pairs(docs(spark, []), bench).count() == 0
    assert decontaminate.keep_clean(docs(spark, rows), bench.limit(0)).count() == len(rows)


# ---- WARC ----


def test_warc_round_trip(spark, tmp_path):
    page = "é" * 60
    rows = [(1, "http://a/", "short"), (2, "http://b/", "short"), (3, "http://c/ d", page), (4, None, page), (5, "u", None), (6, "u", ""), (7, "u", "x" * 3_000_000), (8, "u", page + " "), (9, "u", "x" * 99), (10, "u", "x" * 99), (11, "u", "x" * 100), (12, "u", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest2", F.lit(1)).repartition(3)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    records = warc.read_archives(manifest, payloads=True)
    got = {r.page_id: r for r in records.collect()}
    whole = {r.page_id: r for r in warc.resolve_revisits(records).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {4: ("revisit", 3), 12: ("revisit", 11)}
    for i, _, html in rows:
        assert whole[i].payload_bytes == len((html or "").encode()) and whole[i].payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
        assert got[i].payload == ((html or "") if got[i].record_type == "response" else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_finds_faults():
    record = warc.encode_record(1, "http://a/", b"hello", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", None)
    (headers, block), = warc.read_records(io.BytesIO(record))
    assert warc.verified(headers, block, True)["payload"] == "hello" and warc.verified(headers, block)["payload"] is None
    assert len(list(warc.read_records(io.BytesIO(record * 3)))) == 3
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(record[:-20])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(_gz(zlib.decompress(record, 31).replace(b"Content-Length: ", b"Content-Length: 9")))))
    with pytest.raises(warc.WarcError):
        warc.verified(headers, block + b"x")


def test_rows_without_a_page_id(spark, tmp_path):
    page = "p" * 200
    rows = [(None, "u", page), (None, "u", page), (5, "u", page), (3, None, page), (None, None, None), (5, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages).collect()
    assert len(got) == 6 and sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [(0, "response", None)] * 3 + [(3, "response", None), (5, "revisit", 3), (5, "revisit", 3)]
    assert {r.payload_bytes for r in got} == {0, 200}


def test_archives_of_other_writers(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\nbody"
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    record = lambda kind, block, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response\r\n"
    parts = [record("warcinfo", b"software: x"), record("response", body, f"{http}WARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:{sha}\r\n"), record("revisit", b"", f"WARC-Payload-Digest: sha1:{sha}\r\n"), record("metadata", b"x")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(_gz(p) for p in parts))
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", None)], "path string, records long")
    got = sorted((r.record_type, r.page_id, r.payload_bytes, r.payload) for r in warc.read_archives(manifest, payloads=True).collect())
    assert got == [("response", None, 4, "body"), ("revisit", None, None, None)]
    (headers, block), = warc.read_records(io.BytesIO(_gz(parts[1])))
    with pytest.raises(warc.WarcError):
        warc.verified(headers, block + b"!")


def _gz(data):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ---- licences ----


def test_license_scan(spark):
    rows = [
        (1, "Released under the MIT License. And under the mit license"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "CC BY-NC 4.0"),
        (5, "the license of the general public"), (6, "version 3 of the gnu license for the public in general"), *[(100 + i, t) for i, t in odd_rows() if i], (7, "x " * 40_000 + "licensed under cc by sa 4.0"),
    ]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, rows, "score labels n_words")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].labels) == (2, 1, 6, "mit", "mit")
    assert got[2].labels == "apache-2" and got[3].base_labels == "" and got[3].labels == "gpl-3" and got[4].base_labels == "cc-by-nc"
    assert got[5].labels == "" and got[6].labels == "" and got[7].labels == "cc-by-sa"
    for i, t in rows:
        assert got[i].n_words == len(license_scan.words_of(t)) and 0 <= got[i].score <= 1
    assert license_scan.scan(docs(spark, [])).count() == 0


def test_edited_notices_like_a_scan_of_every_place(spark):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        own = rng.choice(license_scan.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(own) + 1)
            if rng.random() < 0.5:
                own[at:at] = words(rng, rng.randrange(1, 3), 50)
            elif len(own) > 3:
                del own[at : at + 1]
        rows.append((i, " ".join(words(rng, rng.randrange(0, 30), 50) + own + words(rng, rng.randrange(0, 30), 50))))
    df = docs(spark, rows + [(1000 + i, t) for i, t in odd_rows() if i])
    index = license_scan.rare_index(license_scan.inverse_frequencies(df))
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    hits = 0
    for i, text in rows:
        h = tokens.Words(tokens.NON_ALNUM_BYTES, lower=True).hash_documents([text.encode()])[0]
        want = {label for label, own, weight, phrases in index.templates for at in range(-len(own), len(h)) if license_scan.verified(h, at, own, weight, phrases)}
        want |= set(filter(None, got[i].base_labels.split(",")))
        assert got[i].labels == ",".join(sorted(want)), text
        hits += bool(want)
    assert 60 < hits < 150


BASE_SQL = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    p(phrase, label) AS (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')),
    hits AS (SELECT doc_id, label, i - 1 AS place FROM w, p, unnest(range(1, len(ws) - len(phrase) + 2)) AS t(i) WHERE list_slice(ws, i, i + len(phrase) - 1) = phrase)
    SELECT w.doc_id, len(ws) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
    FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id, ws
"""


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_base_columns_like_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = sorted(con.execute(BASE_SQL).fetchall())
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    got = sorted(tuple(r) for r in license_scan.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select(*names).collect())
    assert got == want and sum(r[2] for r in got) > 0


# ---- PII ----


def feistel_plain(value, key, tweak):
    """The text permutation of pii.feistel_text, once more in plain Python."""
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, pii.ROUNDS + 1):
        digest = hashlib.sha256("|".join([key, tweak, str(len(value)), str(i), right]).encode()).hexdigest()
        turned = ""
        for j, c in enumerate(left):
            step = int(digest[2 * (j % 32) : 2 * (j % 32) + 2], 16)
            for base, size, own in ((48, 10, "0123456789"), (65, 26, None), (97, 26, None)):
                if base <= ord(c) < base + size:
                    c = chr(base + (ord(c) - base + step) % size)
                    break
            turned += c
        left, right = right, turned
    return left + right


def number_plain(value, left_size, right_size, key, tweak):
    left, right = divmod(value, right_size)
    draw = lambda i, part, other: int(hashlib.sha256("|".join([key, tweak, str(i), part, str(other)]).encode()).hexdigest()[:12], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + draw(i, "l", right)) % left_size
        else:
            right = (right + draw(i, "r", left)) % right_size
    return left * right_size + right


def pseudonym_plain(kind, m, key):
    """Pseudonyms of valid values by kind, in plain Python."""
    digits = re.sub(r"\D", "", m)
    fill = lambda shape, chars, of: (lambda it: re.sub(of, lambda _: next(it), shape))(iter(chars))
    if kind == "email":
        lead = re.match(r"[._%+-]*", m)[0]
        local, domain = m[len(lead) :].split("@")
        return f"{lead}{feistel_plain(local, key, 'email')}@{domain}"
    if kind == "card":
        payload = feistel_plain(digits[:-1], key, "card")
        return fill(m, payload + next(c for c in "0123456789" if luhn(payload + c)), r"\d")
    if kind == "ssn":
        area, group, serial = (int(x) for x in m.split("-"))
        n = number_plain(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, key, "ssn")
        area, group, serial = n // 989901, n // 9999 % 99 + 1, n % 9999 + 1
        return f"{area + (2 if area >= 665 else 1):03d}-{group:02d}-{serial:04d}"
    if kind == "ipv4":
        a, b, c, d = (int(x) for x in m.split("."))
        n = number_plain(((a * 256 + b) * 256 + c) * 256 + d, 65536, 65536, key, "ipv4")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "date":
        from datetime import date, timedelta

        day = (date.fromisoformat(m) - date.fromisoformat(pii.CYCLE_FROM)).days
        n = number_plain(day % pii.CYCLE, pii.CYCLE_L, pii.CYCLE_R, key, "date") + pii.CYCLE * (day // pii.CYCLE)
        return (date.fromisoformat(pii.CYCLE_FROM) + timedelta(n)).isoformat()
    if kind == "iban":
        bare = m.replace(" ", "")
        account = feistel_plain(bare[4:], key, "iban")
        number = int("".join(str(int(c, 36)) for c in account + bare[:2] + "00"))
        return fill(m, f"{bare[:2]}{98 - number % 97:02d}{account}", "[A-Z0-9]")
    country = (re.match(r"(\+\d{1,3})[ .(-]", m) or ["", ""])[1]
    return country + fill(m[len(country) :], feistel_plain(re.sub(r"\D", "", m[len(country) :]), key, "phone"), r"\d")


def test_pseudonyms_like_plain_python(spark):
    rng = random.Random(11)
    values = []
    for _ in range(25):
        n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        payload = n(15)
        values.append(("card", payload + next(c for c in "0123456789" if luhn(payload + c))))
        values.append(("ssn", f"{rng.randrange(1, 665):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}"))
        values.append(("ipv4", ".".join(str(rng.randrange(256)) for _ in range(4))))
        values.append(("date", f"{rng.randrange(1800, 2200)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"))
        values.append(("email", f"{'.' * rng.randrange(2)}User{n(3)}.x@mail-{n(2)}.example.org"))
        values.append(("phone", f"+49 {n(3)} {n(7)}"))
        account = n(18)
        values.append(("iban", f"DE{98 - int(account + '131400') % 97:02d}{account}"))
    df = spark.createDataFrame([(i, f"<< {v} >>") for i, (_, v) in enumerate(values)], "doc_id long, text string")
    for r in pii.pseudonymise(df, "k").collect():
        kind, value = values[r.doc_id]
        assert list(r.found) == [value], (kind, r)
        assert r.text == f"<< {pseudonym_plain(kind, value, 'k')} >>", kind
    assert pii.free_name("_secret", ["_SECRET"]) == "__secret"


def test_long_texts_take_linear_time_and_no_stack(spark):
    rng = random.Random(1)
    texts = ["deadbeef0123" * 100_000, "a@" + "b." * 100_000 + "c", "a.b" * 300_000 + "@x.org", "." * 500_000, "1-" * 300_000, "+1" * 300_000, "a@b" * 200_000, " ".join(words(rng, 60_000, 50_000)) + " x@y.org"]
    df = docs(spark, [*enumerate(texts), *[(100 + i, t) for i, t in odd_rows() if i]], "found pseudonyms _secret")
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert time.perf_counter() - began < 60
    assert list(got[7].found) == ["x@y.org"] and got[0].text == texts[0] and got[2].text == texts[2] and got[1].text == texts[1]
    assert got[101].text is None and list(got[101].found) == [] and set(got[110].asDict()) == {*df.columns}


def test_no_plan_shows_the_key(spark):
    got = pii.pseudonymise(docs(spark, [(1, "x@y.org")]), "a very secret key")
    shown = got._jdf.queryExecution().toString() + got._jdf.queryExecution().optimizedPlan().toString()
    assert "a very secret key" not in shown and "Python" not in shown
    assert got.first().text != "x@y.org"


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        (1, "card 4111 1111 1111 1111, again 4111-1111-1111-1111; bad 4111111111111112"), (2, "on 2024-02-29 or 29.02.2024; never 2023-02-30"), (3, "ip 10.0.255.7 and 300.1.1.1"), (4, "ssn 123-45-6789 not 666-45-6789"), (5, "call +1 (017) 555-7713!"),
        (6, "iban DE89 3704 0044 0532 0130 00 not DE88 3704 0044 0532 0130 00"), (7, "a.b-9@mail.example.com."), (8, None), (9, ""), (10, "none here"), (11, "4111111111111111"),
    ]
    df = docs(spark, texts, "found")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    assert got[8].text is None and got[9].text == "" and got[10].text == "none here" and got[8].found == []
    card = got[1].pseudonyms
    assert luhn(card[0]) and re.sub(r"\d", "9", card[0]) == "9999 9999 9999 9999" and card[0].replace(" ", "-") == card[1] and card[2] == got[1].found[2]
    assert got[11].pseudonyms[0] == card[0].replace(" ", "")
    iso, dotted, bad = got[2].pseudonyms
    assert iso == "-".join(dotted.split(".")[::-1]) and iso != "2024-02-29" and bad == "2023-02-30"
    assert all(int(x) < 256 for x in got[3].pseudonyms[0].split(".")) and got[3].pseudonyms[1] == "300.1.1.1"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", got[4].pseudonyms[0]) and got[4].pseudonyms[1] == "666-45-6789"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[5].pseudonyms[0])
    a, b = got[6].pseudonyms
    assert b == "DE88 3704 0044 0532 0130 00" and int("".join(str(int(c, 36)) for c in (a.replace(" ", "")[4:] + a[:4]))) % 97 == 1
    assert re.fullmatch(r"[a-z]\.[a-z]-\d@mail\.example\.com", got[7].pseudonyms[0])
    for i, t in texts:
        for old, new in zip(got[i].found, got[i].pseudonyms, strict=True):
            assert len(old) == len(new) or "." in old
    assert {r.doc_id: r.pseudonyms for r in pii.pseudonymise(df, "other").collect()}[1] != card
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    numbers = spark.range(189 * 11).select(F.expr(pii.feistel_number("id", 189, 11, "'k'", "t")).alias("p"))
    assert sorted(r.p for r in numbers.collect()) == list(range(189 * 11))
    texts = spark.range(1000).select(F.expr(pii.feistel_text("lpad(cast(id as string), 3, '0')", "'k'", "t")).alias("p"))
    assert sorted(r.p for r in texts.collect()) == [f"{i:03d}" for i in range(1000)]
    days = spark.range(4000).select(F.expr("date_format(date_add(date'1999-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("text"))
    moved = pii.pseudonymise(days.withColumn("doc_id", F.lit(1)), "k").select("text").distinct().count()
    assert moved == 4000


# ---- mixing ----


def test_poisson_mix(spark):
    rows = [(i, "x" * 10) for i in range(3000)]
    df = docs(spark, rows).withColumn("source", F.when(F.col("doc_id") < 2000, "a").when(F.col("doc_id") < 2900, "b").when(F.col("doc_id") < 2990, "c")).withColumn("copy", F.lit("clash"))
    got = mixing.poisson_mix(df, {"a": 1.0, "b": 1.0, "z": 3.0}, "s")
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["a"] - 1450) < 150 and abs(n["b"] - 1450) < 150 and abs(n["c"] - 90) < 40
    again = mixing.poisson_mix(df.repartition(7), {"a": 1.0, "b": 1.0, "z": 3.0}, "s")
    assert sorted(map(tuple, got.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.2
    assert mixing.poisson_mix(docs(spark, []), {"a": 1.0}).count() == 0
    odd = mixing.poisson_mix(docs(spark, odd_rows()), {"src1": 1.0, "none": 0.0})
    assert set(odd.columns) == {*docs(spark, []).columns, "copy", "shuffle_key"}
    assert mixing.poisson_mix(docs(spark, rows), {"src1": 0.0}).count() == 0


def test_great_rates_are_drawn_in_blocks(spark):
    df = docs(spark, [(i, "x" * (1 if i < 20 else 2000)) for i in range(40)]).withColumn("source", F.when(F.col("doc_id") < 20, "small").otherwise("big"))
    got = mixing.poisson_mix(df, {"small": 1.0, "big": 3.0}, "s")
    n = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    rate = 0.25 * (20 + 40_000) / 20
    own = [n[i] for i in range(20)]
    assert abs(np.mean(own) - rate) < 4 * np.sqrt(rate / 20) and 0.4 * rate < np.var(own) < 2.2 * rate and len(set(own)) > 5
    assert got.select("doc_id", "copy").distinct().count() == got.count() == got.select("shuffle_key").distinct().count()


def test_rows_without_an_id_draw_by_their_text(spark):
    df = docs(spark, [(None, f"text {i}") for i in range(400)] + [(None, None)])
    got = mixing.poisson_mix(df, {"src1": 1.0})
    n = [r["count"] for r in got.groupBy("text").count().collect()]
    assert len(set(n)) > 2 and got.select("shuffle_key").distinct().count() == got.count()


@pytest.mark.parametrize("rate", [0.1, 1.0, 7.5, 64.0])
def test_poisson_cdf(rate):
    cdf = mixing.poisson_cdf(rate)
    assert all(a <= b for a, b in zip(cdf, cdf[1:], strict=False)) and abs(cdf[-1] - 1) < 1e-9
    mean = sum(k * (b - a) for k, (a, b) in enumerate(zip([0.0, *cdf], cdf, strict=False)))
    assert abs(mean - rate) < 1e-5 * max(1, rate)


# ---- toxicity ----


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(rng).items()}
    x, mask = rng.normal(size=(toxicity.WINDOW, 3, toxicity.FEATURES)).astype(np.float32), np.ones((toxicity.WINDOW, 3), np.float32)
    mask[20:, 1] = 0
    y, s = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, g = toxicity.gradients({k: v.astype(np.float32) for k, v in w.items()}, x, mask, y, s)
    for i in ((3, 0, 1), (0, 2, toxicity.FEATURES - 1)):
        loss = []
        for step in (1e-2, -1e-2):
            moved = x.copy()
            moved[i] += step
            loss.append(toxicity.gradients({n: v.astype(np.float32) for n, v in w.items()}, moved, mask, y, s)[0])
        assert abs((loss[0] - loss[1]) / 2e-2 - g["x"][i]) < 2e-3
    for k in w:
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        loss = []
        for step in (1e-2, -1e-2):
            moved = {n: v.copy() for n, v in w.items()}
            moved[k][i] += step
            loss.append(toxicity.gradients({n: v.astype(np.float32) for n, v in moved.items()}, x, mask, y, s)[0])
        assert abs((loss[0] - loss[1]) / 2e-2 - g[k][i]) < 2e-3, k


def plain_score(model, text):
    """The probability of one text, word by word in Python loops."""
    own = [x for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)]
    v = toxicity.Vocabulary([text])
    rows = v.features(model.word_z, model.gram_z, model.tables)[v.index]
    assert len(rows) == len(own)
    w, size = {k: x.astype(np.float64) for k, x in model.weights.items()}, toxicity.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    best = None
    starts = [0] if own else []
    while starts and starts[-1] + toxicity.WINDOW < len(own):
        starts.append(starts[-1] + toxicity.STRIDE)
    for a in starts:
        x = rows[a : a + toxicity.WINDOW].astype(np.float64)
        states = {}
        for way, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, states[way] = np.zeros(size), [None] * len(x)
            for t in order:
                pre = x[t] @ w[f"x{way}"] + w[f"c{way}"]
                zr = sig(pre[: 2 * size] + h @ w[f"h{way}"][:, : 2 * size])
                c = np.tanh(pre[2 * size :] + (zr[size:] * h) @ w[f"h{way}"][:, 2 * size :])
                h = (1 - zr[:size]) * h + zr[:size] * c
                states[way][t] = h
        both = np.array([np.concatenate([states["f"][t], states["b"][t]]) for t in range(len(x))])
        e = np.array([np.tanh(s @ w["att"]) @ w["query"] for s in both])
        p = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        logit = sum(q * s for q, s in zip(p, both, strict=True)) @ w["out"] + w["bias"][0]
        best = logit if best is None else max(best, logit)
    top = w["bias"][0] if best is None else best
    return float(1 / (1 + np.exp(-np.clip(model.scale * top + model.shift, -30, 30))))


def test_scores_of_a_model_like_plain_loops():
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.randrange(1, 40), 60) + (["vile"] if i % 3 == 0 else [])).encode() for i in range(60)]
    model = toxicity.train(list(range(60)), texts, np.array([int(i % 3 == 0) for i in range(60)]))
    assert model.tables["word"].any() and model.tables["gram"].any()
    odd = [b"", b" .,", b"vile", "straße VILE é".encode(), " ".join(words(rng, 150, 60)).encode(), b"x" * 5000, *texts[:5]]
    got = toxicity.score_texts(model, odd)
    for t, s in zip(odd, got, strict=True):
        assert abs(plain_score(model, t) - s) < 1e-4


def test_window_starts_cover_all_words():
    offsets = np.array([0, 0, 5, 5 + 32, 5 + 32 + 33, 5 + 32 + 33 + 100])
    starts, text = toxicity.window_starts(offsets)
    for t in range(5):
        own = starts[text == t]
        assert len(own) == 0 if offsets[t] == offsets[t + 1] else own[0] == offsets[t] and own[-1] + toxicity.WINDOW >= offsets[t + 1] and (np.diff(own) == toxicity.STRIDE).all()


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        own, bad = words(rng, rng.randrange(5, 90), 300), i % 5 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["vilely", "vilest", "vileness", "nastyish", "nastier"])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, t) for i, t in odd_rows() if i] + [(None, "null id")]
    table = spark.createDataFrame([*labels, (3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs(spark, rows, "score predicted"), table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    kept = toxicity.keep_civil(docs(spark, rows), table)
    assert kept.count() == sum(r.predicted == 0 for r in got)
    assert {r.score for r in toxicity.score(docs(spark, rows[:3]), table.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs(spark, []), table).count() == 0


# ---- HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav><a>Home</a></nav><div class="ad">buy</div>
<article><header><h1>Big &amp; small</h1></header><p>One  two<br>three&nbsp;four<p>five <b>six</b>!<div class="share">like</div><ul><li>a<li>b</ul><aside>side</aside><div id="comments"><p>no</div><form>f</form><!-- x --></article><footer>&copy; me</footer>"""


def test_html_main_text(spark):
    rows = [(1, "http://h/1", PAGE), (2, "http://h/2", None), (3, None, ""), (4, "x", "<article><p>cut of"), (5, "x", "<article>a &am"), (6, "x", "<p>open <i>page</i></p><p>"), (7, "x", "<article>t <a href='x"), (8, "x", "no tags & all"), (9, "x", "<div hidden>z</div><main>m</main>tail"), (9, "x", "<main>m</main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = sorted((r.page_id, r.text) for r in html_main.main_text(pages).collect())
    assert got == [(1, "Big & small\n\nOne two three four\n\nfive six!\n\na\n\nb"), (2, ""), (3, ""), (4, "cut of"), (5, "a &am"), (6, "open page"), (7, "t"), (8, "no tags & all"), (9, "m"), (9, "m")]
    assert html_main.main_text(pages.limit(0)).count() == 0


def test_comments_go_and_words_that_only_look_like_marks_stay(spark):
    page = """<article class="post"><p class="ad-hoc">one</p><p id="social-security">two</p><div class="notice-period">three</div><p class="menus">four</p>
    <div class="cookie-notice">x</div><div class="ad-slot-3">x</div><section id="post-comments">x</section><article class="comment">x<p>y</p></article><div class="sidebar">x</div></article>"""
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", "<article class='comment-free note'><p>kept</p></article>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_main.main_text(pages).collect()} == {1: "one\n\ntwo\n\nthree\n\nfour", 2: "kept"}


def test_long_and_deep_pages(spark):
    rng = random.Random(2)
    rows = [(1, "http://h/1", "<div>" * 100_000 + "deep" + "</div>" * 100_000), (2, "http://h/2", "</section>" * 100_000 + "<p>after</p>"), (3, "http://h/3", "<main>" + "".join(f"<p>{' '.join(words(rng, 50, 10**6))}</p>" for _ in range(4000)) + "</main>"), (4, "http://h/4", "<div>" * 50_000 + "</p>" * 50_000 + "x")]
    began = time.perf_counter()
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "deep" and got[2] == "after" and len(got[3].split()) == 200_000 and got[4] == "x" and time.perf_counter() - began < 60


def test_a_host_in_many_chunks_is_judged_as_one(spark, monkeypatch):
    rng = random.Random(12)
    lines = [" ".join(words(rng, 9, 10**6)) for _ in range(30)]
    page = lambda i: "".join(f"<p>{' '.join(words(random.Random(i), 20, 10**6))}</p>" + f"<div>{lines[i % 30]}</div>" * (i % 2))
    rows = [(i, f"http://h{i % 3 == 0}/x", page(i)) for i in range(150)] + [(None, "http://hTrue/x", page(3))] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: sorted((r.page_id or -1, r.text) for r in html_main.main_text(pages).collect())
    whole = texts()
    monkeypatch.setattr(html_main, "CHUNK_BYTES", 2000)
    assert texts() == whole and len(whole) == 190
    assert any(all(x not in t for x in lines) and i % 2 for i, t in whole) and any(x in t for i, t in whole for x in lines)


def test_host_suffix_array_removes_what_pages_repeat(spark):
    menu = "<div>home about us contact imprint legal privacy terms and more of these words</div>"
    rows = [(i, "https://H.example/x", f"{menu}<p>page {i} says " + " ".join(words(random.Random(i), 30, 9999)) + f"</p>{menu}") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html_main.main_text(pages).collect():
        assert "privacy" not in r.text and len(r.text.split()) >= 28
    alone = html_main.main_text(pages.limit(2)).collect()
    assert all("privacy" in r.text for r in alone)


def test_marked_pages_lose_blocks_that_their_host_repeats(spark):
    notice = "our weekly letter brings the best of this site to your mail box"
    shared = words(random.Random(99), 60, 9999)
    own = [" ".join(words(random.Random(i), 30, 9999)) for i in range(12)]
    quote = " ".join(shared[:10])
    rows = [(i, "http://h/x", f"<main><h1>page {i}</h1><p>{own[i]} {quote} {own[i][::-1]}</p><div>{notice}</div></main>") for i in range(12)]
    rows += [(20 + i, "http://h/x", f"<article>{' '.join(shared)}</article>") for i in range(5)]
    rows += [(30 + i, "http://h/x", f"<article><p>{' '.join(shared)}</p><p>{i}</p></article>") for i in range(5)]
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"page {i}\n\n{own[i]} {quote} {own[i][::-1]}"
    for i in range(5):
        assert got[20 + i] == " ".join(shared) and got[30 + i] == " ".join(shared) + f"\n\n{i}"


def test_repeats_count_over_the_whole_host(spark):
    block = "our weekly letter brings the best of this site to your mail box"
    page = lambda i, more="": f"<p>page {i} {' '.join(words(random.Random(i), 30, 10**6))}</p>{more}"
    few = [(i, "http://h/x", page(i, f"<div>{block}</div>")) for i in range(40)]
    rows = few + [(i, "http://h/x", page(i)) for i in range(100, 1060)]
    far = [(2000 + i, "http://far/x", page(i, f"<div>{block}</div>")) for i in range(4)] + [(2100 + i, "http://far/x", " ".join(words(random.Random(i), 60_000, 10**6))) for i in range(20)]
    text = lambda part: {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(part, "page_id long, url string, html string")).collect()}
    alone, whole = text(few), text(rows + far + [(3000, "http://other/", page(0, f"<div>{block}</div>"))])
    assert all(whole[i] == alone[i] and block not in alone[i] for i in range(40))
    assert all(block not in whole[2000 + i] for i in range(4)) and block in whole[3000]


def covered_brute(pages):
    """For each page which tokens lie in a sampled start or a whole block that three sources have, by comparing tokens themselves."""
    run, step = html_main.RUN, html_main.STEP
    entries = []
    for blocks in pages:
        own = " ".join(t for t, _ in blocks).split()
        h = tokens.Words().hash_documents([" ".join(own).encode()])[0]
        w = tokens.window_hashes(h, run).tolist()
        picked = {min(range(i, min(i + step, len(w))), key=lambda j: (w[j], j)) for i in range(max(1, len(w) - step + 1))} if w else set()
        found, at = {(i, i + run) for i in picked}, 0
        whole = set()
        for t, _ in blocks:
            n = len(t.split())
            if n >= run:
                whole.add((at, at + n))
            at += n
        entries.append((own, found, whole))
    where = {}
    for (own, found, whole), blocks in zip(entries, pages, strict=True):
        for kind, spans in (("start", found), ("block", whole)):
            for a, b in spans:
                where.setdefault((kind, tuple(own[a:b])), set()).add(html_main.source_of(blocks))
    out = []
    for own, found, whole in entries:
        covered = np.zeros(len(own), bool)
        for kind, spans in (("start", found), ("block", whole)):
            for a, b in spans:
                if len(where[kind, tuple(own[a:b])]) >= html_main.LEAST_PAGES:
                    covered[a:b] = True
        out.append(covered)
    return out


def test_main_text_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, "http://h/x", "".join(f"<p>{' '.join(words(rng, rng.randrange(1, 40), 2))}</p>" for _ in range(3))) for i in range(30)]
    lines = [" ".join(words(rng, rng.randrange(6, 30), 10**6)) for _ in range(12)]
    rows += [(100 + i, "http://h/x", f"<main><h1>{i}</h1>" + "".join(f"<p>{rng.choice(lines)} {' '.join(words(rng, rng.randrange(0, 12), 10**6))}</p>" for _ in range(6)) + "</main>") for i in range(40)]
    parsed = [html_main.streams_of(p) for *_, p in rows]
    covered = covered_brute([b for b, _ in parsed])
    want = {i: html_main.kept_text(b, m, c, np.cumsum([len(t.split()) for t, _ in b])) for (i, *_), (b, m), c in zip(rows, parsed, covered, strict=True)}
    got = {r.page_id: r.text for r in html_main.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and any(c.any() for c in covered) and not all(c.all() for c in covered)


def test_long_repeats_are_covered_but_for_their_edges():
    rng = random.Random(5)
    least = html_main.RUN + html_main.STEP - 1
    for n in range(least, least + 25):
        shared = words(rng, n, 10**6)
        pages = [[(" ".join(words(rng, rng.randrange(20, 40), 10**6) + shared + words(rng, rng.randrange(20, 40), 10**6)), True)] for _ in range(3)]
        for blocks, covered in zip(pages, covered_brute(pages), strict=True):
            own = blocks[0][0].split()
            at = next(i for i in range(len(own)) if own[i : i + n] == shared)
            assert covered[at : at + n].sum() >= n - 2 * (html_main.STEP - 1) > 0 and covered.sum() == covered[at : at + n].sum()


def test_tokenizer_lowering():
    w = tokens.Words(tokens.NON_ALNUM_BYTES, lower=True)
    assert w.hash_one("Ab1é") == w.hash_one("aB1é") != w.hash_one("ab1É")
    assert license_scan.words_of("A-b c_É") == ["a", "b", "c", "É"] and lowered("É A") == "É a"


def test_pseudonyms_of_dates_in_both_orders_stay_apart(spark):
    from datetime import datetime

    day = F.expr("date_add(date'1999-01-01', cast(id as int))")
    days = spark.range(6500).select(F.explode(F.array(F.date_format(day, "dd/MM/yyyy"), F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd.MM.yyyy"))).alias("text")).distinct()
    days = days.union(spark.createDataFrame([(x,) for x in ("01/13/1800", "12/31/1800", "12/31/2199", "02/29/2000", "29/02/2000", "02/28/1900", "31/12/2199")], "text string")).distinct()
    got = {r.found[0]: r.text for r in pii.pseudonymise(days, "k").where("size(found) > 0").collect()}

    def order(text):
        try:
            datetime.strptime(text[:10].replace(".", "/"), "%d/%m/%Y")
        except ValueError:
            datetime.strptime(text, "%m/%d/%Y")
            return "month first", "/"
        return "day first", text[2]

    assert len(got) == len(set(got.values())) == days.count()
    assert all(order(a) == order(b) for a, b in got.items())
    assert {got[x] for x in ("01/13/1800", "12/31/2199")}.isdisjoint({"01/13/1800", "12/31/2199"})


def test_late_dates_are_permuted_onto_themselves(spark):
    """Every month-first date of ten years, by plain Python."""
    from datetime import date, timedelta

    first = date.fromisoformat(pii.CYCLE_FROM)
    late = [d for d in (first + timedelta(n) for n in range(pii.CYCLE)) if d.day > 12]
    assert len(late) == pii.LATE == pii.LATE_L * pii.LATE_R
    rank = {d: i for i, d in enumerate(late)}
    some = [d for d in late if d.year in (1800, 1899, 1900, 2000, 2024, 2199)]
    rows = spark.createDataFrame([(d.strftime("%m/%d/%Y"),) for d in some], "text string")
    got = {r.found[0]: r.text for r in pii.pseudonymise(rows, "k").collect()}
    want = {d.strftime("%m/%d/%Y"): late[number_plain(rank[d], pii.LATE_L, pii.LATE_R, "k", "late date")].strftime("%m/%d/%Y") for d in some}
    assert got == want


def test_warc_of_two_payloads_under_one_id(spark):
    a, b = "A" * 120, "B" * 120
    rows = spark.createDataFrame([(5, "u", a), (5, "u", b), (7, "u", a), (8, "u", b)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_digest) for r in warc.round_trip(rows).collect())
    da, db = (hashlib.sha256(x.encode()).hexdigest() for x in (a, b))
    assert got == sorted([(5, "response", 0, da), (5, "response", 0, db), (7, "revisit", 5, da), (8, "revisit", 5, db)])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>A</p><span class="ad">Buy</span><p>B</p></article>', "A\n\nB"),
        ('<article><p>A <button>Share</button> B</p><label>x</label><p>C <span class="ad"><span>in</span> out</span> D</p></article>', "A B\n\nC D"),
        ('<main><p>one <span class="ad">two<p>three</main><div>four</div>', "one"),
        ("<p>a <span hidden>b", "a"),
        ("<div>x<i>y</i>z</div><ul><li>1<li>2</ul>tail", "xyz\n\n1\n\n2\n\ntail"),
        ('<main><p>a<select><option>o</option></select>b</p><em class="promo">c<em>d</em>e</em><p>f</p></main>', "ab\n\nf"),
    ],
)
def test_dropped_inline_elements_leave_no_text(page, want):
    blocks, _ = html_main.streams_of(page)
    assert "\n\n".join(t for t, is_open in blocks if is_open) == want

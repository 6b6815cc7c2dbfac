import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.functions import fixed
from ledgerloom.functions import scalars as S
from ledgerloom.functions.text import Labels, match_places
from ledgerloom.operators import extract, jobs, labeling, merge, register, validate
from ledgerloom.plans import catalog, coverage
from ledgerloom.sources import readers, sinks, versioned
from ledgerloom.streaming import microbatch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)


@needs_data
@pytest.mark.parametrize("name", [n for n in catalog.ORACLE | coverage.ORACLE if n not in ("gst_register_totals", "extract_fields_v1", "freight_records", "freight_records_v1")])
def test_query_equals_sql(spark, duck, name):
    df = (catalog.QUERIES | coverage.QUERIES)[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    ran = duck.execute((catalog.ORACLE | coverage.ORACLE)[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall())


@needs_data
def test_entry_points(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalog.QUERIES) | set(coverage.QUERIES) <= set(queries) and set(sql) <= set(queries) and set(coverage.QUERIES) == set(coverage.ORACLE)
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def record(spark, **fields):
    return validate.with_fields(spark.createDataFrame([(1, *fields.values())], "id int, " + ", ".join(f"{k} string" for k in fields)))


def processed(spark, **fields):
    return validate.post_process(record(spark, **fields)).first().asDict()


def test_record_pass(spark):
    got = processed(spark, GSTIN_S="29ABCDE1234F1Z5", GSTIN_R="29ZZZZZ1234F1Z5", PLACE="Karnataka", TAXABLE="1,000", CGST="90.00", SGST="1000.00", IGST="40", HSN="4017, 1002, 2019, 8302", QTY="4017", INV_DATE="20-Dec-20", OA_DATE="x", raw_text="Total 12 NOS", PAN="AB8DE1234F", GST_RATE="")
    assert (got["SGST"], got["IGST"], got["TOTAL_GST"], got["TOTAL"], got["CGST_RATE"], got["GST_RATE"]) == ("90.00", None, "180.00", "1180.00", "9%", "18%")
    assert (got["HSN"], got["QTY"], got["INV_DATE"], got["PAN"], got["STATE_CODE"]) == ("4017, 8302", "12", "20-Dec-2020", "ABBDE1234F", "29")
    assert got["TOTAL_WORDS"] == "One Thousand One Hundred Eighty Rupees Only"


def test_interstate_record(spark):
    got = processed(spark, GSTIN_S="29ABCDE1234F1Z5", GSTIN_R="27ZZZZZ1234F1Z5", TAXABLE="200.00", TOTAL_GST="36.00", raw_text="")
    assert (got["IGST"], got["CGST"], got["IGST_RATE"], got["TOTAL"]) == ("36.00", None, "18%", "236.00")
    by_place = processed(spark, GSTIN_S="29ABCDE1234F1Z5", PLACE="Goa", TAXABLE="200.00", GST_RATE="5%", raw_text="")
    assert (by_place["IGST"], by_place["TOTAL_GST"], by_place["TOTAL"]) == ("10.00", "10.00", "210.00")
    assert processed(spark, raw_text=None)["TOTAL"] is None


def test_gstin_and_names(spark):
    raw = "GSTIN: 29ABCDE1234F1Z5\nBuyer (Bill to)\nSome Trader\n12"
    got = processed(spark, GSTIN_S="27ZZZZZ1234F1Z5", raw_text=raw, SUPPLIER="ACME LTD in words: two Rupees", RECIPIENT="customer order")
    assert (got["GSTIN_S"], got["GSTIN_R"], got["SUPPLIER"], got["RECIPIENT"]) == ("29ABCDE1234F1Z5", "27ZZZZZ1234F1Z5", "ACME LTD two", "Some Trader")


TEXT = """Ack No.
: 112010036563310
Ack Date : 21-Dec-20
Challan No. 55
E-Way Bill No. 123456789012
Transport ID
29AACCT3705E000
Vehicle No: KA01AB1234
Dispatched
Dispatch From
0724
Vendor Code: 4321
CIN U12345KA1999PTC000001
LUT Bond No: AD1234567
MSME NO: 123456789
Payment Terms: Net thirty days
OA No: rTP/18-19
UPI ID
shop@bank
• 1692 Invoice
Dated
x
20-Dec-20
Invoice No
SHB/456/20
GSTIN: 27ABCDE1234F1Z5 PAN: ABCDE1234F
4017
8302 j
Place of Supply: DL (07)
TAX TOTAL 90.50 90.50
Amount Due 1,181.00
M/S Buyer One, Road 5
For ACME TOOLS LTD
IRN: 0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef"""


def test_field_rules(spark):
    got = extract.two_pass(spark.createDataFrame([(TEXT,), (None,), ("",)], "raw_text string")).collect()
    first = got[0].asDict()
    want = {
        "ACK_NO": "112010036563310", "ACK_DATE": "21-Dec-20", "CHALLAN_NO": "55", "EWAY_BILL": "123456789012", "TRANSPORT_ID": "29AACCT3705E000", "VEHICLE_NO": "KA01AB1234", "DISPATCH_FROM": "0724", "VENDOR_CODE": "4321", "CIN": "U12345KA1999PTC000001", "LUT_BOND": "AD1234567",
        "MSME_NO": "123456789", "OA_NO": "ITP/18-19", "UPI_ID": "shop@bank", "CUST_ORDER": "1692", "INV_DATE": "20-Dec-2020", "INV_NO": "SHB/456/20", "GSTIN_S": "27ABCDE1234F1Z5", "PAN": "ABCDE1234F", "PLACE": "Delhi", "CGST": "90.50", "SGST": "90.50", "TOTAL_GST": "181.00",
        "TOTAL": "1181.00", "SUPPLIER": "ACME TOOLS LTD", "HSN": "8302", "STATE_CODE": "27", "PAYMENT_TERMS": "Net thirty days", "IRN": "0123456789abcdef" * 4, "GSTIN_R": None,
    }
    assert {k: first[k] for k in want} == want
    assert all(v is None for row in got[1:] for k, v in row.asDict().items() if k != "raw_text")


def test_merging(spark):
    pages = spark.createDataFrame([(1, 2, {"A": "late", "B": "b"}), (1, 1, {"A": "early", "B": ""}), (2, 1, None)], "id int, page int, rec map<string,string>")
    assert {r.id: r.rec for r in merge.merge_pages(pages, "id", "page", "rec").collect()} == {1: {"A": "early", "B": "b"}}
    ents = spark.createDataFrame([({"QTY": "15", "INV_DATE": "soon", "SUPPLIER": "ĠACME", "GSTIN_S": "29ABCDE1234F1Z5", "RATE": "x", "PLACE": "Goa", "CGST_RATE": "9%", "TAN": "a"},)], "e map<string,string>")
    assert set(ents.select(merge.valid_entities(F.col("e")).alias("v")).first().v) == {"QTY", "GSTIN_S", "PLACE", "CGST_RATE"}


def test_registers_and_sheets(spark, tmp_path):
    rows = validate.with_fields(spark.createDataFrame([("a.pdf", "S & Co", "10.00", "bad"), ("b.pdf", None, "5.50", "2")], "file string, SUPPLIER string, TAXABLE string, TOTAL string"))
    total = register.total_row(rows).first()
    assert (total.invoices, float(total.TAXABLE), float(total.TOTAL)) == (2, 15.5, 2.0)
    assert [(r.section, r.label, r.value) for r in register.sections(rows.where("file = 'a.pdf'"), "file").orderBy("ordinal").collect()][0] == ("Supplier Details", "Supplier Name", "S & Co")
    assert register.filled_sections(rows, "file").count() == 3
    path = sinks.batch_workbook(rows, str(tmp_path / "b.xlsx"), "file", "file")
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        assert b"TOTALS (2 invoices)" in z.read("xl/worksheets/sheet1.xml") and b"S &amp; Co" in z.read("xl/worksheets/sheet2.xml") and len(z.namelist()) == 7
    sinks.invoice_workbook(rows.where("file = 'a.pdf'"), str(tmp_path / "i.xlsx"), "file")
    assert sinks.sheet_name("x/" + "n" * 40 + ".pdf") == "n" * 28 and sinks.sheet_name("a.b", ["A"]) == "a~2"
    assert sinks.column_letters(28) == "AB"
    assert len(fixed.REGISTER) + 2 == 21 and len(fixed.LABELS) == 37


def test_job_queries(spark):
    versions = spark.createDataFrame([(1, True), (2, False)], "version int, is_active boolean")
    assert sorted(map(tuple, jobs.next_version(versions).collect())) == [(1, False), (2, False), (3, True)]
    assert jobs.next_version(versions.limit(0)).first().version == 1
    one = spark.range(1).select(jobs.progress(F.lit(1), F.lit(3)).alias("a"), jobs.progress(F.lit(0), F.lit(0)).alias("b"), jobs.needs_full_retrain(F.lit(81), F.lit(2)).alias("c")).first()
    assert tuple(one) == (33, 0, True)
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, jobs.upsert(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, jobs.insert_absent(old, new, "id").collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_labelling(spark, tmp_path):
    rec = record(spark, GSTIN_S="29ABCDE1234F1Z5", INV_NO="INV/1", TAXABLE="100.00", SUPPLIER="ACME TOOLS", HSN="4017", INV_DATE="20/12/2020", raw_text="29ABCDE1234F1Z5 INV/1 100.20 9% TOOLS ACME 4017 20/12/2020 other")
    got = labeling.weak_labels(rec, ["id"], "raw_text")
    assert [r.label for r in got.orderBy("pos").collect()] == ["B-GSTIN_S", "B-INV_NO", "B-TAXABLE", "B-CGST_RATE", "I-SUPPLIER", "B-SUPPLIER", "B-HSN", "B-INV_DATE", "O"]
    sinks.write_labels(got.withColumn("doc", F.lit("d1")), str(tmp_path / "labels"), "doc")
    boxes = spark.range(1).select(labeling.word_boxes(F.lit("aa bbbb c"), F.lit(0), F.lit(1), F.lit(100), F.lit(2)).alias("w"), labeling.valid_box(F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(3))).alias("bad")).first()
    assert [(w.word, w.box) for w in boxes.w] == [("aa", [0, 1, 28, 2]), ("bbbb", [28, 1, 85, 2]), ("c", [85, 1, 99, 2])] and not boxes.bad
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (0, 0), (-100, 1)], "t int, g int")
    assert abs(labeling.macro_f1(pairs, "t", "g").first().macro_f1 - 2 / 3) < 1e-6


def test_word_boxes_of_all_lines(spark, tmp_path):
    texts = [(1, "aa bbbb c\n\n  dd  e"), (2, None), (3, "\n" * 50 + "last"), (4, "one")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalog.word_boxes(spark, str(tmp_path)).collect())
    assert got == [
        (1, 0, 0, 0, "aa", 100, 40, 328, 60), (1, 0, 0, 1, "bbbb", 328, 40, 785, 60), (1, 0, 0, 2, "c", 785, 40, 899, 60), (1, 0, 2, 0, "dd", 100, 80, 633, 100), (1, 0, 2, 1, "e", 633, 80, 899, 100),
        (3, 1, 50, 0, "last", 100, 120, 900, 140), (4, 0, 0, 0, "one", 100, 40, 900, 60),
    ]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in (("1.txt", "a\tO\nb\tB-HSN\n"), ("x.pdf", "p")):
        (tmp_path / "in" / name).write_text(text)
    assert {(r.doc_id, r.word, r.label) for r in readers.label_files(spark, str(tmp_path / "in")).collect()} == {("1", "a", "O"), ("1", "b", "B-HSN")}
    assert readers.files(spark, str(tmp_path / "in"), ["pdf"]).count() == 1
    gate = readers.upload_gate(spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.png", 30 << 20)], "path string, length long"))
    assert {r.path: r.gate for r in gate.collect()} == {"a.PDF": "accepted", "b.exe": "skipped", "c.png": "skipped"}
    best = readers.longest_layout(spark.createDataFrame([(1, "aa", 0), (1, "bb", 1), (1, " c ", 2)], "id int, t string, o int"), "id", "t", "o").first()
    assert best.t == "aa"
    joined = spark.range(1).select(readers.acquire_text(F.lit("x" * 81), F.array(F.lit("p1"), F.lit("p2"))).alias("t")).first().t
    assert joined == "x" * 81 + "\np1\np2"


def test_jobs_wait_until_there_are_enough_and_train_once(spark, tmp_path):
    folder, point, out, trained, fails = str(tmp_path / "in"), str(tmp_path / "cp"), [], [], [True]
    jobs_of = lambda a, b: spark.range(a, b).select("id", (F.col("id") % 4 == 0).alias("fake"))
    schema = jobs_of(0, 1).schema

    def train(rows, version):
        if fails and version == 2:
            fails.clear()
            raise ValueError("the training broke off")
        trained.append((version, sorted(r.id for r in rows.collect())))

    consume = microbatch.threshold_consumer(out, 5, "id", str(tmp_path / "state"), train, "fake")
    run = lambda: microbatch.run_available(spark.readStream.schema(schema).parquet(folder), consume, point)
    jobs_of(0, 5).write.parquet(folder)
    run()
    jobs_of(5, 8).write.mode("append").parquet(folder)
    run()
    jobs_of(8, 20).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="broke off"):
        run()
    run()
    run()
    assert out == [(0, 2, 3, False, None), (1, 0, 6, True, 1), (2, 3, 9, True, 2)]
    assert trained == [(1, [1, 2, 3, 5, 6, 7]), (2, [i for i in range(8, 20) if i % 4])]


def test_random_split(spark):
    for n in (0, 1, 2, 5, 300):
        got = labeling.random_split(spark.range(n).withColumn("split2", F.lit(1)), "id").collect()
        train, val = ([r.id for r in got if r.split == x] for x in ("train", "val"))
        assert len(set(train)) == len(train) == (max(1, int(n * 0.8)) if n else 0) and len(set(val)) == len(val)
        assert set(train) | set(val) == set(range(n)) and (len(val) == n - len(train) if n > 1 else set(val) == set(train))
    other = labeling.random_split(spark.range(300), "id", "other seed").where("split = 'val'")
    assert {r.id for r in other.collect()} != set(val)


def test_tenant_rules_are_opt_in(spark):
    text = "For Surabhi Hardwares and Sons 7\nFor ACME TOOLS LTD\nSold To\n30 K BN of somewhere\n"
    rows = spark.createDataFrame([(text,)], "t string")
    own, tenant = (rows.select(*[v.alias(k) for k, v in extract._parties(F.col("t"), on).items()]).first() for on in (False, True))
    assert (own.SUPPLIER, own.RECIPIENT) == ("ACME TOOLS LTD", None)
    assert (tenant.SUPPLIER, tenant.RECIPIENT) == ("Surabhi Hardwares and Sons 7", "30 K BN of somewhere")


def test_service_rows_describe(spark):
    text = "9987 Repair of  a\n machine 2 Nos\n1 8302 Steel hinge 3 Nos"
    rows = spark.createDataFrame([(text, None, None, None, None)], "t string, _TRANSPORT_ID string, _DISPATCH_FROM string, _VENDOR_CODE string, _row_hsn string")
    for stage in extract._item_stages(F.col("t")):
        rows = rows.withColumns(stage)
    assert rows.first()._ITEM_DESC == "Steel hinge | Repair of a machine"


def test_labels_are_found_as_patterns_find_them(spark):
    texts = ["\nx TAX\nTotal\nTaxable Value: 5", "Tax total", "İİİ\nno label\n tax here", "", None, "ends with\ntotal"]
    words = ["total", "tax", "absent"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", Labels.index(F.col("t"), words).alias("at"), Labels(F.col("t"), Labels.index(F.col("t"), words), words).behind(("total", "tax"), lambda c: c).alias("behind")).collect()}
    assert [got[i].at for i in range(6)] == [[8, 2, 0], [1, 1, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0], [11, 0, 0]]
    assert [got[i].behind for i in range(6)] == ["x TAX\nTotal\nTaxable Value: 5", "Tax total", texts[2], None, None, "total"]


def test_marks_of_noise_rules_are_in_their_matches():
    import re

    samples = {r"\b(\d{4}),(\d{2})\b": "1234,56", r"(?<![\d%])%([0-9]{1,2})(?![%\d])": "x %9 y", r"Account\s*Number\s*;": "Account Number ;"}
    rules = {p for p, *_ in fixed.NOISE}
    assert set(fixed.NOISE_NEEDS) <= rules
    for pattern, text in samples.items():
        assert any(m in re.search(pattern, text, re.I)[0].lower() for m in fixed.NOISE_NEEDS[pattern])
    for pattern, marks in fixed.NOISE_NEEDS.items():
        literal = re.sub(r"\\s\*|\\b|\(\?[^)]*\)|\\(?=[.$])|[()]", "", pattern).lower()
        assert any(m in literal for m in marks) or "[" in pattern, pattern


def test_numbers_of_odd_orders(spark):
    rows = [(None, "b"), ("x", None), ("x", "a"), (None, None)] + [(f"k{i % 7}", f"v{i:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("_extra", F.lit(1))
    for ranges in (1, 5, 400):
        got = {(r.a, r.b): r.row_no for r in register.numbered(df, ["a", "b"], ranges=ranges).collect()}
        want = sorted(set(rows), key=lambda r: [(v is not None, v or "") for v in r])
        assert got == {r: i + 1 for i, r in enumerate(want)}
    assert register.numbered(df.limit(0), ["a", "b"]).count() == 0


def test_ranges_of_numbers_are_even(spark):
    got = register.numbered(spark.range(40_000).select((F.col("id") * 7919 % 40_000).alias("k")), ["k"], ranges=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.where("row_no <> k + 1").count() == 0 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_rounds_by_user_resume_and_ignore_what_came_before(spark, tmp_path):
    schema = "user long, id long, fake boolean"
    batches = [[(1, i, False) for i in range(3)] + [(2, 10, True)], [(1, 2, False), (1, 3, False), (1, 4, False), (2, 11, False)], [(1, 5, False), (1, 0, False), (2, 12, False), (2, 11, False)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        # each run is a query of its own, which finds the state of the one before
        microbatch.run_available(microbatch.keyed_rounds(stream, "user", "id", "fake", 5), microbatch.keep_batches(f"{tmp_path}/out"), f"{tmp_path}/at")
    got = spark.read.parquet(f"{tmp_path}/out")
    rounds = {(r.user, r.batch): (r.fakes, r.offered, r.taken, r.version) for r in got.where("id IS NULL").collect()}
    assert rounds == {(1, 0): (0, 3, False, None), (2, 0): (1, 0, False, None), (1, 1): (0, 5, True, 1), (2, 1): (0, 1, False, None), (1, 2): (0, 1, False, None), (2, 2): (0, 2, False, None)}
    used = sorted((r.id, r.version or 0) for r in got.where("id IS NOT NULL").collect())
    assert used == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (10, 0)]


def test_two_writers_and_a_reader_of_one_registry(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    registry = lambda: versioned.VersionedTable(spark, f"{tmp_path}/registry", "version int, is_active boolean")
    assert registry().number() == 0 and registry().read().count() == 0

    def write():
        own = registry()
        return [own.update(jobs.next_version) for _ in range(3)]

    def look():
        own, seen = registry(), []
        while not seen or seen[-1][0] < 6:
            n = own.number()
            seen.append((n, sorted(map(tuple, own.read(n).collect()))))
        return seen

    with ThreadPoolExecutor(3) as pool:
        a, b, seen = pool.submit(write), pool.submit(write), pool.submit(look)
        assert sorted(a.result() + b.result()) == [1, 2, 3, 4, 5, 6]
    # a state of number n has the versions up to n, the last alone active
    assert all(rows == [(v, v == n) for v in range(1, n + 1)] for n, rows in seen.result())
    registry().clean()
    assert registry().number() == 6 and registry().read().count() == 6


def test_a_failed_change_publishes_nothing(spark, tmp_path):
    store = versioned.VersionedTable(spark, f"{tmp_path}/store", "id long")
    store.update(lambda held: held.union(spark.range(3)))
    with pytest.raises(Exception, match="broken"):
        store.update(lambda held: held.select(F.raise_error(F.lit("broken")).cast("long").alias("id")))
    assert store.number() == 1 and store.read().count() == 3


def test_invoices_shuffle_lines_once(spark):
    """Neither the grouping to invoices nor the joins nor the dealing to tasks moves what was dealt by order."""
    from ledgerloom.plans import render

    plan = render.papers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "hashpartitioning(l_orderkey" in moved[0]


def test_records_without_items_collect_none(spark):
    """Columns that a query on records doesn't use aren't made, shuffled or sorted."""
    from ledgerloom.plans import catalog

    for query in (catalog.tax_split, catalog.whole_register, catalog.tax_breakdown):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "row_number() windowspecdefinition(l_orderkey" not in plan


def test_numbered_registers_make_their_rows_once(spark):
    """Bounds, counts and numbers come from kept rows, not from the order tables again."""
    from ledgerloom.plans import catalog

    for query in (catalog.whole_register, catalog.numbered_invoices):
        assert "lineitem" not in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_invoices_are_not_broadcast(spark):
    for query in (catalog.tax_split, catalog.rate_snap, catalog.tax_reconcile):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        joined = next(line for line in plan.split("\n") if "Join [l_orderkey#" in line)
        assert "SortMergeJoin" in joined


def test_amounts_are_read_as_they_were(spark):
    texts = ["12", "12.5", "0", "0.00", "99999999999.9999", "99999999999999.99", "1.23456", "-3", "₹ 1,200.50", "5d", "1e3", ".5", "5.", "", " 7 ", "x", "007.10", None]
    rows = spark.createDataFrame([(t,) for t in texts], "TAXABLE string")
    bare = F.btrim(F.regexp_replace("TAXABLE", "[₹,]", ""))
    old = F.when(bare.rlike(S.NUMBER), bare.try_cast("double").try_cast("decimal(18,4)"))
    assert all(r.a == r.b for r in rows.select(validate.money("TAXABLE").alias("a"), F.when(old != 0, old).alias("b")).collect())


@needs_data
def test_words_are_labelled_by_plain_columns(spark):
    plan = catalog.weak_labels(spark, SF)._jdf.queryExecution().executedPlan().toString()
    labelled = plan[: plan.index("Generate posexplode")]
    assert "lambda" not in labelled


@needs_data
def test_word_boxes_of_a_long_line(spark):
    words = ["a" * (i % 7 + 1) for i in range(20000)]
    got = spark.createDataFrame([(" " + " ".join(words),), (None,), ("",), ("one",)], "line string").select(labeling.word_boxes(F.col("line"), F.lit(0), F.lit(1), F.lit(900), F.lit(2)).alias("w"))
    rows, x, total = [r.w for r in got.collect()], 0, sum(map(len, words))
    for word, found in zip(words, rows[0], strict=True):
        width = 900 * len(word) // total
        assert (found.word, found.box) == (word, [x, 1, x + width, 2])
        x += width
    assert rows[1] is None and rows[2] == [] and [(w.word, w.box) for w in rows[3]] == [("one", [0, 1, 900, 2])]
    # appending to an array word by word took time by the square of a line's words
    assert "aggregate(" not in got._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_a_models_record_is_made_once(spark):
    plan = coverage.model_output(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan


@needs_data
def test_marks_carry_no_text(spark):
    plan = coverage.nearest_marks(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "substr(text" not in plan and "substring(text" not in plan
    text = "".join(f"{'x' * (i % 5)}." for i in range(300)) + "end"
    got = spark.createDataFrame([(text,)], "t string").select(match_places(F.col("t"), "[.]").alias("z")).first().z
    assert [(z.at, z.match) for z in got] == [(i, ".") for i, c in enumerate(text) if c == "."]

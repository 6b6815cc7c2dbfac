"""Workbooks of the executors: cells read back, long sheets, names, failed writers."""

import io
import os
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.operators import validate
from ledgerloom.sources import sinks
from ledgerloom.sources import workbooks as wb


def _records(spark):
    rows = [("x", "a.pdf", "S & Co", "10.00"), ("x", "a.pdf", "Other", "bad"), ("x", None, None, None), (None, "b.pdf", "T\x01<é>", "1234.5"), ("y/z", "c.pdf", "  ", "2")]
    return validate.with_fields(spark.createDataFrame(rows, "batch string, file string, SUPPLIER string, TOTAL string"))


def test_batches_come_back(spark, tmp_path):
    folder = str(tmp_path / "books")
    wb.write_books(wb.batch_books(_records(spark), "file", "batch"), folder, placed=True)
    wb.write_books(wb.batch_books(_records(spark).limit(0), "file", "batch"), folder)
    got = {}
    for r in wb.read_books(spark, folder).orderBy("path", "sheet_no", "line").collect():
        got.setdefault(os.path.basename(r.path), {}).setdefault(r.sheet, []).append(r.cells)
    assert sorted(got) == ["%none.xlsx", "x.xlsx", "y%2Fz.xlsx"]
    x = got["x.xlsx"]
    assert list(x) == ["Batch Register", "Sheet", "a", "a~2"]
    assert x["Batch Register"][0] == ["row_no", "file", *fixed.REGISTER]
    total = ["row_no", "file", *fixed.REGISTER].index("TOTAL")
    # nulls first, then by the records' fields; an amount that can't be read counts as 0
    assert [r[0] for r in x["Batch Register"][1:]] == ["1", "2", "3", "TOTALS (3 invoices)"] and x["Batch Register"][-1][total] == "10.00"
    assert x["Sheet"] == [["Field", "Value"]] and x["a"][1] == ["Supplier Name", "Other"] and x["a~2"][1] == ["Supplier Name", "S & Co"]
    assert got["%none.xlsx"]["b"][1] == ["Supplier Name", "T <é>"] and got["%none.xlsx"]["Batch Register"][-1][total] == "1,234.50"
    assert got["y%2Fz.xlsx"]["c"][1:] == [["Net Payable (₹)", "2"]]
    assert os.listdir(f"{folder}/{wb.PENDING}") == []


def test_batch_cells_cost_one_shuffle(spark):
    plan = wb.batch_books(_records(spark), "file", "batch")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_cells_of_one_batch_and_of_many(spark):
    rows = _records(spark)
    one = {(r.sheet, r.row, r.name): r.value for r in sinks.workbook_cells(rows.where("batch = 'x'"), "file").collect()}
    many = {(r.batch, r.sheet, r.row, r.name): r.value for r in sinks.workbook_cells(rows, "file", "batch").collect()}
    assert {k[1:]: v for k, v in many.items() if k[0] == "x"} == one
    assert one["Batch Register", 4, "row_no"] == "TOTALS (3 invoices)" and many[None, "Batch Register", 2, "TOTAL"] == "1,234.50" and many["y/z", "Batch Register", 1, "row_no"] == "1"


def test_invoices_have_five_sheets(spark, tmp_path):
    rows = _records(spark).where("SUPPLIER = 'S & Co'").withColumn("raw_text", F.lit("one\ntwo"))
    wb.write_books(wb.invoice_books(rows, "file"), str(tmp_path / "i"))
    got = wb.read_books(spark, str(tmp_path / "i")).orderBy("sheet_no", "line").collect()
    assert [s for s in dict.fromkeys(r.sheet for r in got)] == ["Summary", "Invoice Details", "Tax Breakdown", "GST Register", "Raw Text"]
    assert [r.cells for r in got if r.sheet == "Raw Text"] == [["line_no", "line"], ["3", "one"], ["4", "two"]]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 7])
def test_long_sheets_go_on(n):
    out = io.BytesIO()
    wb.write_book(out, (SimpleNamespace(sheet_no=0, sheet="t", cells=["head"] if i == 0 else [str(i)]) for i in range(n + 1)), 3)
    sheets = {}
    for _, name, _, cells in wb.read_book(io.BytesIO(out.getvalue())):
        sheets.setdefault(name, []).append(cells[0])
    assert all(len(s) <= 3 and s[0] == "head" for s in sheets.values()) and len(sheets) == max(1, -(-n // 2))
    assert [c for s in sheets.values() for c in s[1:]] == [str(i) for i in range(1, n + 1)]


def test_failed_writers_leave_nothing(spark, tmp_path):
    folder = str(tmp_path / "books")
    bad = spark.range(20).select(F.concat(F.lit("b"), "id").alias("book"), F.lit(0).cast("long").alias("sheet_no"), F.lit("s").alias("sheet"), F.col("id").alias("line"), F.when(F.col("id") < 19, F.array(F.lit("v"))).otherwise(F.array(F.raise_error(F.lit("lost")).cast("string"))).alias("cells"))
    with pytest.raises(Exception, match="lost"):
        wb.write_books(bad, folder)
    assert not [f for _, _, fs in os.walk(folder) for f in fs]
    with pytest.raises(Exception, match="appended"):
        spark.dataSource.register(wb.WorkbookSource)
        bad.where("id < 3").write.format("workbook").mode("overwrite").save(folder)


def test_names_are_distinct():
    names = wb.TabNames()
    assert [names(x) for x in ("a.pdf", "A.pdf", "a~2.pdf", "a.pdf")] == ["a", "A~2", "a~2~2", "a~3"]
    files = [wb.file_name(b) for b in (None, "%none", "none", "a/b", "a%2Fb", "x" * 300, "x" * 301)]
    assert len(set(files)) == len(files) and all(len(f) < 255 for f in files)


def test_sheets_are_read_without_a_tree(monkeypatch):
    """A sheet's rows come from parser events, not from a tree: cells with a place, rich text, stored values, shared texts and gaps."""
    out, main = io.BytesIO(), "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    cells = '<c r="B2" t="inlineStr"><is><r><t>a&amp;</t></r><r><t>b</t></r></is></c><c r="D2"><v>1.5</v></c><c t="s"><v>0</v></c><c/><c t="inlineStr"><is><t/></is></c>'
    sinks.write_workbook(out, [("one", [["x\x01\ty", None, "é"]])])
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>sh</t></si></sst>')
    with zipfile.ZipFile(out) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    parts["xl/worksheets/sheet1.xml"] = parts["xl/worksheets/sheet1.xml"].replace(b"</sheetData>", f'<row r="2">{cells}</row><row><c><v>7</v></c></row></sheetData>'.encode())
    again = io.BytesIO()
    with zipfile.ZipFile(again, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data)
    parsed, real = [], wb.ElementTree.iterparse
    monkeypatch.setattr(wb.ElementTree, "iterparse", lambda part, *a, **k: (parsed.append(part.name), real(part, *a, **k))[1])
    assert list(wb.read_book(again)) == [(1, "one", 1, ["x \ty", None, "é"]), (1, "one", 2, [None, "a&b", None, "1.5", "sh", None, ""]), (1, "one", 3, ["7"])]
    assert parsed == ["xl/sharedStrings.xml"]

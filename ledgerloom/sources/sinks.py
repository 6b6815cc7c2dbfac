"""Sinks: workbooks, records as JSON, label files, data sets, reports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable
from itertools import chain, groupby
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import register
from .readers import one_line

#: Rows of a sheet that the driver takes at most; larger registers stay Parquet or CSV.
SHEET_ROWS = 1_048_576
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def sheet_name(file: str, taken: Iterable[str] = ()) -> str:
    """A tab's name: the file's stem cut at 28 characters, without what sheets forbid, made distinct."""
    stem = file.rpartition("/")[2].rpartition(".")[0] or file
    base = "".join("_" if c in "[]:*?/\\" else c for c in stem)[:28] or "Sheet"
    name, n, used = base, 1, {t.lower() for t in taken}
    while name.lower() in used:
        n += 1
        name = f"{base[: 28 - len(str(n)) - 1]}~{n}"
    return name


#: Letters of the columns that registers have; wider rows make theirs.
_LETTERS = [column_letters(n) for n in range(1, 129)]
_CONTROL = {n: " " for n in range(32) if n not in (9, 10)}


def _row_xml(r: int, row: list) -> str:
    at = lambda c: _LETTERS[c] if c < len(_LETTERS) else column_letters(c + 1)
    cells = "".join([f'<c r="{at(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v.translate(_CONTROL) if v and not v.isprintable() else v)}</t></is></c>' for c, v in enumerate([None if v is None else str(v) for v in row]) if v is not None])
    return f'<row r="{r}">{cells}</row>'


def write_workbook(path: str | BinaryIO, sheets: Iterable[tuple[str, Iterable[list]]]) -> str | BinaryIO:
    """An xlsx file (or what is open for writing) of text cells, a sheet for each (name, rows); sheets are written one after the other, row by row."""
    names = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in sheets:
            names.append(name)
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for r, row in enumerate(rows, 1):
                    out.write(_row_xml(r, row).encode())
                out.write(b"</sheetData></worksheet>")
        numbers = range(1, len(names) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
    return path


def frame_rows(df: DataFrame) -> Iterable[list]:
    """Header and rows of a sheet-sized frame, fetched partition by partition."""
    yield df.columns
    for n, row in enumerate(df.toLocalIterator()):
        if n >= SHEET_ROWS - 1:
            raise ValueError("too many rows for a sheet; write Parquet or CSV instead")
        yield list(row)


def workbook_cells(records: DataFrame, file_col: str, batch: str | None = None) -> DataFrame:
    """A batch workbook as rows (sheet, row, name, value): the register by row number with its totals last, and label and value of every file. With ``batch``, a workbook for each, under its column."""
    kept = [batch] if batch else []
    numbered = register.batch_register(records, file_col, [file_col], batch)
    cells = lambda c: F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
    rows = numbered.select(*kept, F.lit("Batch Register").alias("sheet"), F.col("row_no").cast("int").alias("row"), F.inline(F.array(*[cells(c) for c in numbered.columns if c not in kept])))
    sums = register.register_totals(records, batch) if batch else register.total_row(records)
    totals = sums.select(*kept, "invoices", F.concat(F.lit("TOTALS ("), F.col("invoices").cast("string"), F.lit(" invoices)")).alias("row_no"), *[F.format_number(f, 2).alias(f) for f in fixed.REGISTER_SUMS])
    last = totals.select(*kept, F.lit("Batch Register"), (F.col("invoices") + 1).cast("int"), F.inline(F.array(*[cells(c) for c in ("row_no", *fixed.REGISTER_SUMS)])))
    tabs = register.sections(records.withColumn("_at", F.struct(*kept, F.col(file_col).alias("_file"))), "_at").select(*[f"_at.{c}" for c in kept], "_at._file", "ordinal", "label", "value")
    return rows.union(last).union(tabs)


def batch_workbook(records: DataFrame, path: str, file_col: str, key: str) -> str:
    """A batch's workbook: the register with totals, and a tab of label and value per invoice. Rows come to the driver one partition after the other and go into the file as they come."""
    ordered = register.batch_register(records, file_col, [file_col]).orderBy("row_no")
    total = register.shown_totals(register.total_row(records)).first().asDict()

    def sheet() -> Iterable[list]:
        yield from frame_rows(ordered)
        yield [f"TOTALS ({total['invoices']} invoices)" if i == 0 else total.get(c) for i, c in enumerate(ordered.columns)]

    def sheets() -> Iterable[tuple[str, Iterable[list]]]:
        names = {"batch register"}
        yield "Batch Register", sheet()
        rows = register.sections(records.withColumn("_file", F.col(file_col)), "_file").orderBy("_file", "ordinal").toLocalIterator()
        for file, own in groupby(rows, lambda r: r["_file"]):
            name = sheet_name(file, names)
            names.add(name.lower())
            yield name, chain([["Field", "Value"]], ([r["label"], r["value"]] for r in own))

    return write_workbook(path, sheets())


def invoice_workbook(record: DataFrame, path: str, key: str, text: str = "raw_text") -> str:
    """One invoice's five sheets."""
    return write_workbook(path, {
        "Summary": frame_rows(register.sections(record, key).orderBy("ordinal").drop(key)), "Invoice Details": frame_rows(register.invoice_details(record, key).drop(key)), "Tax Breakdown": frame_rows(register.tax_breakdown(record, key).orderBy("ordinal").drop(key)),
        "GST Register": frame_rows(register.hsn_register(record, key).orderBy("sl").drop(key)), "Raw Text": frame_rows(register.raw_lines(record, key, text).orderBy("line_no").drop(key)),
    }.items())


def write_records(df: DataFrame, path: str, fields: list[str]) -> None:
    """Records as one JSON object per line; empty fields are left out."""
    df.select(F.to_json(F.struct(*fields)).alias("value")).write.text(path)


def write_labels(words: DataFrame, folder: str, key: str, word: str = "word", label: str = "label", pos: str = "pos") -> None:
    """Tab-separated lines of document, word and label, a document's words in order in one file; many documents share a file."""
    lines = F.concat_ws("\t", one_line(F.col(key).cast("string")), one_line(F.col(word)), label)
    words.repartition(key).sortWithinPartitions(key, pos).select(lines.alias("value")).write.text(folder)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(doc, word, label) of what write_labels wrote."""
    got = F.split("value", "\t", 3)
    return spark.read.text(folder).select(F.get(got, 0).alias("doc"), F.get(got, 1).alias("word"), F.get(got, 2).alias("label"))


def write_samples(samples: DataFrame, folder: str, split: str = "split") -> None:
    """Training samples as JSON, a folder per split."""
    samples.write.partitionBy(split).json(folder)


def write_report(lines: DataFrame, path: str, value: str = "line") -> None:
    lines.select(value).write.text(path)

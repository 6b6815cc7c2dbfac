"""Workbooks written and read by the executors: a data source of format ``workbook``.

Cells are rows (book, sheet_no, sheet, line, cells). A book's rows lie in one task in the order of its sheets and lines and go into
its file as they come, so a task holds a row and the tabs' names. A file can't be divided: the largest book bounds the time of
its task, not its memory. A task writes to a folder of its own attempt; commit moves the folders of the tasks that succeeded to
where readers look, so failed and repeated attempts leave nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice
from typing import BinaryIO
from urllib.parse import quote
from xml.etree import ElementTree
from xml.parsers import expat

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import fixed
from ..functions.text import strip
from ..operators import register
from .sinks import SHEET_ROWS, sheet_name, write_workbook

CELLS = "book string, sheet_no long, sheet string, line long, cells array<string>"
READ = "path string, sheet_no int, sheet string, line int, cells array<string>"
PENDING = "_pending"


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; paths without a scheme are local ones, which all executors must see."""
    if re.match("^[A-Za-z][A-Za-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), os.path.abspath(folder)


def file_name(book: str | None) -> str:
    """A book's file: distinct for distinct books; long names are cut and keep a digest, no name at all is ``%none``."""
    name = "%none" if book is None else quote(book, safe=" ")
    return (name if len(name) <= 200 else f"{name[:100]}%-{hashlib.sha256(book.encode()).hexdigest()}") + ".xlsx"


class TabNames:
    """Distinct names of a book's tabs in one pass: a stem that comes again is numbered from where it was left."""

    def __init__(self):
        self.taken: set[str] = set()
        self.last: dict[str, int] = {}

    def __call__(self, name: str) -> str:
        base = sheet_name(name)
        got, n = base, self.last.get(base.lower(), 1)
        while got.lower() in self.taken:
            n += 1
            got = f"{base[: 28 - len(str(n)) - 1]}~{n}"
        self.last[base.lower()] = n
        self.taken.add(got.lower())
        return got


def _pages(lines: Iterator[list], limit: int) -> Iterator[Iterator[list]]:
    """A sheet's lines in pieces of at most ``limit`` lines, each under the first line."""
    head, first = next(lines), next(lines, None)

    def page(first: list | None) -> Iterator[list]:
        yield head
        if first is not None:
            yield first
            yield from islice(lines, limit - 2)

    while True:
        yield page(first)
        if (first := next(lines, None)) is None:
            return


def write_book(out: BinaryIO, rows: Iterator, limit: int = SHEET_ROWS) -> None:
    """One book from its ordered rows. A sheet of more lines than a sheet may have goes on in further tabs with the same first line."""
    names = TabNames()

    def sheets() -> Iterator[tuple[str, Iterator[list]]]:
        for (_, sheet), own in groupby(rows, key=lambda r: (r.sheet_no, r.sheet)):
            for page in _pages((r.cells for r in own), limit):
                yield names(sheet or "Sheet"), page

    write_workbook(out, sheets())


@dataclass
class Written(WriterCommitMessage):
    folder: str
    books: int


class BookWriter(DataSourceWriter):
    """A file per book; books of a task share a folder. Appends to what is there."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.job = folder, limit, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        store, root = store_of(self.folder)
        name, books = f"part-{uuid.uuid4().hex}", 0
        at = f"{root}/{PENDING}/{self.job}/{name}"
        store.create_dir(at, recursive=True)
        for book, rows in groupby(iterator, key=lambda r: r.book):
            with store.open_output_stream(f"{at}/{file_name(book)}") as out:
                write_book(out, rows, self.limit)
            books += 1
        return Written(name, books)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.folder)
        for m in messages:
            if m is not None and m.books:
                store.move(f"{root}/{PENDING}/{self.job}/{m.folder}", f"{root}/{m.folder}")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store_of(self.folder))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        """Removes what this job left: attempts that lost, or all of it."""
        at = f"{root}/{PENDING}/{self.job}"
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


@dataclass
class BookFiles(InputPartition):
    paths: list[str]


_TAG = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_MAIN = _TAG[1:]
_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(place: str) -> int:
    """A cell's column from 0 by its letters."""
    n = 0
    for c in place.rstrip("0123456789"):
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_lines(part: BinaryIO, shared: list[str]) -> Iterator[tuple[int, list[str | None]]]:
    """(line from 1, cells) of a sheet, read piece by piece; no tree is built of it."""
    parser, done = expat.ParserCreate(namespace_separator="}"), []
    parser.buffer_text = True
    line, cells, kind, texts, value, into = 0, [], None, [], None, None

    def start(tag: str, attributes: dict) -> None:
        nonlocal line, cells, kind, texts, value, into
        if tag == f"{_MAIN}t":
            into = texts
        elif tag == f"{_MAIN}c":
            place = attributes.get("r")
            cells += [None] * ((_column(place) if place else len(cells)) - len(cells))
            kind, texts, value = attributes.get("t"), [], None
        elif tag == f"{_MAIN}v":
            into = value = []
        elif tag == f"{_MAIN}row":
            line, cells = int(attributes.get("r") or line + 1), []

    def end(tag: str) -> None:
        nonlocal into
        if tag == f"{_MAIN}t" or tag == f"{_MAIN}v":
            into = None
        elif tag == f"{_MAIN}c":
            own = "".join(value) or None if value is not None else None
            cells.append("".join(texts) if kind == "inlineStr" else shared[int(own)] if kind == "s" and own else own)
        elif tag == f"{_MAIN}row":
            done.append((line, cells))

    def characters(text: str) -> None:
        if into is not None:
            into.append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    while piece := part.read(1 << 16):
        parser.Parse(piece, False)
        yield from done
        done.clear()
    parser.Parse(b"", True)
    yield from done


def read_book(source: BinaryIO) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """(sheet number, name, line from 1, cells) of every line of a workbook, a piece of a sheet in memory at a time; cells are texts as they are stored, absent ones null."""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_TAG}t"))
    with zipfile.ZipFile(source) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as part:
                shared = [text(e) for _, e in ElementTree.iterparse(part) if e.tag == f"{_TAG}si"]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_TAG}sheet"), 1):
            target = targets[sheet.get(_ID)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as part:
                for line, cells in _sheet_lines(part, shared):
                    yield n, sheet.get("name"), line, cells


class BookReader(DataSourceReader):
    """The files of the folder and of the folders in it, dealt to tasks by size, largest first; what a writer hasn't committed is not read."""

    def __init__(self, folder: str, tasks: int):
        self.folder, self.tasks = folder, tasks

    def partitions(self) -> list[BookFiles]:
        store, root = store_of(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        books = [f for f in found if f.path.endswith(".xlsx") and f"/{PENDING}/" not in f.path[len(root) :]]
        books.sort(key=lambda f: (-f.size, f.path))
        return [BookFiles([f.path for f in books[i :: self.tasks]]) for i in range(min(self.tasks, len(books)))]

    def read(self, partition: BookFiles) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path in partition.paths:
            with store.open_input_file(path) as source:
                for n, sheet, line, cells in read_book(source):
                    yield path, n, sheet, line, cells


class WorkbookSource(DataSource):
    """``format("workbook")``: reads (path, sheet_no, sheet, line, cells), writes CELLS. Options: ``sheetRows``, the most lines of a written sheet, and ``tasks``, the most tasks of a read."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> BookReader:
        return BookReader(self.options["path"], int(self.options.get("tasks", 64)))

    def writer(self, schema, overwrite: bool) -> BookWriter:
        if overwrite:
            raise ValueError("workbooks are appended; take a new folder to replace them")
        return BookWriter(self.options["path"], int(self.options.get("sheetRows", SHEET_ROWS)))


def write_books(cells: DataFrame, folder: str, placed: bool = False, sheet_rows: int = SHEET_ROWS) -> None:
    """Writes a workbook for each book of CELLS rows, on the executors. ``placed``: each book's rows lie in one partition already."""
    cells.sparkSession.dataSource.register(WorkbookSource)
    dealt = cells if placed else cells.repartition("book")
    ordered = dealt.sortWithinPartitions("book", "sheet_no", "sheet", "line")
    ordered.write.format("workbook").mode("append").option("sheetRows", sheet_rows).save(folder)


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet_no, sheet, line, cells) of all workbooks of a folder, committed ones only."""
    spark.dataSource.register(WorkbookSource)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.format("workbook").option("tasks", tasks).load(folder)


def _line(number: Column | int, sheet: Column | str, line: Column | int, cells: list[Column | str]) -> Column:
    as_text = [F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells]
    at = lambda c, kind: (F.lit(c) if isinstance(c, (int, str)) else c).cast(kind)
    return F.struct(at(number, "long").alias("sheet_no"), at(sheet, "string").alias("sheet"), at(line, "long").alias("line"), F.array(*as_text).alias("cells"))


def batch_books(records: DataFrame, file_col: str, batch: str) -> DataFrame:
    """The cells of a workbook per batch: the register with its totals, then a tab of labels and values per record, in the order of files.

    One pass and one shuffle: numbers, running sums and the last record of a batch come from one ordered window, which spills, and
    each record brings its own lines; the last one brings the totals. Records that share a file have a tab each. Rows of a null batch
    are a book of their own; without records there is none.
    """
    base = records.select(
        F.col(batch).cast("string").alias("book"), F.col(file_col).cast("string").alias("_file"), F.struct(*[F.col(f) for f in fixed.FIELDS]).alias("_r"),
        F.array(*[strip(F.coalesce(f, F.lit(""))) for f in fixed.REGISTER]).alias("_shown"),
        F.array(*[F.struct(F.lit(label).alias("label"), F.col(f).cast("string").alias("value")) for fields in fixed.SECTIONS.values() for f, label in fields.items()]).alias("_fields"),
        *[register.amount(f).alias(f"_sum_{f}") for f in fixed.REGISTER_SUMS],
    )
    order = W.partitionBy("book").orderBy("_file", "_r")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumns(
        {"_no": F.row_number().over(order), "_last": F.lead(F.lit(1)).over(order).isNull()} | {f"_sum_{f}": F.sum(f"_sum_{f}").over(running) for f in fixed.REGISTER_SUMS}
    )
    name, no = "Batch Register", F.col("_no")
    columns = ["row_no", "file", *fixed.REGISTER]
    totals = [F.concat(F.lit("TOTALS ("), no.cast("string"), F.lit(" invoices)")), *[F.format_number(f"_sum_{f}", 2) if f in fixed.REGISTER_SUMS else F.lit(None).cast("string") for f in columns[1:]]]
    row = F.struct(F.lit(0).cast("long").alias("sheet_no"), F.lit(name).alias("sheet"), no.cast("long").alias("line"), F.concat(F.array(no.cast("string"), F.col("_file")), F.col("_shown")).alias("cells"))
    tab = F.coalesce("_file", F.lit("Sheet"))
    filled = F.filter("_fields", lambda x: F.coalesce(strip(x["value"]) != "", F.lit(False)))
    lines = F.concat(
        F.when(no == 1, F.array(_line(0, name, 0, columns))).otherwise(F.array()), F.array(row), F.when(F.col("_last"), F.array(_line(0, name, no + 1, totals))).otherwise(F.array()),
        F.array(_line(no, tab, 0, ["Field", "Value"])), F.transform(filled, lambda x, i: _line(no, tab, i + 1, [x["label"], x["value"]])),
    )
    return placed.select("book", F.inline(lines))


def invoice_books(records: DataFrame, key: str, text: str = "raw_text") -> DataFrame:
    """The cells of a workbook per record: summary, details, tax breakdown, GST register and raw text. ``key`` tells records apart; records that share it share a book."""
    sheets = [
        ("Summary", register.sections(records, key), "ordinal"), ("Invoice Details", register.invoice_details(records, key), "sl_no"), ("Tax Breakdown", register.tax_breakdown(records, key), "ordinal"),
        ("GST Register", register.hsn_register(records, key), "sl"), ("Raw Text", register.raw_lines(records, key, text), "line_no"),
    ]
    book = F.col(key).cast("string").alias("book")
    heads = records.select(key).distinct().select(book, F.inline(F.array(*[_line(n, name, -1, [c for c in df.columns if c != key]) for n, (name, df, _) in enumerate(sheets)])))
    out = heads
    for n, (name, df, order) in enumerate(sheets):
        out = out.union(df.select(book, F.lit(n).cast("long"), F.lit(name), F.col(order).cast("long"), F.array(*[F.col(c).cast("string") for c in df.columns if c != key])))
    return out

"""Workbooks (XLSX) as a data source: ``spark.read.format("workbook").load(folder)``, a partition for each sheet.

Without a schema it gives the cells; with one it gives the rows below the header row of each sheet, of which only the
columns of the schema are read. Sheets are parsed as they are read, element by element, so a large one needs little
memory. Files are opened by pyarrow, where the driver lists them and where a sheet is read; a store that only Spark reads
goes through :func:`gridloom.sources.files.workbook_rows` instead.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

CELLS = "file string, sheet string, row int, col int, value string"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
Cell = tuple[int, int, str | None]


def place(reference: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", reference).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Titles of the sheets in order, with the names of their parts."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_LINK}id")].lstrip("/")
        out.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def shared_texts(part: BinaryIO | None) -> list[str]:
    if part is None:
        return []
    out = []
    for _, item in ElementTree.iterparse(part):
        if item.tag == f"{_SHEET}si":
            out.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
            item.clear()
    return out


def sheet_cells(part: BinaryIO, shared: list[str]) -> Iterator[tuple[str, int, int, int, int, str | None]]:
    """``(what, row, col, row2, col2, value)`` of the cells and merged ranges of a sheet; formulas by their kept value."""
    for _, e in ElementTree.iterparse(part):
        if e.tag == f"{_SHEET}c":
            row, col = place(e.get("r"))
            raw, kind = e.findtext(f"{_SHEET}v"), e.get("t")
            if kind == "s" and raw is not None:
                raw = shared[int(raw)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in e.iter(f"{_SHEET}t"))
            elif kind == "b" and raw is not None:
                raw = "True" if raw == "1" else "False"
            yield "cell", row, col, row, col, raw or None
        elif e.tag == f"{_SHEET}mergeCell":
            first, _, last = e.get("ref").partition(":")
            yield "merge", *place(first), *place(last or first), None
        elif e.tag == f"{_SHEET}row":
            e.clear()


SHARED = "xl/sharedStrings.xml"


def parse_workbook(content: bytes) -> Iterator[tuple[str, str, int, int, int, int, str | None]]:
    """``(what, sheet, row, col, row2, col2, value)`` of every cell and merged range."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = shared_texts(book.open(SHARED) if SHARED in book.namelist() else None)
        for title, part in sheets(book):
            for what, *rest in sheet_cells(book.open(part), shared):
                yield what, title, *rest


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, base = _store(path)
    if store.get_file_info(base).type == fs.FileType.File:
        return [path]
    if store.get_file_info(base).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".xlsx")]
    return sorted(path.rstrip("/") + f.removeprefix(base.rstrip("/")) for f in found)


@dataclass
class Sheet(InputPartition):
    file: str
    title: str
    part: str


def _convert(value: str | None, kind: str):
    if value is None:
        return None
    try:
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return int(float(value)) if float(value).is_integer() else None
        if kind in ("double", "float"):
            return float(value)
        if kind == "boolean":
            return {"true": True, "false": False}.get(value.lower())
    except ValueError:
        return None
    return value


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, cells: bool, header: int):
        self.path, self.cells, self.header = path, cells, header
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[Sheet]:
        out = []
        for file in _files(self.path):
            store, base = _store(file)
            with store.open_input_file(base) as f, zipfile.ZipFile(f) as book:
                out += [Sheet(file, title, part) for title, part in sheets(book)]
        return out

    def read(self, partition: Sheet) -> Iterator[tuple]:
        store, base = _store(partition.file)
        with store.open_input_file(base) as f, zipfile.ZipFile(f) as book:
            shared = shared_texts(book.open(SHARED) if SHARED in book.namelist() else None)
            cells = ((row, col, value) for what, row, col, _, _, value in sheet_cells(book.open(partition.part), shared) if what == "cell")
            if self.cells:
                yield from ((partition.file, partition.title, *c) for c in cells)
            else:
                yield from self._rows(cells)

    def _rows(self, cells: Iterator[Cell]) -> Iterator[tuple]:
        """Rows below the header; cells of columns that aren't asked for are passed over."""
        asked: dict[int, int] = {}
        names = {name.lower(): i for i, (name, _) in enumerate(self.columns)}
        at, values = None, [None] * len(self.columns)
        for row, col, value in cells:
            if row == self.header and value is not None:
                i = names.get(value.strip().lower())
                if i is not None and i not in asked.values():
                    asked[col] = i
            if row <= self.header:
                continue
            if row != at:
                if at is not None:
                    yield tuple(values)
                at, values = row, [None] * len(self.columns)
            if col in asked:
                values[asked[col]] = _convert(value, self.columns[asked[col]][1])
        if at is not None:
            yield tuple(values)


class WorkbookSource(DataSource):
    """Options: ``path``, a file or a folder of workbooks; ``header``, the row of the names, counted from zero."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(posixpath.normpath(self.options["path"]) if "://" not in self.options["path"] else self.options["path"], schema, [f.name for f in schema.fields] == [c.split()[0] for c in CELLS.split(", ")], int(self.options.get("header", "0")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)

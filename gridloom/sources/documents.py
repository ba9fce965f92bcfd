"""Text documents and slides (DOCX, PPTX) to rows: paragraphs with page and heading level, and the cells of tables.

Both are XML parts in a ZIP. A document's pages end at its page breaks, set by hand or noted when it was last laid out;
a slide is a page. Paragraphs in tables are cells and no paragraphs. A cell that goes on from the one above or beside it
belongs to a merged range.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
ROW = "path string, what string, page int, place int, level int, sheet string, row int, col int, row2 int, col2 int, value string"
#: ``(what, page, place, level, sheet, row, col, row2, col2, value)``
Row = tuple[str, int, int, int, str | None, int | None, int | None, int | None, int | None, str | None]


class _Rows:
    """Collects paragraphs, and tables cell by cell."""

    def __init__(self) -> None:
        self.rows: list[Row] = []
        self.page, self.place, self.tables = 1, 0, 0

    def paragraph(self, text: str, level: int) -> None:
        if text := " ".join(text.split()):
            self.rows.append(("text", self.page, self.place, level, None, None, None, None, None, text))
            self.place += 1

    def table(self, grid: Iterator[list[tuple[str, int, str]]]) -> None:
        """``grid`` gives for each cell of a row its text, how many columns it takes, and ``new``, ``down`` or ``right``."""
        self.tables += 1
        label, open_to, page = f"Table {self.tables}", {}, self.page
        ranges = []
        for row, cells in enumerate(grid):
            col = 0
            for text, width, kind in cells:
                if kind == "new":
                    self.rows.append(("cell", page, 0, 0, label, row, col, row, col, " ".join(text.split()) or None))
                    open_to[col] = at = [row, col, row, col + width - 1]
                    ranges.append(at)
                elif kind == "down" and col in open_to:
                    open_to[col][2] = row
                col += width
        self.rows += [("merge", page, 0, 0, label, r, c, r2, c2, None) for r, c, r2, c2 in ranges if (r, c) != (r2, c2)]


def _said(e: ElementTree.Element, space: str) -> str:
    """The text of an element: tabs and breaks are spaces."""
    return "".join((x.text or "") if x.tag == f"{space}t" else " " if x.tag in (f"{space}tab", f"{space}br") else "" for x in e.iter())


def parse_document(content: bytes) -> list[Row]:
    out = _Rows()
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_W}body")

    def grid(table: ElementTree.Element) -> Iterator[list[tuple[str, int, str]]]:
        for line in table.findall(f"{_W}tr"):
            cells = []
            for cell in line.findall(f"{_W}tc"):
                look = cell.find(f"{_W}tcPr")
                span = look.find(f"{_W}gridSpan") if look is not None else None
                goes_on = look.find(f"{_W}vMerge") if look is not None else None
                kind = "down" if goes_on is not None and goes_on.get(f"{_W}val", "continue") == "continue" else "new"
                cells.append((" ".join(_said(p, _W) for p in cell.iter(f"{_W}p")), int(span.get(f"{_W}val")) if span is not None else 1, kind))
            yield cells

    def walk(parent: ElementTree.Element) -> None:
        for e in parent:
            if e.tag == f"{_W}tbl":
                out.table(grid(e))
            elif e.tag == f"{_W}p":
                style = e.find(f"{_W}pPr/{_W}pStyle")
                name = (style.get(f"{_W}val") or "") if style is not None else ""
                found = re.fullmatch(r"(?i)heading\s?([1-9])", name)
                ends = sum(1 for x in e.iter() if x.tag == f"{_W}lastRenderedPageBreak" or (x.tag == f"{_W}br" and x.get(f"{_W}type") == "page"))
                first = next((x for x in e.iter() if x.tag in (f"{_W}t", f"{_W}br", f"{_W}lastRenderedPageBreak")), None)
                before = ends if first is not None and first.tag != f"{_W}t" else 0  # a break before any text
                out.page += before
                out.paragraph(_said(e, _W), int(found[1]) if found else 1 if name.lower() == "title" else 0)
                out.page += ends - before
            elif e.tag in (f"{_W}sdt", f"{_W}sdtContent"):
                walk(e)

    walk(body)
    return out.rows


def parse_slides(content: bytes) -> list[Row]:
    out = _Rows()
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        parts = sorted((int(m[1]), n) for n in book.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for out.page, (_, part) in enumerate(parts, 1):
            slide = ElementTree.fromstring(book.read(part))
            for shape in slide.iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    title = kind is not None and kind.get("type") in ("title", "ctrTitle")
                    for p in shape.iter(f"{_A}p"):
                        out.paragraph(_said(p, _A), 1 if title else 0)
                elif shape.tag == f"{_A}tbl":
                    out.table(
                        [(" ".join(_said(p, _A) for p in c.iter(f"{_A}p")), 1, "down" if c.get("vMerge") in ("1", "true") else "right" if c.get("hMerge") in ("1", "true") else "new") for c in line.findall(f"{_A}tc")]
                        for line in shape.findall(f"{_A}tr")
                    )
    return out.rows


PARSERS = {"docx": parse_document, "pptx": parse_slides}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of documents and slides, parsed where the files are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(file, *r) for r in PARSERS[file.rpartition(".")[2].lower()](bytes(content))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")]).astype(object).where(lambda d: d.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROW)


def page_texts(rows: DataFrame) -> DataFrame:
    """``page`` and ``text``, its paragraphs by line."""
    lines = F.array_sort(F.collect_list(F.when(F.col("what") == "text", F.struct("place", "value"))))  # the paragraphs of one page
    return rows.groupBy("page").agg(F.array_join(F.transform(lines, lambda x: x["value"]), "\n").alias("text")).where("text <> ''")


def headings_of(rows: DataFrame) -> DataFrame:
    """``page_id, place, level, text`` of the headings, as web pages have them."""
    return rows.where("what = 'text' and level > 0").select(F.lit(1).alias("page_id"), "place", "level", F.col("value").alias("text"))


def tables_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cells`` (with their page) and ``merges`` of the tables."""
    cells = rows.where("what = 'cell'").select("sheet", "page", "row", "col", "value")
    merges = rows.where("what = 'merge'").select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row2").alias("r1"), F.col("col2").alias("c1"))
    return cells, merges

"""Files to rows. All readers go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import content_key
from gridloom.operators.cells import unique_names
from gridloom.sources import workbook
from gridloom.sources.workbook import parse_workbook  # noqa: F401

# Texts that stand for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
KIND_OF_EXTENSION = {
    "csv": "tabular", "xlsx": "tabular", "xls": "tabular", "txt": "text", "md": "text", "html": "document", "htm": "document", "pdf": "document", "docx": "document",
    "pptx": "document", "png": "document", "jpg": "document", "jpeg": "document",
}


def kind_of(path: str) -> str:
    """The reader that an extension calls for; unknown ones are documents."""
    return KIND_OF_EXTENSION.get(path.rpartition(".")[2].lower(), "document")


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header, quoted line breaks, and the texts of ``MISSING`` as nulls; header names are made unique."""
    options = {"multiLine": True, "escape": '"', "quote": '"'}
    head = spark.read.csv(path, header=False, **options).limit(1).collect()
    names = unique_names([x for x in head[0]]) if head else []
    raw = spark.read.csv(path, header=True, enforceSchema=True, schema=", ".join(f"`{n.replace('`', '``')}` string" for n in names), **options) if names else spark.createDataFrame([], "empty string")
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return inferred(clean) if infer else clean


def narrowest(n: int, whole: int, real: int, truth: int) -> str:
    """The type that holds all of ``n`` texts, of which so many are whole numbers, numbers and truth values."""
    return "string" if not n else "bigint" if whole == n else "double" if real == n else "boolean" if truth == n else "string"


def tests_of(value: Column) -> list[Column]:
    return [F.count(value), F.count(value.try_cast("bigint")), F.count(value.try_cast("double")), F.count(F.when(F.lower(value).isin("true", "false"), 1))]


def inferred(df: DataFrame) -> DataFrame:
    """Text columns cast to the narrowest of bigint, double and boolean that holds all their values, in one pass."""
    row = df.agg(*[t for c in df.columns for t in tests_of(F.col(f"`{c}`"))]).first()
    return df.select(*[F.col(f"`{c}`").cast(narrowest(*row[4 * i : 4 * i + 4])).alias(c) for i, c in enumerate(df.columns)])


def typed_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """Each table of ``table, row, col, name, value`` as a DataFrame with typed columns in order.

    ``cells`` is read once for all names and types, which go through the driver, as columns do.
    """
    found = cells.groupBy("table", "col", "name").agg(*tests_of(F.col("value"))).collect()
    columns: dict[str, list[tuple]] = {}
    for r in sorted(found, key=lambda r: (r["table"], r["col"])):
        columns.setdefault(r["table"], []).append((r["name"], narrowest(*r[3:7])))
    out = {}
    for label, own in columns.items():
        wide = cells.where(F.col("table") == label).groupBy("row").pivot("name", [n for n, _ in own]).agg(F.first("value")).orderBy("row")
        out[label] = wide.select(*[F.col(f"`{n}`").cast(kind).alias(n) for n, kind in own])
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, bytes that are no UTF-8 replaced, with the key of their content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr("make_valid_utf8(cast(content as string))").alias("text"), content_key(F.col("content")).alias("content_key"))


def pages_of(texts: DataFrame) -> DataFrame:
    """``texts`` with a row for each page, counted from 1; pages end at form feeds."""
    pages = F.posexplode(F.split("text", "\f"))
    return texts.select(pages.alias("page", "text"), *[c for c in texts.columns if c != "text"]).withColumn("page", F.col("page") + 1)


#: A larger file is known by its length and time of change.
HASHED_BYTES = 256 << 20


def state_of(spark: SparkSession, path: str) -> str:
    """A key of what a path holds: of the files' contents, or of the length and time of change of large ones."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    seen = files.select("path", "length", "content" if size <= HASHED_BYTES else F.col("modificationTime").cast("string").alias("content"))
    rows = seen.select("path", F.sha2(F.concat_ws("|", F.col("length").cast("string"), F.sha2(F.col("content").cast("binary"), 256)), 256).alias("key"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "key"))), lambda r: r["key"]), ""), 256)).first()[0]


def csv_text(spark: SparkSession, text: str) -> DataFrame:
    """A table from CSV text, such as generated output."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]  # quoted fields may hold line breaks
    names = unique_names(rows[0]) if rows else ["empty"]
    fitted = [tuple((r[k] if k < len(r) else "") or None for k in range(len(names))) for r in rows[1:]]
    return inferred(spark.createDataFrame(fitted, ", ".join(f"`{n}` string" for n in names)))


# Spreadsheets -------------------------------------------------------------------------------------------------------


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cells and merged ranges of workbooks in any store that Spark reads: files are taken apart where they are read, and
    their sheets are parsed side by side."""

    def take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as book:
                    shared = book.read(workbook.SHARED) if workbook.SHARED in book.namelist() else None
                    rows = [(file, title, i, book.read(part), shared) for i, (title, part) in enumerate(workbook.sheets(book), 1)]
                yield pd.DataFrame(rows, columns=["file", "sheet", "sheet_no", "part", "shared"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, title, number, part, shared in batch.itertuples(index=False):
                texts = workbook.shared_texts(io.BytesIO(bytes(shared)) if shared is not None else None)
                rows = [(file, what, title, number, *rest) for what, *rest in workbook.sheet_cells(io.BytesIO(bytes(part)), texts)]
                yield pd.DataFrame(rows, columns=["file", "what", "sheet", "sheet_no", "row", "col", "row2", "col2", "value"])

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = books.mapInPandas(take_apart, "file string, sheet string, sheet_no int, part binary, shared binary").repartition("file", "sheet")
    return parts.mapInPandas(parse, "file string, what string, sheet string, sheet_no int, row int, col int, row2 int, col2 int, value string")


def read_workbook(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``merges`` of a workbook, as the operators on cells take them."""
    return cells_and_merges(workbook_rows(spark, path))


def cells_and_merges(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = rows.where("what = 'cell'").select("sheet", *[c for c in rows.columns if c == "sheet_no"], "row", "col", "value")
    merges = rows.where("what = 'merge'").select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("row2").alias("r1"), F.col("col2").alias("c1"))
    return cells, merges


# Web pages ----------------------------------------------------------------------------------------------------------


def headings(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Headings of levels 1 to 3 in page order: ``id, place, level, text``; empty ones are left out."""
    pattern = r"(?is)<h([1-3])[^>]*>(.*?)</h\1\s*>"
    found = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(pattern), F.lit(1)).alias("level"), F.regexp_extract_all(html_col, F.lit(pattern), F.lit(2)).alias("raw"))
    rows = pages.select(id_col, F.posexplode(found).alias("place", "h"))
    text = F.trim(F.regexp_replace(F.regexp_replace("h.raw", r"<[^>]*>", ""), r"\s+", " "))
    return rows.select(id_col, "place", F.col("h.level").cast("int").alias("level"), text.alias("text")).where("text <> ''")


def visible_text(html: F.Column) -> F.Column:
    """The page without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class _Tables(HTMLParser):
    """The tables of a page as cells and merged ranges; a table inside a table is one of its own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.n += 1
            self.open.append({"name": f"Table {self.n}", "row": -1, "col": 0, "taken": set(), "text": None})
        elif self.open and tag == "tr":
            self._close()
            self.open[-1] |= {"row": self.open[-1]["row"] + 1, "col": 0}
        elif self.open and tag in ("td", "th"):
            self._close()
            at, given = self.open[-1], dict(attrs)
            at["row"] = max(at["row"], 0)
            while (at["row"], at["col"]) in at["taken"]:
                at["col"] += 1
            span = lambda name: min(1000, int(given[name])) if (given.get(name) or "").isdigit() and int(given[name]) > 0 else 1
            at |= {"text": [], "rows": span("rowspan"), "cols": span("colspan")}
            at["taken"] |= {(at["row"] + i, at["col"] + j) for i in range(at["rows"]) for j in range(at["cols"])}

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close()
        if self.open and tag == "table":
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["text"] is not None:
            self.open[-1]["text"].append(data)

    def _close(self) -> None:
        at = self.open[-1]
        if at["text"] is not None:
            value, row, col = " ".join("".join(at["text"]).split()) or None, at["row"], at["col"]
            self.rows.append(("cell", at["name"], row, col, row, col, value))
            if at["rows"] * at["cols"] > 1:
                self.rows.append(("merge", at["name"], row, col, row + at["rows"] - 1, col + at["cols"] - 1, None))
            at |= {"text": None, "col": col + at["cols"]}


def html_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``merges`` of the tables of pages, as the operators on cells take them; a sheet is a page and a table's number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch["page"], batch["html"], strict=True):
                reader = _Tables()
                reader.feed(text or "")
                reader.close()
                rows += [(what, f"{page} {name}", *rest) for what, name, *rest in reader.rows]
            yield pd.DataFrame(rows, columns=["what", "sheet", "row", "col", "row2", "col2", "value"])

    given = pages.select(F.col(id_col).cast("string").alias("page"), F.col(html_col).alias("html"))
    return cells_and_merges(given.mapInPandas(run, "what string, sheet string, row int, col int, row2 int, col2 int, value string"))

"""From the raw cells of sheets to tables: unmerge, split into blocks, find headers, clean.

Cells are rows ``sheet, row, col, value``, counted from zero; empty cells may be null or absent. Every step is keyed by
sheet, so sheets are cleaned side by side however many there are. Rows of a sheet are numbered in bins, and cells are
joined by shuffle: they are often made of a few columns of a small file, from which Spark would take them for a table
that it may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import has_digit, is_alphabetic, is_number_like
from gridloom.scratch import materialize

#: Merged ranges, the cells they cover and the bytes of those are broadcast up to these figures, which are counted first.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Rows of a sheet that one window numbers.
BIN = 1 << 16


def unmerge(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Each cell of a merged range (``sheet, r0, c0, r1, c1``, inclusive) takes the range's top-left value.

    Ranges are spelt out as the cells they cover, so this is an equality join on sheet, row and column. Where ranges
    overlap, the one that starts later in reading order wins.
    """
    covered = merges.select("sheet", "r0", "c0", F.explode(F.sequence("r0", "r1")).alias("row"), "c1").select(
        "sheet", "r0", "c0", "row", F.explode(F.sequence("c0", "c1")).alias("col")
    )
    corners = merges.select("sheet", "r0", "c0").distinct()
    corners = F.broadcast(corners) if merges.count() <= BROADCAST_ROWS else corners.hint("merge")
    anchors = cells.select("sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("value").alias("filled")).join(corners, ["sheet", "r0", "c0"])
    filled = covered.join(anchors.hint("merge"), ["sheet", "r0", "c0"], "left").groupBy("sheet", "row", "col").agg(F.max_by("filled", F.struct("r0", "c0")).alias("filled"), F.lit(True).alias("merged"))
    filled = materialize(filled, "merged")
    n, size = filled.agg(F.count("*"), F.sum(F.octet_length("filled"))).first()
    value = F.when(F.col("merged"), F.col("filled")).otherwise(F.col("value")).alias("value")
    if n > BROADCAST_ROWS or (size or 0) > BROADCAST_BYTES:
        return cells.join(filled.hint("merge"), ["sheet", "row", "col"], "full").select("sheet", "row", "col", value)
    given = cells.join(F.broadcast(filled), ["sheet", "row", "col"], "left").select("sheet", "row", "col", value)
    met = cells.join(F.broadcast(filled), ["sheet", "row", "col"], "left_semi").select("sheet", "row", "col").distinct()
    return given.unionByName(filled.join(met.hint("merge"), ["sheet", "row", "col"], "left_anti").select("sheet", "row", "col", F.col("filled").alias("value")))


def _numbered(cells: DataFrame, blank_run: int) -> tuple[DataFrame, DataFrame]:
    """The filled rows (``sheet, row, part, place``: number of the run of rows, number in the sheet), and ``height`` of each sheet.

    Each bin of a sheet's rows is numbered inside, and goes on from what the bins before it add up to.
    """
    bin_of = F.floor(F.col("row") / BIN).alias("bin")
    rows = materialize(cells.groupBy("sheet", "row").agg(F.max(F.col("value").isNotNull()).alias("filled")), "rows")
    extent = rows.groupBy("sheet").agg((F.max("row") + 1).alias("height"))
    filled = rows.where("filled").select("sheet", "row", bin_of)
    inside, before = Window.partitionBy("sheet", "bin").orderBy("row"), Window.partitionBy("sheet").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = filled.groupBy("sheet", "bin").agg(F.max("row").alias("end")).select("sheet", "bin", F.max("end").over(before).alias("end"))
    previous = F.coalesce(F.lag("row").over(inside), F.col("end"))
    started = filled.join(ends, ["sheet", "bin"]).withColumn("starts", F.coalesce(F.col("row") - previous > blank_run, F.lit(True)).cast("int")).drop("end")
    started = materialize(started, "starts")
    sums = started.groupBy("sheet", "bin").agg(F.sum("starts").alias("parts"), F.count("*").alias("places"))
    sums = sums.select("sheet", "bin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("parts", "places")])
    numbered = started.join(sums, ["sheet", "bin"]).select("sheet", "row", (F.col("parts") + F.sum("starts").over(inside)).alias("part"), (F.col("places") + F.row_number().over(inside)).alias("place"))
    return materialize(numbered, "numbered"), extent


def blocks(cells: DataFrame, blank_run: int = 2) -> DataFrame:
    """Blocks of each sheet: ``sheet, block`` (from 1), first and past-last row.

    A run of ``blank_run`` empty rows or more ends a block; blocks of one row are dropped. The last block may count one
    empty row after it.
    """
    return _blocks(*_numbered(cells, blank_run), blank_run).drop("part")


def _blocks(numbered: DataFrame, extent: DataFrame, blank_run: int) -> DataFrame:
    parts = numbered.groupBy("sheet", "part").agg(F.min("row").alias("first"), (F.max("row") + 1).alias("past"))
    ends = parts.groupBy("sheet").agg(F.max("part").alias("last")).join(extent, "sheet")
    parts = parts.join(ends, "sheet")
    tail = F.when((F.col("last") == F.col("part")) & (F.col("height") - F.col("past") < blank_run), F.col("height")).otherwise(F.col("past"))
    kept = parts.withColumn("past", tail).where(F.col("past") - F.col("first") >= 2)
    return kept.select("sheet", F.row_number().over(Window.partitionBy("sheet").orderBy("first")).alias("block"), "first", "past", "part")


def header_scores(cells: DataFrame, found: DataFrame, scan: int = 15) -> DataFrame:
    """Score of each of the first ``scan`` rows of each block with two values or more.

    0.4 for the share of cells filled, 0.3 for the share of text, 0.2 for the share of distinct values, 0.1 if values
    are short, and 0.15 if the next row is filled more than half as well.
    """
    width = cells.groupBy("sheet").agg((F.max("col") + 1).alias("width"))
    lines = found.select("sheet", "block", "first", "past", F.explode(F.sequence(F.col("first"), F.least(F.col("past"), F.col("first") + scan + 1) - 1)).alias("row"))
    text = F.trim(F.col("value"))
    value = lines.join(cells.where("value is not null").hint("merge"), ["sheet", "row"], "left").groupBy("sheet", "block", "first", "past", "row").agg(
        F.count("value").alias("n"),
        F.avg((~is_number_like(text)).cast("double")).alias("text"),
        F.count_distinct(text).alias("kinds"),
        F.avg(F.length(text)).alias("length"),
    )
    order = Window.partitionBy("sheet", "block").orderBy("row")
    fill = F.col("n") / F.col("width")
    scored = value.join(width, "sheet").withColumn("fill", fill).withColumn("next", F.lead("fill").over(order))
    base = F.col("fill") * 0.4 + F.col("text") * 0.3 + F.col("kinds") / F.col("n") * 0.2 + F.when(F.col("length") < 40, 0.1).otherwise(0.0)
    bonus = F.when(F.col("next") > F.col("fill") * 0.5, 0.15).otherwise(0.0)
    return scored.where((F.col("n") >= 2) & (F.col("row") - F.col("first") < scan)).select("sheet", "block", "row", (base + bonus).alias("score"))


def headers(cells: DataFrame, found: DataFrame, scan: int = 15) -> DataFrame:
    """The header row of each block: the best score, the earliest of equals, the first row if none has a score."""
    best = header_scores(cells, found, scan).groupBy("sheet", "block").agg(F.max_by("row", F.struct("score", -F.col("row"))).alias("best"))
    return found.join(best.hint("merge"), ["sheet", "block"], "left").withColumn("header", F.coalesce("best", "first")).drop("best")


def tables(cells: DataFrame, blank_run: int = 2, least_columns: int = 2) -> DataFrame:
    """The cells of the tables of all sheets: ``table`` (label), ``row``, ``col``, ``name``, ``value``.

    Columns and rows without values are dropped; rows and columns are counted anew; a table has ``least_columns``
    columns or more. A sheet of one block is labelled by its name, others by ``name (block k)``.
    """
    numbered, extent = _numbered(cells, blank_run)
    found = headers(cells, materialize(_blocks(numbered, extent, blank_run), "blocks"))
    many = F.count("*").over(Window.partitionBy("sheet")) > 1
    labelled = found.withColumn("table", F.when(many, F.concat("sheet", F.lit(" (block "), F.col("block").cast("string"), F.lit(")"))).otherwise(F.col("sheet")))
    heads = labelled.join(numbered.select("sheet", F.col("row").alias("header"), F.col("place").alias("header_place")).hint("merge"), ["sheet", "header"]).select("sheet", "part", "table", "header_place")
    # A row of a part is the header, above it or a line of the table; its number follows from places in the sheet.
    lines = numbered.join(heads.hint("merge"), ["sheet", "part"]).select("sheet", "row", "table", (F.col("place") - F.col("header_place") - 1).cast("int").alias("line")).where("line >= -1")
    inside = cells.where("value is not null").join(lines.hint("merge"), ["sheet", "row"]).select("table", "line", "col", "value")
    inside = materialize(inside, "inside")
    body = inside.where("line >= 0")
    names = inside.where("line = -1").select("table", "col", F.trim("value").alias("header_text"))
    by_col = Window.partitionBy("table").orderBy("col")
    columns = body.groupBy("table", "col").count().join(names.hint("merge"), ["table", "col"], "left")
    columns = columns.select("table", "col", F.coalesce(F.nullif("header_text", F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string"))).alias("raw"), (F.row_number().over(by_col) - 1).alias("place"))
    columns = columns.withColumn("width", F.count("*").over(Window.partitionBy("table"))).where(F.col("width") >= least_columns)
    named = columns.withColumn("name", unique_name("table", "raw", "place")).drop("raw", "width")
    return body.join(named.hint("merge"), ["table", "col"]).select("table", F.col("line").alias("row"), F.col("place").alias("col"), "name", "value")


def unique_name(group: str, name: str, place: str) -> F.Column:
    """The name, with its number among equal names (case aside) after the first."""
    n = F.row_number().over(Window.partitionBy(group, F.lower(F.col(name))).orderBy(place)) - 1
    return F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string")))


def to_frame(table_cells: DataFrame, label: str) -> DataFrame:
    """One table as a DataFrame of text columns in the order of its columns; its names go through the driver."""
    own = table_cells.where(F.col("table") == label)
    names = [r["name"] for r in own.select("col", "name").distinct().orderBy("col").collect()]
    return own.groupBy("row").pivot("name", names).agg(F.first("value")).orderBy("row").drop("row")


def unique_names(names: list[str | None]) -> list[str]:
    """Names made unique without regard to case: a blank becomes ``col_<place>``, a repeat gets the next free number."""
    taken: set[str] = set()
    out = []
    for place, raw in enumerate(names):
        base = (raw or "").strip() or f"col_{place}"
        name, k = base, 0
        while name.lower() in taken:
            k += 1
            name = f"{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def real_tables(cells: DataFrame, table: str = "table") -> DataFrame:
    """Labels of tables that are no word lists: at most 80 % single words, or some digit; empty tables are none."""
    value = F.coalesce(F.col("value"), F.lit(""))
    checked = cells.groupBy(table).agg(F.avg(is_alphabetic(value).cast("double")).alias("words"), F.max(has_digit(value)).alias("digits"))
    return checked.where((F.col("words") <= 0.8) | F.col("digits")).select(table)

"""Text and tables from words that character recognition has boxed: ``text, conf, left, top, line_num, block_num``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_text(words: DataFrame, page: str = "page") -> DataFrame:
    """Each page's text, a line for each recognised line, and its mean confidence over words that have one."""
    lines = words.groupBy(page, "block_num", "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ").alias("line"),  # the words of a line
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf_sum"),
        F.count(F.when(F.col("conf") >= 0, 1)).alias("conf_n"),
        F.count("*").alias("n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block_num", "line_num", "line")))  # the lines of a page
    return lines.groupBy(page).agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"),
        F.coalesce(F.round(F.sum("conf_sum") / F.sum("conf_n"), 1), F.lit(0.0)).alias("avg_conf"),
        F.sum("n").alias("n_words"),
    )


def column_bounds(lefts: Column, gap: int = 40) -> Column:
    """Left edges of columns: a sorted edge opens a column if it lies over ``gap`` past the last edge that did."""
    opens = lambda found, x: F.when((F.size(found) == 0) | (x - F.get(found, F.size(found) - 1) > gap), F.array_append(found, x)).otherwise(found)
    return F.aggregate(F.array_sort(lefts), F.array().cast("array<int>"), opens)


def word_tables(words: DataFrame, page: str = "page", gap: int = 40) -> DataFrame:
    """Cells ``page, row, col, value`` of the table on each page; pages of one row have none. Row 0 is the header."""
    bounds = words.groupBy(page).agg(column_bounds(F.collect_list(F.col("left").cast("int")), gap).alias("bounds"))  # the words of a page
    placed = words.join(bounds, page).withColumn("col", F.size(F.filter("bounds", lambda b: b <= F.col("left"))) - 1)
    keyed = placed.withColumn("line", F.col("block_num") * 1000 + F.col("line_num"))
    cells = keyed.groupBy(page, "line", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda w: w["text"]), " ").alias("value"))
    rows = cells.groupBy(page).agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return cells.join(rows.where(F.size("lines") >= 2), page).select(page, (F.array_position("lines", F.col("line")) - 1).cast("int").alias("row"), "col", "value")

"""Checks on tables before they are exported."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.statistics import share_numeric


def blank(value: Column) -> Column:
    """Null, white space or the text ``nan``."""
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.isin("", "nan"), F.lit(True))


def rates(df: DataFrame) -> DataFrame:
    """One row: number of rows, share of cells filled, share of blank rows, share of repeated rows."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    filled = reduce(lambda a, b: a + b, [F.when(blank(c), 0).otherwise(1) for c in columns])
    # Equal rows are counted after partial aggregation, so repeats don't travel.
    grouped = df.groupBy(F.struct(*columns).alias("row"), filled.alias("filled")).agg(F.count("*").alias("n"))
    return grouped.agg(
        F.sum("n").alias("n_rows"),
        (F.sum(F.col("filled") * F.col("n")) / (F.sum("n") * len(columns))).alias("fill_rate"),
        (F.sum(F.when(F.col("filled") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("blank_row_rate"),
        (1 - F.count("*") / F.sum("n")).alias("repeat_rate"),
    )


@dataclass
class Verdict:
    ok: bool
    problems: list[str] = field(default_factory=list)
    fill_rate: float = 0.0
    blank_row_rate: float = 0.0


def validate(df: DataFrame, wanted: list[str]) -> Verdict:
    """Whether a table looks like real data: filled by 15 % or more, at most 40 % blank rows, not mostly repeats."""
    found = rates(df).first()
    if not found["n_rows"]:
        return Verdict(False, ["no rows produced"])
    have = {c.lower() for c in df.columns}
    problems = [f"missing columns: {missing}"] if (missing := [c for c in wanted if c.lower() not in have]) else []
    if found["fill_rate"] < 0.15:
        problems.append(f"low fill rate ({found['fill_rate']:.0%})")
    if found["blank_row_rate"] > 0.4:
        problems.append(f"{found['blank_row_rate']:.0%} of rows are blank")
    if found["n_rows"] > 3 and found["repeat_rate"] > 0.8:
        problems.append("most rows are repeats")
    return Verdict(not problems, problems, found["fill_rate"], found["blank_row_rate"])


def numeric_columns(df: DataFrame, least: float = 0.6) -> list[str]:
    """Columns of which more than ``least`` of all rows read as numbers, in one pass."""
    row = df.agg(*[share_numeric(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if (row[c] or 0) > least]

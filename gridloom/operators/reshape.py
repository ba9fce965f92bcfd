"""Pivot, melt, bins, codes and other changes of shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.relational import with_place


def pivot_table(df: DataFrame, index: list[str], columns: str, values: list, agg: Column, names: list[str] | None = None) -> DataFrame:
    """Long to wide by an aggregate; the column values are given, so that no pass is needed to find them."""
    wide = df.groupBy(*index).pivot(columns, values).agg(agg)
    return wide.toDF(*index, *(names or [str(v) for v in values]))


def crosstab(df: DataFrame, index: str, columns: str, values: list, names: list[str] | None = None) -> DataFrame:
    return pivot_table(df, [index], columns, values, F.count(F.lit(1)), names).na.fill(0)


def unstack(df: DataFrame, index: list[str], columns: str, value: str, values: list, names: list[str] | None = None) -> DataFrame:
    """Long to wide with one row a cell; a second row of a cell is an error, not a choice."""
    again = F.raise_error(F.concat(F.lit("More than one row for a cell of "), F.lit(columns)))
    return pivot_table(df, index, columns, values, F.when(F.count(F.lit(1)) > 1, again).otherwise(F.first(value)), names)


def transpose(df: DataFrame, label: str, labels: list, name: str = "column") -> DataFrame:
    """Columns as rows and rows as columns: ``name``, then a column for each given value of ``label``.

    Labels are given, as they become columns; a label of two rows is an error. Values take their common type.
    """
    long = df.withColumnRenamed(label, "__label").unpivot(["__label"], [c for c in df.columns if c != label], name, "__value")
    return unstack(long, [name], "__label", "__value", labels)


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def cut(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """The right-closed interval between edges that holds the value; null outside."""
    labels = labels or [f"({a:g}, {b:g}]" for a, b in zip(edges, edges[1:], strict=False)]
    out = F.lit(None).cast("string")
    for a, b, label in list(zip(edges, edges[1:], labels, strict=False))[::-1]:
        out = F.when((value > a) & (value <= b), F.lit(label)).otherwise(out)
    return out


def equal_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Bins 0 to n-1 of equal width over the range of the column, right-closed; the least value is in the first."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    width = (high - low) / n or 1.0
    place = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((F.col(value) - low) / width).cast("int") - 1))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), place))


def quantile_edges(df: DataFrame, value: str, n: int) -> list[float]:
    """Exact interpolated quantiles that bound ``n`` parts of equal count."""
    return exact_quantiles(df, value, [i / n for i in range(n + 1)]).first()[0] or []


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Bins 0 to n-1 between the quantiles, right-closed; the least value is in the first."""
    edges = quantile_edges(df, value, n)
    if not edges:
        return df.withColumn(name, F.lit(None).cast("int"))
    above = sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    return df.withColumn(name, F.when(F.col(value).isNotNull(), above))


def factorize(df: DataFrame, value: str, order: list[str], name: str = "code") -> DataFrame:
    """Codes from 0 by first appearance in ``order``; null has -1.

    Only distinct values are numbered, range by range, and they are joined back by value.
    """
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("__first"))
    places = with_place(firsts.select(F.col(value).alias("__value"), "__first.*"), order, name).select("__value", name)
    return df.join(places, F.col(value) == F.col("__value"), "left").withColumn(name, F.coalesce(name, F.lit(-1))).drop("__value")


def modes(df: DataFrame, value: str) -> DataFrame:
    """Every most frequent value, with its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.max("n").alias("n")), "n").select(value, "n")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Counts and shares of the values, null left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total")), how="cross").select(value, "n", (F.col("n") / F.col("total")).alias("share"))


def resample(df: DataFrame, at: str, unit: str, agg: dict[str, Column]) -> DataFrame:
    """Aggregates by calendar unit (hour, day, week, month), empty units between the first and the last included."""
    bucketed = df.groupBy(F.date_trunc(unit, F.col(at)).alias("bucket")).agg(*[c.alias(n) for n, c in agg.items()])
    span = bucketed.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).where("a is not null")
    grid = span.select(F.explode(F.sequence("a", "z", F.expr(f"interval 1 {unit}"))).alias("bucket"))
    return grid.join(bucketed, "bucket", "left")

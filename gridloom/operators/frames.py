"""Data-frame methods that SQL writes in several words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, subset: list[str] | None = None, how: str = "any", least: int | None = None) -> DataFrame:
    """Rows without missing values in the subset: any, all, or fewer than ``least`` values present."""
    return df.na.drop(how=how, thresh=least, subset=subset)


def replace_values(df: DataFrame, columns: list[str], pairs: dict) -> DataFrame:
    return df.na.replace(pairs, subset=columns)


def duplicated(columns: list[str], order: list[str], keep: str | None = "first") -> Column:
    """Whether a row repeats another one's columns; the first or last of equals, or none of them, is exempt."""
    equal = Window.partitionBy(*columns)
    if keep is None:
        return F.count("*").over(equal) > 1
    by = [F.asc(c) if keep == "first" else F.desc(c) for c in order]
    return F.row_number().over(equal.orderBy(*by)) > 1


def without_duplicates(df: DataFrame, columns: list[str], order: list[str], keep: str | None = "first") -> DataFrame:
    return df.withColumn("__repeat", duplicated(columns, order, keep)).where(~F.col("__repeat")).drop("__repeat")


def place_in_group(group: list[str], order: list[str]) -> Column:
    """Places from 0 in the group's order."""
    return (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint")


def group_tail(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    last = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__place", F.row_number().over(last)).where(F.col("__place") <= n).drop("__place")


def groups_where(df: DataFrame, group: list[str], test: Column) -> DataFrame:
    """Rows of the groups for which an aggregate ``test`` holds; groups are tested after partial aggregation."""
    kept = df.groupBy(*group).agg(test.alias("__keep")).where("__keep").drop("__keep")
    names = {g: f"__g_{g}" for g in group}
    on = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(n)) for g, n in names.items()])
    return df.join(kept.withColumnsRenamed(names), on, "left_semi")


def columns_like(df: DataFrame, like: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Columns whose name holds a text, or whose type is one of the kinds."""
    names = [n for n, t in df.dtypes if (like is None or like in n) and (kinds is None or t in kinds)]
    return df.select(*[f"`{n}`" for n in names])


def hashed_sample(df: DataFrame, columns: list[str], share: float, seed: int = 1) -> DataFrame:
    """Rows whose keyed hash falls under ``share``: a sample that is the same however the table is partitioned."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 20)) < int(share * (1 << 20)))


def pairwise_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """``a``, ``b``, ``r`` for each pair of columns over rows where both are known, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    known = lambda a, b: F.when(F.col(b).isNotNull(), F.col(a))
    row = df.agg(*[F.corr(known(a, b), known(b, a)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    stacked = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(stacked))


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))

"""Joins, set operations and unions with the null rules of SQL, and those of data frames as an option."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.scratch import materialize

#: A side smaller than this, by the optimizer's own statistics, may be broadcast; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's size estimate proves ``df`` small."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if small_enough(df, limit) else df


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", null_keys_match: bool = False, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """An equality join. Columns of both sides that are no keys get suffixes; null keys match only if asked."""
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {k.lower() for k in on}
    if how in ("left_semi", "left_anti", "semi", "anti"):
        shared = set()
    suffix = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c.lower() in shared})
    left, right = suffix(left, suffixes[0]), suffix(right, suffixes[1])
    if not null_keys_match:
        return left.join(right, on, how)
    keyed = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    joined = left.join(keyed, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in on]), how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return joined
    if how in ("right", "outer", "full"):
        joined = joined.withColumns({k: F.coalesce(k, f"__right_{k}") for k in on})
    return joined.drop(*[f"__right_{k}" for k in on])


def band_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, keys: list[str] | None = None, how: str = "inner", clustered: bool = False) -> DataFrame:
    """Points joined to the ranges [low, high] they lie in.

    Both sides are laid out in bins of ``width``: a point has one bin, a range each it touches, so this is an equality
    join on the bin whatever the sizes. Choose ``width`` near the usual length of a range.

    ``clustered`` is for results of far more rows than there are points: the points are dealt in ranges of their values
    first, which shuffles each once, so that points that follow each other lie in the same ranges and files hold the
    same rows of ranges over and over, which compress well. Equal values may fill many such ranges of points.
    """
    keys = keys or []
    if clustered:
        points = points.repartitionByRange(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(at), F.xxhash64(*points.columns))
    left = points.withColumn("__bin", F.floor(F.col(at) / width))
    right = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys}).withColumnRenamed("__bin", "__r_bin")
    on = [F.col("__bin") == F.col("__r_bin"), F.col(at).between(F.col(low), F.col(high)), *[F.col(k) == F.col(f"__r_{k}") for k in keys]]
    return left.join(right, reduce(Column.__and__, on), how).drop("__bin", "__r_bin", *[f"__r_{k}" for k in keys])


def reconciled(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames with columns whose types clash cast to text in all of them."""
    kinds: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            kinds.setdefault(name.lower(), set()).add(kind)
    clash = {n for n, k in kinds.items() if len(k) > 1}
    return [df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c.lower() in clash else F.col(f"`{c}`") for c in df.columns]) for df in frames]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reconciled(frames))


def beside(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Columns side by side by place in the given orders; the shorter side is filled with nulls."""
    a, b = with_place(left, left_order, "__place"), with_place(right, right_order, "__place")
    return a.join(b, "__place", "full").drop("__place")


def ranged(df: DataFrame, order: list[str | Column], name: str = "ranged") -> DataFrame:
    """``df`` written in ranges of a total order, with ``__range`` and ``__no``, which ascend in that order.

    There are as many ranges as shuffle partitions, cut by all columns of the order, so that a value of the first one may
    fill many. The numbering is written, so that whatever reads it later sees the same.
    """
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]
    out = df.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by).withColumn("__no", F.monotonically_increasing_id())
    return materialize(out, "ranged").withColumn("__range", F.shiftright("__no", 33))


def with_place(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in a total order, without passing all rows through one task: ranges are counted and summed up."""
    rows = ranged(df, order)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__rows"), F.min("__no").alias("__first"))
    before = F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select(F.col("__range").alias("__of"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    joined = rows.join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    return joined.withColumn(name, F.col("__before") + F.col("__no") - F.col("__first")).drop("__no", "__range", "__of", "__first", "__before")


def contains_join(texts: DataFrame, needles: DataFrame, text: str, needle: str, gram: int = 3) -> DataFrame:
    """Rows of ``texts`` with each row of ``needles`` whose ``needle`` occurs in ``text``, by an equality join.

    A needle is looked up by its first ``gram`` characters (all of a shorter one) among the runs of so many characters of
    a text, and compared whole only where they meet. An empty needle is in every text, a null one in none.
    """
    sizes = [r[0] for r in needles.select(F.least(F.char_length(needle), F.lit(gram))).distinct().collect() if r[0] is not None]  # ``gram + 1`` at most

    def runs(size: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.char_length(text) - size), lambda i: F.substring(F.col(text), i + 1, F.lit(size))) if size else F.array(F.lit(""))
        return F.when(F.char_length(text) >= size, every).otherwise(F.array().cast("array<string>"))

    every = F.concat(*map(runs, sizes)) if sizes else F.array().cast("array<string>")
    keyed = texts.withColumn("__gram", F.explode(F.array_distinct(every)))
    asked = needles.where(F.col(needle).isNotNull()).withColumn("__first_gram", F.substring(F.col(needle), 1, gram))
    return keyed.join(maybe_broadcast(asked), (F.col("__gram") == F.col("__first_gram")) & F.col(text).contains(F.col(needle))).drop("__gram", "__first_gram")

"""Exact quantiles of few large groups by distributed selection, without gathering a group's values.

Sketched quantiles bracket every rank wanted (``ACCURACY`` bounds their error). The rows below a bracket, at its ends and
between them are counted; a rank at an end is found, and a bracket with more than ``MOST`` rows between its ends is
narrowed by a sketch of those. Then the distinct values of what is left are counted and the ranks are read off. Every
step is an aggregate that combines on the map side, and a value that most rows share ends up as an end of a bracket.

Nulls and NaN take no part; a group without values has null quantiles. Values between two ranks are interpolated as
``percentile`` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.relational import maybe_broadcast
from gridloom.scratch import discard, materialize

ACCURACY, MOST, STEPS = 2_000, 100_000, 16


def _brackets(rows: DataFrame, shares: list[float]) -> DataFrame:
    """A row for each group ``g`` and rank: the quantile's ``place`` and ``share`` of the way to its rank, the ``rank``,
    and values ``a`` and ``z`` around it."""
    grid = [min(1.0, max(0.0, s + side * 2.0 / ACCURACY)) for s in shares for side in (-1, 1)]
    stats = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile_approx("v", grid, ACCURACY).alias("grid"))
    wanted = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("share")) for i, s in enumerate(shares)])
    at = stats.withColumn("w", F.explode(wanted)).withColumn("exact", (F.col("n") - 1) * F.col("w.share")).withColumn("ranks", F.array_distinct(F.array(F.floor("exact"), F.ceil("exact"))))
    edge = lambda side: F.get("grid", F.col("w.place") * 2 + side)
    return at.select(
        "g", "least", "most", F.col("w.place").alias("place"), "exact", F.explode("ranks").alias("rank"),
        F.when(F.col("w.share") * ACCURACY <= 2, F.col("least")).otherwise(edge(0)).alias("a"), F.when((1 - F.col("w.share")) * ACCURACY <= 2, F.col("most")).otherwise(edge(1)).alias("z"),
    )


def _within(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    return rows.join(maybe_broadcast(brackets.withColumnRenamed("g", "h")), F.col("g").eqNullSafe(F.col("h"))).drop("g").withColumnRenamed("h", "g")


def _narrowed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """The brackets after one pass over ``rows``, and whether each needs another (``again``)."""
    many = lambda c: F.sum(c.cast("bigint"))
    v, a, z = F.col("v"), F.col("a"), F.col("z")
    between = (v > a) & (v < z)
    counted = _within(rows, brackets).groupBy("g", "least", "most", "place", "exact", "rank", "a", "z").agg(
        many(v < a).alias("below"), many(v == a).alias("at_a"), many(between).alias("mid"), many((v == z) & (z > a)).alias("at_z"),
        F.percentile_approx(F.when(between, v), [i / STEPS for i in range(STEPS + 1)], 1000).alias("steps"),
    )
    over_a = F.col("rank") - F.col("below") - F.col("at_a")  # place among the rows above the lower end
    early, late = F.col("rank") < F.col("below"), over_a >= F.col("mid") + F.col("at_z")
    wide = F.col("mid") > MOST
    share = over_a / F.col("mid") * STEPS
    lower, upper = F.get("steps", F.greatest(F.lit(0), F.floor(share) - 1).cast("int")), F.get("steps", F.least(F.lit(STEPS), F.ceil(share) + 1).cast("int"))
    found_a, found_z = ~early & (over_a < 0), ~late & (over_a >= F.col("mid"))
    return counted.select(
        "g", "least", "most", "place", "exact", "rank",
        F.when(early, F.col("least")).when(late | found_z, z).when(found_a, a).when(wide, lower).otherwise(a).alias("a"),
        F.when(late, F.col("most")).when(early | found_a, a).when(found_z, z).when(wide, upper).otherwise(z).alias("z"),
        (early | late | (~found_a & ~found_z & wide)).alias("again"), F.when(found_z, F.col("below") + F.col("at_a") + F.col("mid")).otherwise(F.col("below")).alias("below"),
    )


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, name: str = "quantiles") -> DataFrame:
    """``by`` and ``name``, the array of the quantiles of ``value`` at ``shares``, each from 0 to 1."""
    by = by or []
    group = F.struct(*[F.col(f"`{k}`") for k in by]) if by else F.struct(F.lit(0).alias("one"))
    every = df.select(group.alias("g"), F.col(f"`{value}`").alias("v"))
    rows = every.where(F.col("v").isNotNull())
    rows = rows.where(~F.isnan("v")) if dict(df.dtypes)[value] in ("double", "float") else rows
    brackets = materialize(_brackets(rows, shares), "brackets")
    again = True
    while again:
        before, brackets = brackets, materialize(_narrowed(rows, brackets.drop("again", "below")), "brackets")
        discard(before)
        again = bool(brackets.where("again").take(1))
    # What lies between the ends, and the ends themselves, by value: at most ``MOST`` values and two more for each rank.
    values = _within(rows, brackets).where(F.col("v").between(F.col("a"), F.col("z"))).groupBy("g", "place", "rank", "exact", "below", "v").agg(F.count("*").alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("g", "place", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = values.withColumn("end", upto).where(F.col("end") > F.col("rank")).groupBy("g", "place", "exact", "rank").agg(F.min("v").cast("double").alias("x"))
    both = picked.groupBy("g", "place", "exact").agg(F.min_by("x", "rank").alias("x"), F.max_by("x", "rank").alias("y"))
    low, high = F.floor("exact"), F.ceil("exact")
    between = F.when(low == high, F.col("x")).otherwise((high - F.col("exact")) * F.col("x") + (F.col("exact") - low) * F.col("y"))
    found = both.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", between.alias("q")))), lambda s: s["q"]).alias(name))  # as many as shares
    groups = every.select(F.col("g").alias("k")).distinct()
    if not by:
        groups = df.sparkSession.range(1).select(F.struct(F.lit(0).alias("one")).alias("k"))
    return groups.join(found, F.col("g").eqNullSafe(F.col("k")), "left").select(*([f"k.{c}" for c in by]), name)

"""Sketches that are stored by slice (a day, say) and merged later: distinct counts, sets of values, quantiles.

A slice is read once. Counts and sums merge exactly; distinct counts (HyperLogLog, relative error about 1.04 /
sqrt(2 ** ``LOG_K``) for one standard deviation), common values (theta) and quantiles (KLL, rank error about 1.3 % at
``KLL_K``) merge to what a sketch of all rows would say, up to those errors. Nulls are in no sketch; a group without a
value has an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_K, KLL_K = 12, 200


def sketched(df: DataFrame, keys: list[str], distinct: list[str] = (), numbers: list[str] = ()) -> DataFrame:
    """One row for each value of ``keys`` with ``n``, and for columns c ``distinct_c`` and ``set_c``, or ``sum_c`` and ``quantiles_c``."""
    aggregates = [F.count("*").alias("n")]
    for c in distinct:
        # Hashed first, so that any type can be counted.
        value = F.when(F.col(c).isNotNull(), F.xxhash64(c))
        aggregates += [F.hll_sketch_agg(value, F.lit(LOG_K)).alias(f"distinct_{c}"), F.theta_sketch_agg(value, LOG_K).alias(f"set_{c}")]
    for c in numbers:
        value = F.col(c).cast("double")
        aggregates += [F.sum(value).alias(f"sum_{c}"), F.kll_sketch_agg_double(value, KLL_K).alias(f"quantiles_{c}")]
    return df.groupBy(*keys).agg(*aggregates)


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups, from stored ones only."""
    how = {"n": F.sum, "distinct": F.hll_union_agg, "set": F.theta_union_agg, "sum": F.sum, "quantiles": F.kll_merge_agg_double}
    kept = [c for c in sketches.columns if c not in keys and c.split("_")[0] in how]
    return sketches.groupBy(*keys).agg(*[how[c.split("_")[0]](c).alias(c) for c in kept])


def read_off(sketches: DataFrame, shares: list[float] = (0.5,)) -> DataFrame:
    """Estimates in place of the sketches: counts, and for each column of numbers an array of its quantiles."""
    out = []
    for c in sketches.columns:
        if c.startswith("distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(c))
        elif c.startswith("set_"):
            out.append(F.theta_sketch_estimate(c).alias(c))
        elif c.startswith("quantiles_"):
            some = F.kll_sketch_get_n_double(c) > 0
            out.append(F.when(some, F.array(*[F.kll_sketch_get_quantile_double(c, F.lit(float(s))) for s in shares])).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return sketches.select(*out)


def store(sketches: DataFrame, path: str, slice_by: str) -> None:
    """Puts the slices into a folder, in the place of what it had of the same ones; a rerun changes nothing."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_by).parquet(path)

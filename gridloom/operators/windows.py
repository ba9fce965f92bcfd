"""Window forms that SQL has no single function for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, Window
from pyspark.sql import functions as F


def average_rank(partition: list[str], order: str, ascending: bool = True) -> Column:
    """Mean of the places that equal values take."""
    by = F.col(order).asc_nulls_last() if ascending else F.col(order).desc_nulls_last()
    ties = F.count("*").over(Window.partitionBy(*partition, order))
    return F.rank().over(Window.partitionBy(*partition).orderBy(by)) + (ties - 1) / 2.0


def fill_forward(value: str, spec: WindowSpec) -> Column:
    return F.last(value, ignorenulls=True).over(spec.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def fill_backward(value: str, reverse: WindowSpec) -> Column:
    """The next known value; ``reverse`` has the rows in reverse order, as a frame that shrinks is read anew for every row."""
    return fill_forward(value, reverse)


def interpolated(value: str, at: str, partition: list[str]) -> Column:
    """Linear between the known neighbours by ``at``; at the end the last known value stays."""
    known_at = F.when(F.col(value).isNotNull(), F.col(at))
    rows = Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back, ahead = rows.orderBy(at), rows.orderBy(F.desc(at))
    v0, v1 = F.last(value, True).over(back), F.last(value, True).over(ahead)
    t0, t1 = F.last(known_at, True).over(back), F.last(known_at, True).over(ahead)
    return F.when(F.col(value).isNotNull() | v1.isNull(), v0).otherwise(v0 + (v1 - v0) * (F.col(at) - t0) / (t1 - t0))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def over_groups(df: DataFrame, partition: list[str], order: list[str | Column], before: int | None, after: int | None, agg: Column, name: str) -> DataFrame:
    """An aggregate over a frame that counts groups of ties (SQL's GROUPS); None for an end means without bound.

    Groups are numbered by a dense rank, over which the frame is a range; both windows use one shuffle.
    """
    number = F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))
    first = Window.unboundedPreceding if before is None else -before
    last = Window.unboundedFollowing if after is None else after
    frame = Window.partitionBy(*partition).orderBy("__group").rangeBetween(first, last)
    return df.withColumn("__group", number).withColumn(name, agg.over(frame)).drop("__group")


BLOCK = 256  # rows that one product of matrices decays


def _decayed(x: np.ndarray, keep: float, carried: float) -> np.ndarray:
    """Running sums in which each step keeps the share ``keep`` of the sum before it, in blocks of rows."""
    out = np.empty(len(x))
    steps = np.arange(BLOCK)
    with np.errstate(under="ignore"):
        weights = np.tril(keep ** np.maximum(steps[:, None] - steps[None, :], 0.0))
        powers = keep ** (steps + 1.0)
    for at in range(0, len(x), BLOCK):
        n = min(BLOCK, len(x) - at)
        out[at : at + n] = weights[:n, :n] @ x[at : at + n] + powers[:n] * carried
        carried = out[at + n - 1]
    return out


def exponential_mean(df: DataFrame, key: str, order: str, value: str, alpha: float, name: str = "ewm") -> DataFrame:
    """Exponentially weighted mean of each key's rows in order, weights divided by their sum.

    Rows of a key follow each other in one task and are read batch by batch with two numbers carried over, so a long
    key needs no memory. Missing values decay the weights and add none; rows without a key are one group.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, top, bottom = None, 0.0, 0.0
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[key].astype(object).where(batch[key].notna(), None).to_numpy()
            numbers = batch[value].astype("float64").to_numpy()
            known = ~np.isnan(numbers)
            tops, bottoms = np.empty(len(batch)), np.empty(len(batch))
            starts = np.flatnonzero([True, *(keys[1:] != keys[:-1])])
            for a, z in zip(starts, [*starts[1:], len(batch)], strict=True):
                if keys[a] != current:
                    current, top, bottom = keys[a], 0.0, 0.0
                tops[a:z] = _decayed(np.where(known[a:z], numbers[a:z], 0.0), 1 - alpha, top)
                bottoms[a:z] = _decayed(known[a:z].astype("float64"), 1 - alpha, bottom)
                top, bottom = tops[z - 1], bottoms[z - 1]
            mean = np.divide(tops, bottoms, out=np.full(len(batch), np.nan), where=bottoms > 0)
            yield batch.assign(**{name: pd.Series(mean, index=batch.index, dtype=object).where(~np.isnan(mean), None)})

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{fields}, `{name}` double")

"""Joins with a table of one row per key that never gather a hot key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1 in HOT_KEYS of all rows, so there are fewer than HOT_KEYS hot keys.
HOT_KEYS, HOT_ROWS = 5_000, 100
#: Keys of a filter are broadcast up to this many, which is counted first; beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "inner", n: str = "n", always: bool = False) -> DataFrame:
    """``rows`` joined (``inner`` or ``left_semi``) with ``keyed``, which has a row for each key and its count ``n``.

    Hot keys, whose number is bounded, are broadcast and joined where the rows are; the others are joined by shuffle.
    Both inputs are read more than once, so ``keyed`` must be a written table and ``rows`` cheap. Rows are told apart by a
    filter on the hashes of the hot keys, so each goes through one join, with hot keys or without; a key that shares such
    a hash counts as hot. ``always`` takes an anti-join in the filter's place, also where no key is hot; there adaptive
    execution drops it again.
    """
    total, most = keyed.agg(F.sum(n), F.max(n)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit and not always:
        return rows.join(keyed, on, how)
    if always:
        hot = keyed.where(F.col(n) > limit)
        rest, cold = (df.join(F.broadcast(hot.select(*on)), on, "left_anti") for df in (rows, keyed))
    else:
        named = F.xxhash64(*[F.col(c).cast(keyed.schema[c].dataType) for c in on])
        is_hot = named.isin([r[0] for r in keyed.where(F.col(n) > limit).select(named).collect()])
        hot, cold, rest = keyed.where(is_hot), keyed.where(~is_hot), rows.where(~is_hot)
    return rows.join(F.broadcast(hot), on, how).unionByName(rest.join(cold, on, how))


def only_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The ``rows`` whose key is in ``keys`` (a written table), which are broadcast if they are few."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")

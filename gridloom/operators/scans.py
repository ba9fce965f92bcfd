"""Running values over one order of a whole table, or over few or hot keys, in two levels.

Rows are written in sorted ranges (:func:`gridloom.operators.relational.ranged`). Each range is summed up by key, what
precedes a range is carried over from the sums (as many rows as ranges and keys), and a window inside the range does the
rest. So no task holds more than a range, however long the order or a key is.

The order must be total: equal rows follow each other as they happen to be written. Nulls of the order come last; a null
key is a key. An empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.relational import ranged


@dataclass(frozen=True)
class Scan:
    """A running value: ``sum``, ``count`` (of rows), ``max``, ``min``, ``last`` (known value so far) or ``next`` (from here on)."""

    kind: str
    value: Column | None = None

    def inside(self, keys: list[str]) -> Column:
        """The value over the rows of the range up to this one."""
        order = Window.partitionBy("__range", *keys).orderBy("__no")
        if self.kind == "next":
            order = Window.partitionBy("__range", *keys).orderBy(F.desc("__no"))  # backwards: a frame that shrinks is summed up anew for every row
        so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        use = {"sum": F.sum, "max": F.max, "min": F.min, "count": lambda _: F.count(F.lit(1))}
        return use.get(self.kind, lambda v: F.last(v, ignorenulls=True))(self.value).over(so_far)

    def total(self) -> Column:
        """The value over all rows of a range."""
        known = F.when(self.value.isNotNull(), F.col("__no")) if self.value is not None else None
        return {
            "sum": lambda: F.sum(self.value), "max": lambda: F.max(self.value), "min": lambda: F.min(self.value), "count": lambda: F.count(F.lit(1)),
            "last": lambda: F.max_by(self.value, known), "next": lambda: F.min_by(self.value, known),
        }[self.kind]()

    def carried(self, total: str, keys: list[str]) -> Column:
        """The value over the ranges before (after, for ``next``) this one."""
        order = Window.partitionBy(*keys).orderBy(F.desc("__range") if self.kind == "next" else F.asc("__range"))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        known = lambda c: F.last(c, ignorenulls=True)
        use = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": known, "next": known}
        return use[self.kind](total).over(before)

    def joined(self, inside: Column, carried: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.coalesce(inside + carried, inside, carried)
        if self.kind in ("max", "min"):
            return (F.greatest if self.kind == "max" else F.least)(inside, carried)
        return F.coalesce(inside, carried)


def scanned(df: DataFrame, order: list[str | Column], scans: dict[str, Scan], keys: list[str] | None = None) -> DataFrame:
    """``df`` with a running value for each name of ``scans``, in ``order`` within each of the ``keys``."""
    keys = keys or []
    rows = ranged(df, [*keys, *order])
    totals = rows.groupBy("__range", *keys).agg(*[s.total().alias(f"__total_{n}") for n, s in scans.items()])
    named = {k: f"__of_{i}" for i, k in enumerate(keys)}
    before = totals.select(F.col("__range").alias("__of"), *[F.col(k).alias(n) for k, n in named.items()], *[s.carried(f"__total_{n}", keys).alias(f"__before_{n}") for n, s in scans.items()])
    inside = rows.withColumns({f"__inside_{n}": s.inside(keys) for n, s in scans.items()})
    same = F.col("__range") == F.col("__of")
    for k, n in named.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    out = inside.join(before, same)
    out = out.withColumns({n: s.joined(F.col(f"__inside_{n}"), F.col(f"__before_{n}")) for n, s in scans.items()})
    return out.drop("__range", "__no", "__of", *named.values(), *[f"__{x}_{n}" for n in scans for x in ("inside", "before")])


#: Rows of a key that a task orders at most before the order is cut.
HOT_ROWS = 2_000_000


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], tie: str, tolerance: Column | None = None, most: int = HOT_ROWS) -> DataFrame:
    """Each left row with the ``take`` columns of the last right row of the same key at or before it.

    Both sides are put in one order per key and the last right row is carried along: one shuffle, no join. Where a key
    has more than ``most`` rows, its order is cut into ranges and the last right row of each is carried over. Of right
    rows of one time, the one of greatest ``tie`` counts. Left rows without a match keep nulls.
    """
    cells = F.struct(F.col(on).alias("__at"), *[F.col(c).alias(c) for c in take])
    a = left.select(*by, F.col(on).alias("__on"), F.lit(1).alias("__side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("__tie"), F.struct(*left.columns).alias("__row"))
    b = right.select(*by, F.col(on).alias("__on"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), cells.alias("__match"))
    both = a.unionByName(b, allowMissingColumns=True)
    largest = a.select(*by).unionAll(b.select(*by)).groupBy(*by).count().agg(F.max("count")).first()[0]
    if (largest or 0) > most:
        carried = scanned(both, [F.col("__on").asc(), F.col("__side").asc(), F.col("__tie").asc()], {"__last": Scan("last", F.col("__match"))}, by).where("__side = 1")
    else:
        order = Window.partitionBy(*by).orderBy("__on", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carried = both.withColumn("__last", F.last("__match", ignorenulls=True).over(order)).where("__side = 1")
    if tolerance is not None:
        carried = carried.withColumn("__last", F.when(F.col("__on") - F.col("__last.__at") <= tolerance, F.col("__last")))
    return carried.select("__row.*", *[F.col(f"__last.{c}").alias(c) for c in take])

"""Nearest neighbours of many queries through an index of cells: exact with pruning, or approximate by probing.

Cells are the regions of centroids fitted on a bounded sample (``SAMPLE`` rows); every vector is indexed, in the cell of
its nearest centroid, with its distance to it. The exact search first visits the nearest cells that hold enough vectors,
which bounds the distance of a query's last neighbour. A cell is left out if no vector in it can be nearer, by the
triangle inequality over its nearest and farthest vector or over the plane between two centroids, and so is a vector
whose own distance to the centroid differs from the query's by more than the bound. The approximate search visits the
``probes`` nearest cells, as many as a bounded set of queries with known neighbours needed.

Cells and the queries that visit them are cut into parts of ``BLOCK`` rows, so neither a hot cell nor a popular one fills
a task. Vectors that are null, hold nulls or NaN, or have another length than the sample's first are in no result.
Ties are broken by id; a query is not its own neighbour.

What pruning saves depends on the data: little on directions drawn at random, most of the work where vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.scratch import discard, materialize

SAMPLE, MOST_CELLS, BLOCK, STRIP = 20_000, 4096, 4096, 256
#: Numbers of differences between queries and centroids that a task holds at a time.
CELLS_AT_ONCE = 1 << 22
#: Queries of which the exact neighbours tell how many cells to probe.
CALIBRATION = 200
#: Rounding that a bound must not cut into.
SLACK = 1e-9


def usable(df: DataFrame, id_col: str, vector_col: str, d: int | None = None) -> DataFrame:
    """``id`` and ``v``, doubles, of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c)) & (F.size(v) > 0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(whole)
    return rows if d is None else rows.where(F.size("v") == d)


def _matrix(vectors: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all of ``b``, by one product of matrices."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Centroids by k-means; a cell that empties takes the row farthest from its own centroid."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        far = _far(sample, centroids)
        of, off = far.argmin(1), far.min(1)
        sums, sizes = np.zeros_like(centroids), np.bincount(of, minlength=len(centroids))
        np.add.at(sums, of, sample)
        centroids = sums / np.maximum(sizes, 1)[:, None]
        empty = np.flatnonzero(sizes == 0)
        centroids[empty] = sample[np.argsort(-off)[: len(empty)]]
    return centroids


@dataclass(frozen=True)
class Cells:
    """Centroids with the number, the least and the greatest distance of the vectors of each cell; bounded by ``MOST_CELLS``."""

    centroids: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def home(self, far: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells that hold more than ``k`` vectors together."""
        order = np.argsort(far, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.sizes[order]), k + 1)) + 1]

    def reachable(self, far: np.ndarray, bound: float) -> np.ndarray:
        """The cells that can hold a vector within ``bound``."""
        plane = (far - far.min()) / 2
        least = np.maximum.reduce([far - self.most, self.least - far, plane])
        return np.flatnonzero((least <= bound + SLACK) & (self.sizes > 0))


def visits(x: np.ndarray, bounds: np.ndarray, at: Cells, k: int, probes: int | None, bounded: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, the cells they visit and the distances of these, for some queries at a time.

    A query may visit every cell, so what is handed on at once holds no more numbers than the differences do.
    """
    step = max(1, CELLS_AT_ONCE // max(1, at.centroids.size))
    for low in range(0, len(x), step):
        far = np.sqrt(((x[low : low + step, None, :] - at.centroids[None]) ** 2).sum(2))
        if bounded:
            chosen = [np.setdiff1d(at.reachable(f, u), at.home(f, k)) for f, u in zip(far, bounds[low : low + step], strict=True)]
        elif probes is not None:
            chosen = [np.argsort(f, kind="stable")[:probes] for f in far]
        else:
            chosen = [at.home(f, k) for f in far]
        each, cell = np.repeat(np.arange(len(far)), [len(c) for c in chosen]), np.concatenate(chosen)
        yield low + each, cell, far[each, cell]


class VectorIndex:
    """All usable vectors of a table by cell, written to the shared scratch folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", n_cells: int | None = None, sample: int = SAMPLE):
        self.spark, self.id_col, self.vector_col = vectors.sparkSession, id_col, vector_col
        rows = usable(vectors, id_col, vector_col)
        n = rows.count()
        share = int(min(1.0, sample / max(n, 1)) * 2**20)
        drawn = rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(2**20)) <= share).limit(2 * sample).collect()  # bounded by ``sample``
        self.d = len(drawn[0].v) if drawn else 0
        self.kind = dict(rows.dtypes)["id"]
        centroids = fit_centroids(np.array([r.v for r in drawn if len(r.v) == self.d]).reshape(-1, self.d), n_cells or min(MOST_CELLS, max(1, int(n**0.5)))) if drawn else np.zeros((0, 0))
        d = self.d

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    far = _far(_matrix(b.column(1), d), centroids)
                    cell = far.argmin(1)
                    # The nearest centroid's distance once more without cancellation, as it bounds results.
                    r = np.sqrt(((_matrix(b.column(1), d) - centroids[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(r)], ["id", "v", "cell", "r"])

        placed = rows.where(F.size("v") == d).mapInArrow(assign, f"id {self.kind}, v array<double>, cell int, r double")
        self.rows = materialize(placed, "cells")
        found = self.rows.groupBy("cell").agg(F.count("*"), F.min("r"), F.max("r")).collect()  # a row for each cell
        sizes, least, most = np.zeros(len(centroids), dtype=np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
        for cell, count, low, high in found:
            sizes[cell], least[cell], most[cell] = count, low, high
        self.cells = self.spark.sparkContext.broadcast(Cells(centroids, sizes, least, most))
        self.n = int(sizes.sum())

    def _pairs(self, queries: DataFrame, k: int, probes: int | None, bounded: bool) -> DataFrame:
        """``q, v, cell, far, bound``: the cells that each query (``q, v`` and, if ``bounded``, ``bound``) visits."""
        cells, d = self.cells, self.d

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = cells.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b.column(1), d)
                bounds = np.asarray(b.column(2)) if bounded else np.full(len(x), np.inf)
                for each, cell, far in visits(x, bounds, at, k, probes, bounded):
                    taken = pa.array(each)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(taken), b.column(1).take(taken), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(bounds[each]),
                    ], ["q", "v", "cell", "far", "bound"])

        kind = dict(queries.dtypes)["q"]
        return queries.mapInArrow(choose, f"q {kind}, v array<double>, cell int, far double, bound double")

    def _visited(self, pairs: DataFrame, k: int) -> DataFrame:
        """``q, id, distance, compared``: of each part of a cell a query's ``k`` nearest; ``compared`` adds up to the pairs."""
        pairs = materialize(pairs, "visits")
        asked = pairs.groupBy("cell").agg(F.count("*").alias("asked"))
        sizes = self.spark.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(self.cells.value.sizes) if n], "cell int, parts int")
        cut = F.broadcast(sizes.join(asked, "cell").select("cell", "parts", F.ceil(F.col("asked") / BLOCK).cast("int").alias("strips")))  # a row for each cell
        part_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.rows.join(cut, "cell").withColumn("part", part_of("id", "parts")).withColumn("strip", each("strips")).select("cell", "part", "strip", "id", "v", "r")
        right = pairs.join(cut, "cell").withColumn("strip", part_of("q", "strips")).withColumn("part", each("parts")).select("cell", "part", "strip", "q", "v", "far", "bound")
        d = self.d

        def nearest(found: pa.Table, asked: pa.Table) -> pa.Table:
            out: tuple[list, list, list, list] = ([], [], [], [])
            if found.num_rows and asked.num_rows:
                data, x = _matrix(found.column("v"), d), _matrix(asked.column("v"), d)
                r, far, bound = (np.asarray(c) for c in (found.column("r"), asked.column("far"), asked.column("bound")))
                ids, queries = found.column("id").to_pylist(), asked.column("q").to_pylist()
                for low in range(0, len(x), STRIP):
                    near = _far(x[low : low + STRIP], data)
                    open_to = np.abs(far[low : low + STRIP, None] - r[None, :]) <= bound[low : low + STRIP, None] + SLACK
                    near[~open_to] = np.inf
                    for j, row in enumerate(near):
                        i = low + j
                        # One more, as the query itself may be among them; those close to the last are compared exactly.
                        last = np.partition(row, k)[k] if len(row) > k else np.inf
                        at = np.flatnonzero((row <= last + 1e-6) & np.isfinite(row))
                        exact = np.sqrt(((data[at] - x[i]) ** 2).sum(axis=1))
                        best = sorted((e, ids[a]) for e, a in zip(exact.tolist(), at.tolist(), strict=True) if ids[a] != queries[i])[:k]
                        for place, (e, name) in enumerate(best):
                            out[0].append(queries[i])
                            out[1].append(name)
                            out[2].append(e)
                            out[3].append(0 if place else int(open_to[j].sum()))
            kinds = (asked.schema.field("q").type, found.schema.field("id").type, pa.float64(), pa.int64())
            return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["q", "id", "distance", "compared"])

        kind = dict(pairs.dtypes)["q"]
        schema = f"q {kind}, id {self.kind}, distance double, compared bigint"
        key = ["cell", "part", "strip"]
        return materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, schema), "near")

    def nearest(self, queries: DataFrame, k: int = 6, probes: int | None = None) -> DataFrame:
        """``query_id``, id, ``rank``, ``distance`` and ``compared`` (the vectors that the query was compared with).

        Exact unless ``probes`` tells how many cells to visit.
        """
        asked = usable(queries, self.id_col, self.vector_col, self.d).withColumnRenamed("id", "q")
        found = first = self._visited(self._pairs(asked, k, probes, False), k)
        if probes is None:
            # A query with fewer than ``k`` neighbours so far is not bounded.
            bounds = first.groupBy("q").agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("bound"))  # the best of some cells
            open_to = asked.join(bounds, "q", "left").select("q", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
            found = first.unionByName(self._visited(self._pairs(open_to, k, None, True), k))
        by_query = Window.partitionBy("q")
        ranked = found.withColumn("compared", F.sum("compared").over(by_query)).withColumn("rank", F.row_number().over(by_query.orderBy("distance", "id")))
        return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("id").alias(self.id_col), "rank", "distance", "compared")

    def probes_for(self, recall: float, k: int = 6, queries: int = CALIBRATION) -> int:
        """The nearest cells that must be visited to find a share of ``recall`` of the neighbours of some indexed vectors.

        ``queries`` vectors, drawn by a hash, are searched exactly; their neighbours' cells are counted off.
        """
        share = int(min(1.0, 2 * queries / max(self.n, 1)) * 2**20)
        some = self.rows.where(F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(2**20)) <= share).limit(queries).select(F.col("id").alias(self.id_col), F.col("v").alias(self.vector_col))
        some = materialize(some, "calibration")
        exact = self.nearest(some, k)
        joined = exact.join(self.rows.select(F.col("id").alias(self.id_col), "cell"), self.id_col).join(some.select(F.col(self.id_col).alias("query_id"), F.col(self.vector_col).alias("v")), "query_id").select("cell", "v").collect()  # ``queries`` times ``k`` rows
        at = self.cells.value
        places = sorted(int((((r.v - at.centroids) ** 2).sum(1) < ((r.v - at.centroids[r.cell]) ** 2).sum()).sum()) + 1 for r in joined)
        discard(some)
        return places[min(len(places) - 1, int(np.ceil(recall * len(places))))] if places else 1

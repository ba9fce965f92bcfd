"""Whitening of embeddings by matrix-free block Lanczos.

Entries become integers, ``floor(64 * c) + 1000000``; rows whose vector is null or empty, or holds a null, a non-finite
entry or one whose integer doesn't fit a long, are left out, and so are vectors of another length than most have (the
longer of two equally frequent ones). The fit list is each distinct integer vector once. Counts and sums are exact.

No covariance matrix is formed. A pass over the fit list centres the rows and adds up Xᵀ(XB) for a block B of directions;
only the product, dimensions times block, reaches the driver. The driver keeps the blocks orthogonal to all earlier ones
(twice, so fully), solves the small projected problem, and judges by the residuals of its Ritz vectors. A block that
breaks down is filled with new random directions; when the basis is full, the best Ritz vectors start it again. The
block is as wide as the components wanted, so no multiple eigenvalue is missed. The trace is the sum of the rows'
deviations, so shares need no other eigenvalue.

There are no more components than the rank: a single distinct vector has none, and so no row. Repeated rows give repeated
rows, a null id is kept, an empty table gives no rows, and extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.scratch import materialize

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Largest residual of a Ritz vector, as a share of the largest eigenvalue; directions kept at most, but all of few dimensions.
RESIDUAL, MOST_BASIS = 2e-14, 256
#: Passes that may go by without a smaller residual, which then is at the limit of doubles.
PATIENCE = 4


def integers(vector: Column) -> Column:
    """The integer vector, or null where the row is to be left out."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < 2.0**62 / SCALE))
    return F.when(fits & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint")))


def prepared(df: DataFrame, vector_col: str, carried: list[Column]) -> DataFrame:
    """``carried`` and ``x``, the integer vector, of the rows that remain."""
    rows = df.select(*carried, integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most.d if most else 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of integers."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


@dataclass(frozen=True)
class Centre:
    """Rows and exact sums of the fit list; the mean as a whole part and the rest."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean, as doubles; the large part is taken away in integers."""
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n * x - sums) ** 2`` of each row, exactly."""
        if not x.size:
            return []
        most = self.n * (float(np.abs(x - self.whole).max()) + 1)
        if most * most * x.shape[1] < 2**62:
            return ((self.n * (x - self.whole) - np.array([s % self.n for s in self.sums], dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, dtype=object)) ** 2).sum(axis=1).tolist()


def _passed(fit: DataFrame, begin: Callable[[], np.ndarray], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``fit`` of ``add(rows)``, a matrix like ``begin()``, added up by row of the matrix."""
    height, width = begin().shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = begin()
        for b in batches:
            if b.num_rows:
                total += add(_matrix(b.column(0)))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *map(pa.array, total.T.copy())], ["at", *[f"v{j}" for j in range(width)]])

    kind = {"i": "bigint", "f": "double"}[begin().dtype.kind]
    parts = fit.select("x").mapInArrow(run, "at int, " + ", ".join(f"v{j} {kind}" for j in range(width)))
    wide = [F.col(f"v{j}").cast("decimal(38,0)") if kind == "bigint" else F.col(f"v{j}") for j in range(width)]
    out = np.zeros((height, width), dtype=object if kind == "bigint" else np.float64)
    for r in parts.groupBy("at").agg(*[F.sum(c) for c in wide]).collect():  # one row for each dimension
        out[r[0]] = [int(v) for v in r[1:]] if kind == "bigint" else r[1:]
    return out


def centre_of(fit: DataFrame, d: int) -> Centre:
    """Count and sums of ``x``, added up in halves that can't overflow."""
    halves = lambda x: np.concatenate([(x >> 32).sum(axis=0)[:, None], (x & 0xFFFFFFFF).sum(axis=0)[:, None], np.full((d, 1), len(x))], axis=1)
    total = _passed(fit, lambda: np.zeros((d, 3), dtype=np.int64), halves)
    return Centre(int(total[0, 2]), [(int(high) << 32) + int(low) for high, low, _ in total])


def _orthogonal(block: np.ndarray, basis: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, bool]:
    """Orthonormal directions of ``block`` outside ``basis``; those shorter than ``least`` are drawn anew, which is told."""
    out, broke = [], False
    room = min(block.shape[1], basis.shape[0] - basis.shape[1])
    for j in range(room):
        v, size = block[:, j].copy(), 0.0
        for attempt in range(20):
            scale = np.linalg.norm(v)
            for _ in range(2):  # full reorthogonalisation
                v -= basis @ (basis.T @ v)
                for q in out:
                    v -= q * (q @ v)
            size = np.linalg.norm(v)
            if size > (least if attempt == 0 else 0) and size > 1e-8 * scale:
                break
            broke, v = True, rng.standard_normal(len(v))
        v /= size
        v -= basis @ (basis.T @ v)
        out.append(v / np.linalg.norm(v))
    return np.array(out).T.reshape(basis.shape[0], room), broke


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, most_basis: int = MOST_BASIS, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator without negative
    eigenvalues, with the largest residual as a share of the first eigenvalue, and the passes taken."""
    rng = np.random.default_rng(seed)
    width = min(wanted, d)
    most = max(min(d, most_basis), 3 * width) if d > 3 * width else d
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    block, _ = _orthogonal(rng.standard_normal((d, width)), basis, 0.0, rng)
    best, waited, passes, broke, before = np.inf, 0, 0, False, None
    while True:
        image = apply(block)
        passes += 1
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_images = basis @ turn, images @ turn
        top = max(values[0], 0.0)
        off = np.linalg.norm(ritz_images - ritz * values, axis=0)
        worst = off[:width].max() / top if top > 0 else 0.0
        best, waited = (worst, 0) if worst < 0.5 * best else (best, waited + 1)
        steady = not broke or before is None or np.abs(values[:width] - before).max() <= 1e-12 * top  # a new start found nothing more
        if basis.shape[1] == d or top == 0 or (worst <= residual and steady) or (waited >= PATIENCE and worst <= 1e-10):
            # The rounding of the basis is taken out once more.
            vectors, _ = np.linalg.qr(ritz[:, :width])
            vectors *= np.where((vectors * ritz[:, :width]).sum(axis=0) < 0, -1, 1)
            return values[:width], vectors, float(worst), passes
        before = values[:width]
        if basis.shape[1] + width > most:
            keep = min(2 * width, basis.shape[1])
            basis, images = np.linalg.qr(ritz[:, :keep])[0], ritz_images[:, :keep]
            basis *= np.where((basis * ritz[:, :keep]).sum(axis=0) < 0, -1, 1)
            image = ritz_images[:, :width] - ritz[:, :width] * values[:width]
        block, broke = _orthogonal(image, basis, 1e-13 * top, rng)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows and sums, eigenvalues with unit eigenvectors as columns, the trace, and how it went."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def n_components(self) -> int:
        return len(self.values)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.vectors / np.sqrt(self.values))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits the distinct ``x`` of ``rows``; None where there is no row."""
    fit = materialize(rows.select("x").distinct(), "fit-list")
    if (first := fit.first()) is None:
        return None
    d = len(first.x)
    centre = centre_of(fit, d)

    def product(block: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return _passed(fit, lambda: np.zeros(block.shape), add) / centre.n

    values, vectors, residual, passes = block_lanczos(product, d, min(components, d))
    rank = int((values > 16 * d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = min(rank, centre.n - 1)
    deviation = _passed(fit, lambda: np.zeros((1, 1)), lambda x: np.array([[float(sum(centre.deviations(x)))]]))
    trace = float(deviation[0, 0]) / float(centre.n) ** 3
    found = Whitening(centre, values[:k], vectors[:, :k] * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])[:k], trace, 0.0, residual, passes)
    if k == 0:
        return found

    def gram(x: np.ndarray) -> np.ndarray:
        z = found.project(x)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    sums = _passed(fit, lambda: np.zeros((k + 1, k)), gram) / centre.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return Whitening(found.centre, found.values, found.vectors, trace, error, residual, passes)


def whitened(df: DataFrame, vector_col: str = "embedding", name: str = "whitened", components: int = COMPONENTS) -> DataFrame:
    """The rows of ``df`` that remain, with ``name``, an array of their whitened components; a column of that name goes."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row")
    rows = prepared(df, vector_col, [row])
    model = fit_whitening(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.project(_matrix(b.column(1))) if model and b.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(z), pa.list_(pa.float64()))], ["row", "z"])

    out = rows.mapInArrow(run, StructType([rows.schema["row"], *StructType.fromDDL("z array<double>").fields]))
    return out.select("row.*", F.col("z").alias(name))


def whitening_digest(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each remaining row's components with the figures of the fit; a deviation beyond a long is null."""
    rows = prepared(embeddings, "embedding", [F.col("vec_id")])
    model = fit_whitening(rows, components)
    kind = dict(rows.dtypes)["vec_id"]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.n_components if model else 0
        for b in batches:
            if k and b.num_rows:
                x = _matrix(b.column(1))
                size = len(x) * k
                own = [v if v < 2**63 else None for v in model.centre.deviations(x)]
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, model.centre.n)), pa.array(own, pa.int64()).take(each),
                    pa.array(model.project(x).ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(size, model.identity_error)),
                ], names)

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")

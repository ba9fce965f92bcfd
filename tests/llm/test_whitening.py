"""Whitening against the eigenvectors of a covariance matrix that is formed whole."""

import math
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from gridloom.llm import queries, whitening  # noqa: E402

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def integers(v):
    return tuple(math.floor(64 * float(c)) + 1000000 for c in v)


def whole_matrix(vectors, k=16):
    """Distinct rows, sums, eigenvalues and eigenvectors, from one matrix."""
    fit = sorted({integers(v) for v in vectors})
    x = np.array(fit, dtype=np.float64)
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = x - np.array([float(Fraction(s, n)) for s in sums])
    values, found = np.linalg.eigh(c.T @ c / n)
    return n, sums, values[::-1][:k], found[:, ::-1][:, :k], np.trace(c.T @ c / n), c


def compare(rows, given, tolerance=1e-9):
    n, sums, values, vectors, trace, _ = whole_matrix([v for _, v in given])
    by_row = {}
    for r in rows:
        by_row.setdefault(r.vec_id, []).append(r)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-4
    signs = None
    for key, v in given:
        got = sorted(by_row[key], key=lambda r: r.component)
        assert [r.component for r in got] == list(range(1, len(got) + 1)) and {r.n for r in got} == {n}
        x = integers(v)
        assert {r.deviation for r in got} == {sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))}
        k = len(got)
        want = (np.array(x) - np.array([float(Fraction(s, n)) for s in sums])) @ vectors[:, :k] / np.sqrt(values[:k])
        mine = np.array([r.whitened for r in got])
        signs = np.where(np.abs(mine) > 1e-3, np.sign(mine * want), 0) if signs is None else np.where(signs == 0, np.where(np.abs(mine) > 1e-3, np.sign(mine * want), 0), signs)
        assert np.abs(mine - np.where(signs == 0, np.sign(mine * want), signs) * want).max() < tolerance
        assert np.allclose([r.explained for r in got], values[:k] / trace, rtol=1e-9, atol=0)
    return len(rows)


def test_query(spark, data):
    df = queries.op13_whitening(spark, data)
    assert df.columns == COLUMNS
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert compare(df.collect(), [g for g in given if usable(g[1])]) == 16 * sum(usable(v) for _, v in given)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.standard_normal(5).astype(np.float32) * (j + 1)], 1) for j in range(3) for i in range(j * 20, j * 20 + 20)]
    copies = [(100 + i, good[0][1], 2) for i in range(50)]
    bad = [(200, None, 0), (201, [1.0, None, 2.0, 3.0, 4.0], 0), (202, [float("nan")] * 5, 0), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0], 0), (204, [], 0), (205, [1.0, 2.0], 0), (206, [3e38, 1.0, 1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame([*good, *copies, *bad], EMBEDDINGS).repartition(4)
    rows = whitening.whitening_digest(df).collect()
    assert compare(rows, [(i, v) for i, v, _ in good + copies]) == 5 * 110
    wide = df.selectExpr("*", "'x' AS x", "'x' AS row", "'x' AS whitened", "'x' AS n", "'x' AS component")
    again = whitening.whitening_digest(wide).collect()
    key = lambda r: (r.vec_id, r.component)
    assert np.allclose([r.whitened for r in sorted(rows, key=key)], [r.whitened for r in sorted(again, key=key)], atol=1e-9)
    out = whitening.whitened(wide)
    assert sorted(out.columns) == sorted(wide.columns) and out.where("size(whitened) = 5 and x = 'x' and row = 'x'").count() == 110
    nulls = spark.createDataFrame([(None, v, 0) for _, v, _ in good[:9]] + [(1, v, 0) for _, v, _ in good[:9]], EMBEDDINGS)
    assert sum(r.vec_id is None for r in whitening.whitening_digest(nulls).collect()) == 45


def test_too_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0)], EMBEDDINGS)
    assert whitening.whitening_digest(df).collect() == [] and whitening.whitening_digest(df.limit(0)).collect() == []
    assert whitening.whitened(df).first().whitened == [] and whitening.whitened(df.limit(0)).collect() == []
    two = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.5, 7.0], 0)], EMBEDDINGS)
    rows = whitening.whitening_digest(two).collect()
    assert [(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in rows] == [(1, 1.0, 1.0)] * 2


def test_deviations_beyond_longs():
    centre = whitening.Centre(10**9, [10**15 + 7, 3, -5])
    x = np.array([[10**6, 2, 3], [5 * 10**9, -(10**9), 0]])
    assert centre.deviations(x) == [sum((10**9 * a - s) ** 2 for a, s in zip(r, centre.sums, strict=True)) for r in x.tolist()]


@pytest.mark.parametrize(("d", "most"), [(20, 256), (120, 256), (400, 64), (400, 256)])
def test_lanczos_on_known_spectra(d, most):
    rng = np.random.default_rng(d)
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(np.concatenate([[9.0] * 5, np.geomspace(8, 1e-3, d - 5)]))[::-1]
    matrix = (turn * values) @ turn.T
    found, vectors, residual, passes = whitening.block_lanczos(lambda b: matrix @ b, d, 16, most)
    assert np.allclose(found, values[:16], rtol=1e-12) and residual < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-13
    assert np.abs(turn[:, :5].T @ vectors[:, 5:]).max() < 1e-10  # the multiple eigenvalue's space is found whole
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11


def test_lanczos_starts_again_after_a_breakdown():
    d = 60
    turn, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))
    for values in ([5.0] * 30 + [1.0] * 10 + [0.0] * 20, [4.0, 3.0] + [0.0] * 58):
        matrix = (turn * np.array(values)) @ turn.T
        found, vectors, _, passes = whitening.block_lanczos(lambda b, m=matrix: m @ b, d, 4)
        assert np.allclose(found, values[:4], atol=1e-12) and np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert whitening.block_lanczos(lambda b: 0 * b, d, 4)[0].tolist() == [0.0] * 4

"""The index of cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import neighbours, retrieval

SCHEMA = "vec_id bigint, embedding array<float>"


def all_pairs(rows, queries, k):
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q, x in queries:
        d = np.sqrt(((data - np.asarray(x, dtype=np.float32).astype(np.float64)) ** 2).sum(1))
        other = np.flatnonzero(ids != q)
        out[q] = [int(ids[i]) for i in other[np.lexsort((ids[other], d[other]))[:k]]]
    return out


def as_dict(df, id_col="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r[id_col])
    return out


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((25, 12)) * 10
    rows = [(i, [float(c) for c in centres[i % 25] + rng.standard_normal(12) * 0.3]) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(400)]  # a very common vector
    return rows


def test_exact_search_prunes_clusters(spark, clusters, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 97)  # many parts of cells and strips of queries
    df = spark.createDataFrame(clusters, SCHEMA).repartition(6)
    asked = df.where("vec_id % 20 = 0")
    index = neighbours.VectorIndex(df, n_cells=25)
    got = index.nearest(asked, 6).cache()
    assert as_dict(got) == all_pairs(clusters, [r for r in clusters if r[0] % 20 == 0], 6)
    compared = got.groupBy("query_id").agg(F.max("compared").alias("n")).agg(F.sum("n")).first()[0]
    assert compared < 0.25 * len(clusters) * asked.count()


def test_exact_search_on_random_directions(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0")
    want = {}
    for r in sorted(retrieval.all_pairs_nearest(asked, df).collect(), key=lambda r: (r.query_id, r["rank"])):
        want.setdefault(r.query_id, []).append(r.vec_id)
    assert as_dict(neighbours.VectorIndex(df).nearest(asked)) == want
    assert as_dict(retrieval.nearest_each(asked, df)) == want


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.1"])
def test_recall_of_probing(spark, scale):
    df = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    asked = df.where("vec_id % 20 = 0")
    exact, found = as_dict(retrieval.all_pairs_nearest(asked, df)), neighbours.VectorIndex(df)
    near = found.nearest(asked, probes=found.probes_for(0.93)).cache()
    got = as_dict(near)
    assert sum(len(set(got.get(q, [])) & set(v)) for q, v in exact.items()) >= 0.9 * sum(map(len, exact.values()))
    assert near.agg(F.avg("compared")).first()[0] < 0.8 * df.count()


def test_few_odd_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(neighbours.VectorIndex(df.where("vec_id is not null")).nearest(df.where("vec_id is not null"), 6))
    assert got == {1: [6, 2], 2: [1, 6], 6: [1, 2]}
    empty = neighbours.VectorIndex(df.limit(0))
    assert empty.nearest(df, 6).collect() == [] and empty.probes_for(0.9) == 1
    assert neighbours.VectorIndex(df).nearest(df.limit(0), 6).collect() == []


def test_visits_are_handed_on_in_bounded_pieces(monkeypatch):
    """Queries that visit every cell, as those of random directions do."""
    monkeypatch.setattr(neighbours, "CELLS_AT_ONCE", 1 << 12)
    rng = np.random.default_rng(4)
    x, centroids = rng.standard_normal((500, 8)), rng.standard_normal((60, 8))
    cells = neighbours.Cells(centroids, np.full(60, 10), np.zeros(60), np.full(60, 9.0))
    pieces = list(neighbours.visits(x, np.full(500, np.inf), cells, 6, None, True))
    assert max(len(each) for each, _, _ in pieces) * 8 <= 1 << 12
    each, cell, far = (np.concatenate(c) for c in zip(*pieces, strict=True))
    assert len(set(zip(each.tolist(), cell.tolist(), strict=True))) == len(each) == 500 * 59
    assert np.allclose(far, np.sqrt(((x[each] - centroids[cell]) ** 2).sum(1)))

"""Chunks of text and their nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.neighbours import VectorIndex

SIZE, OVERLAP = 1500, 200
#: Where a chunk would rather end, best first.
BREAKS = ("\n\n", "\n", " ")


def fixed_chunks(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks ``id, chunk_no, chunk`` at a fixed stride, in the JVM. Blank texts have none."""
    step = size - overlap
    starts = F.when(F.length(F.trim(F.col(text_col))) > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(text_col) - overlap) / step).cast("int") - 1)))
    return df.select(id_col, text_col, F.explode(starts).alias("chunk_no")).select(id_col, "chunk_no", F.expr(f"substring(`{text_col}`, chunk_no * {step} + 1, {size})").alias("chunk"))


def split_at_breaks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters that end at a paragraph, a line or a word where they can."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            for mark in BREAKS:
                at = text.rfind(mark, start + overlap + 1, end)
                if at > start:
                    end = at
                    break
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[id_col], batch[text_col], strict=True) for i, c in enumerate(split_at_breaks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_no", "chunk"])

    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, chunk_no int, chunk string")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, in doubles."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: list[float], k: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to one query vector, ties by id; a metadata filter comes first."""
    rows = vectors if where is None else vectors.where(where)
    scored = rows.withColumn("distance", distance(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy("distance", id_col).limit(k)


def all_pairs_nearest(queries: DataFrame, vectors: DataFrame, k: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """What :func:`nearest_each` gives, by comparing every query with every vector; the measure of the index.

    Vectors and queries are dealt into blocks of about ``block`` rows, and each pair of blocks meets in one task that
    keeps ``k`` rows of each query; those are ranked once more. Nothing is broadcast, and no block grows with the data.
    """
    v_blocks, q_blocks = (-(-df.count() // block) or 1 for df in (vectors, queries))
    dealt = lambda df, n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), dealt(vectors, v_blocks).alias("a")).withColumn("b", each(q_blocks))
    q = queries.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), dealt(queries, q_blocks).alias("b")).withColumn("a", each(v_blocks))

    def best(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found):
            ids, data = found["id"].to_numpy(), np.stack(found["v"].to_numpy()).astype(np.float64)
            for query, x in zip(asked["id"], asked["v"], strict=True):
                d = np.sqrt(((data - np.asarray(x, dtype=np.float64)) ** 2).sum(axis=1))
                other = np.flatnonzero(ids != query)
                for i in other[np.lexsort((ids[other], d[other]))[:k]]:
                    out.append((query, ids[i], d[i]))
        return pd.DataFrame(out, columns=["query_id", "id", "distance"])

    kind = dict(vectors.dtypes)[id_col]
    near = v.groupBy("a", "b").cogroup(q.groupBy("a", "b")).applyInPandas(best, f"query_id {kind}, id {kind}, distance double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), "rank", "distance")


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int = 6, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each of a stated set of queries its ``k`` nearest other vectors: ``query_id``, id, ``rank``, ``distance``."""
    return VectorIndex(vectors, id_col, vector_col).nearest(queries, k).drop("compared")

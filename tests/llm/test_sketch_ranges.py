"""Ranges of the fingerprints' neighbour search, and how far likeness is off."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from gridloom.llm import sketch  # noqa: E402


@pytest.mark.parametrize("n_ranges", [1, 7, 64, 300])
def test_next_rows_over_any_ranges(spark, n_ranges):
    ids = [*range(0, 900, 3), *range(100_000, 100_050), None, None, 2**62, -5, *[33] * 200]
    df = spark.createDataFrame([(i, f"t{k}", k) for k, i in enumerate(ids)], "doc_id bigint, text string, k bigint").repartition(5)
    got = {r.k: r.next.k for r in sketch.with_next(df, "doc_id", ["k"], "k", n_ranges=n_ranges).collect()}
    order = [k for _, k in sorted((-(2**63) if i is None else i, k) for k, i in enumerate(ids))]
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))


def test_ranges_follow_the_bytes(spark, monkeypatch):
    df = spark.range(3000).select("id", F.xxhash64("id").alias("tie"), F.expr("repeat('x', 100)").alias("text"))
    sizes = lambda df: [r["count"] for r in sketch.with_range(df, "id", "tie", F.col("text"), "r").groupBy("r").count().collect()]
    assert len(sizes(df)) == 64
    monkeypatch.setattr(sketch, "RANGE_BYTES", 1500)
    assert 190 <= len(sizes(df)) <= 210 and max(sizes(df)) <= 30
    hot = df.withColumn("id", F.when(F.col("id") % 3 == 0, 1234).otherwise(F.col("id")))  # a third of the rows have one id
    assert max(sizes(hot)) <= 60


def test_error_of_likeness(spark):
    """Against the share of the smaller text's shingles that the larger has, on every document of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in sketch.sketch_digest(docs).collect()}

    def shingles(text):
        w = [x for x in __import__("re").split(sketch.SPACES, text) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    off = []
    for i, (key, text) in enumerate(rows):
        m = len(text) // 4
        a, b = shingles(text), shingles(text[: len(text) - m] + rows[(i + 1) % len(rows)][1][:m])
        least = min(len(a), len(b))
        off.append(abs(got[key].near_edited - (len(a & b) / least if least else float(len(a) == len(b)))))
    assert sum(off) / len(off) < 0.06 and sorted(off)[-len(off) // 50] < 0.25
    assert sum(x > 0.5 for x in off) <= len(off) // 200

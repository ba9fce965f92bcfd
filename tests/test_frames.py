"""Data-frame methods against plain Python: exponential means, transposed tables, cells of two rows, hashed samples."""

import pytest
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.operators import frames, reshape, windows


def plain_means(rows, alpha):
    out, sums = {}, {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        top, bottom = (x * (1 - alpha) for x in sums.get(key, (0.0, 0.0)))
        if value is not None:
            top, bottom = top + value, bottom + 1
        sums[key] = top, bottom
        out[at] = top / bottom if bottom else None
    return out


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_exponential_mean_is_that_of_a_loop(spark, batch):
    """Keys that span batches and blocks, rows without a key, values missing at the start and within."""
    rows = [(None if i % 5 == 4 else i % 5 % 2, i, None if i < 9 or i % 11 == 0 else float(i * 37 % 101)) for i in range(1500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "k int, at int, v double")
        got = {r["at"]: r["ewm"] for r in windows.exponential_mean(df, "k", "at", "v", 0.3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = plain_means(rows, 0.3)
    assert got.keys() == expected.keys()
    for at, value in expected.items():
        assert got[at] is None if value is None else got[at] == pytest.approx(value, rel=1e-12)


def test_exponential_mean_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, at int, v double")
    assert windows.exponential_mean(df, "k", "at", "v", 0.5).collect() == []


def test_group_frames(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 4), (5, 8), (9, 16)], "at int, v int")
    sums = lambda before, after: {r["v"]: r["s"] for r in windows.over_groups(df, [], ["at"], before, after, F.sum("v"), "s").collect()}
    assert sums(1, 0) == {1: 3, 2: 3, 4: 7, 8: 12, 16: 24}
    assert sums(None, 1) == {1: 7, 2: 7, 4: 15, 8: 31, 16: 31}


def test_two_rows_of_a_cell_are_an_error(spark):
    df = spark.createDataFrame([("a", "x", 1.0, "p"), ("a", "y", 2.0, "q"), ("b", "x", None, None)], "k string, c string, n double, t string")
    for value, expected in (("n", {("a", 1.0, 2.0), ("b", None, None)}), ("t", {("a", "p", "q"), ("b", None, None)})):
        assert {tuple(r) for r in reshape.unstack(df, ["k"], "c", value, ["x", "y"]).collect()} == expected
        with pytest.raises(PySparkException, match="More than one row"):
            reshape.unstack(df.union(df), ["k"], "c", value, ["x", "y"]).collect()


def test_transposed_twice_is_the_table(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, None)], "label string, u int, v int")
    once = reshape.transpose(df, "label", ["a", "b"], "label")
    assert {tuple(r) for r in once.collect()} == {("u", 1, 3), ("v", 2, None)}
    assert {tuple(r) for r in reshape.transpose(once, "label", ["u", "v"], "label").collect()} == {tuple(r) for r in df.collect()}


def test_hashed_sample_against_the_hash(spark):
    """The rows that XXH64, chained over the columns from seed 42, puts under the share."""
    df = spark.createDataFrame([(i, i % 7) for i in range(4000)], "a bigint, b int")
    got = {(r["a"], r["b"]) for r in frames.hashed_sample(df, ["a", "b"], 0.1, seed=3).collect()}

    def chosen(a, b):
        h = 42
        for n, size in ((3, 4), (a, 8), (b, 4)):
            h = xxhash.xxh64_intdigest(n.to_bytes(size, "little"), seed=h)
        return h % (1 << 20) < int(0.1 * (1 << 20))

    assert got == {(a, b) for a, b in ((i, i % 7) for i in range(4000)) if chosen(a, b)}
    assert 300 < len(got) < 500
    assert got == {(r["a"], r["b"]) for r in frames.hashed_sample(df.repartition(5), ["a", "b"], 0.1, seed=3).collect()}

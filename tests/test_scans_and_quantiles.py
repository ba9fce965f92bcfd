"""Two-level running values, as-of joins with a hot key and distributed selection, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import quantiles, relational
from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.scans import Scan, asof_join, scanned
from gridloom.plans import relational_queries


@pytest.fixture
def twenty_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, rng.choice([None, "hot", "hot", "hot", f"k{i % 40}"]), rng.choice([None, rng.randint(-50, 50)])) for i in range(3000)]
    return made, spark.createDataFrame(made, "i int, k string, v int").repartition(7)


def every():
    return {"total": Scan("sum", F.col("v")), "n": Scan("count"), "top": Scan("max", F.col("v")), "low": Scan("min", F.col("v")), "last": Scan("last", F.col("v")), "next": Scan("next", F.col("v"))}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_values(twenty_ranges, rows, keys):
    made, df = rows
    want, state = {}, {}
    for i, k, v in made:
        s = state.setdefault(k if keys else 0, {"vs": [], "n": 0})
        s["n"] += 1
        s["vs"] += [v] if v is not None else []
        vs = s["vs"]
        want[i] = [sum(vs) if vs else None, s["n"], max(vs, default=None), min(vs, default=None), vs[-1] if vs else None]
    ahead = {}
    for i, k, v in reversed(made):
        key = k if keys else 0
        ahead[key] = v if v is not None else ahead.get(key)
        want[i].append(ahead[key])
    got = {r.i: list(r[1:]) for r in scanned(df, ["i"], every(), keys).select("i", *every()).collect()}
    assert got == want


def test_no_frame_shrinks(spark, rows, data):
    """A frame from a row to the end is read anew for every row, which grows with the square of the rows."""
    _, df = rows
    frames = [scanned(df, ["i"], every(), ["k"]), relational_queries.win_fill(spark, data), relational_queries.win_interpolate(spark, data)]
    for found in frames:
        assert "currentrow$(), unboundedfollowing$()" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_no_task_holds_a_tenth(twenty_ranges, rows):
    _, df = rows
    for keys in ([], ["k"]):
        sizes = [r["count"] for r in relational.ranged(df, [*keys, "i"]).groupBy("__range", *keys).count().collect()]
        assert max(sizes) <= 300
    plan = scanned(df, ["i"], every())._jdf.queryExecution().executedPlan().toString()
    # The only windows without a key go over one row for each range.
    assert "CartesianProduct" not in plan


def test_scans_of_nothing(spark):
    empty = spark.createDataFrame([], "i int, k string, v int")
    assert scanned(empty, ["i"], every()).collect() == [] and scanned(empty, ["i"], every(), ["k"]).collect() == []


@pytest.mark.parametrize("most", [10**9, 5])
def test_asof_join_with_a_hot_key(twenty_ranges, spark, most):
    rng = random.Random(6)
    users = [None if rng.random() < 0.05 else 0 if rng.random() < 0.5 else rng.randint(1, 30) for _ in range(2500)]
    left = [(i, u, rng.randint(0, 900)) for i, u in enumerate(users[:1200])]
    right = [(i, u, rng.randint(0, 900), f"r{i}") for i, u in enumerate(users[1200:])]
    a, b = spark.createDataFrame(left, "i int, u int, t int"), spark.createDataFrame(right, "j int, u int, t int, w string")
    got = {r.i: r.w for r in asof_join(a, b, ["u"], "t", ["w"], tie="j", most=most).collect()}
    plain = {r.i: r.w for r in asof_join(a, b, ["u"], "t", ["w"], tie="j").collect()}
    want = {i: max(((rt, j, w) for j, ru, rt, w in right if ru == u and rt <= t), default=(0, 0, None))[2] for i, u, t in left}
    assert got == want == plain
    close = asof_join(a, b, ["u"], "t", ["w"], tie="j", tolerance=F.lit(10), most=most)
    for r in close.collect():
        best = max(((rt, j, w) for j, ru, rt, w in right if ru == left[r.i][1] and rt <= left[r.i][2]), default=None)
        assert r.w == (best[2] if best and left[r.i][2] - best[0] <= 10 else None)


SHARES = [0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1]


@pytest.mark.parametrize("most", [3, 100, 100_000])
def test_quantiles_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    rng = np.random.default_rng(1)
    groups = {"wide": rng.lognormal(0, 9, 4000), "hot": np.where(rng.random(4000) < 0.97, 7.0, rng.standard_normal(4000)), "two": np.repeat([1.0, 2.0], 5), "one": np.array([3.5]), None: rng.standard_normal(999)}
    made = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("wide", float("nan"))]
    df = spark.createDataFrame(made, "k string, v double").repartition(5)
    got = {r.k: r.quantiles for r in exact_quantiles(df, "v", SHARES, ["k"]).collect()}
    assert got.pop("none") is None
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, SHARES), rtol=1e-12, atol=1e-12), k


@pytest.mark.parametrize("most", [50, 100_000])
def test_quantiles_of_one_group_of_all_rows(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    df = spark.range(200_000).select((F.xxhash64("id") % 1000003).alias("v"))
    want = df.agg(F.percentile("v", [0.1, 0.5, 0.99])).first()[0]
    assert exact_quantiles(df, "v", [0.1, 0.5, 0.99]).first().quantiles == pytest.approx(want, rel=1e-12)
    assert exact_quantiles(df.limit(0), "v", [0.5]).first().quantiles is None
    assert exact_quantiles(df.limit(0).withColumn("k", F.lit(1)), "v", [0.5], ["k"]).collect() == []
    # No aggregate of the plan gathers values: sketches and counts only.
    plan = exact_quantiles(df, "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_band_join_deals_points_in_ranges(spark, tmp_path):
    """Points that follow each other lie in the same ranges, so files are far smaller than a bit-packed number a row; no row is lost."""
    events = spark.range(12_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 4 == 0, 5.25).otherwise(F.col("id") * 7919 % 1000 / 10.0).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(6_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    relational_queries.join_band(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    expected = events.where("value - floor(value) <= 0.5 and value < 100.0").count() * 60
    assert out.count() == out.distinct().count() == expected
    assert out.join(events, "event_id").where("band % 100 <> floor(value)").isEmpty()
    assert out.withColumn("file", F.input_file_name()).where("event_id % 4 = 0").select("file").distinct().count() > 1  # of one value
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.5 * expected

"""Merged sketches against direct ones and against exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sketches


@pytest.fixture(scope="module")
def events(spark, data):
    return spark.read.parquet("/root/testdata/sf0.1/events.parquet").withColumn("day", F.to_date("ts")).select("day", "event_type", "user_id", "value", "event_id")


def test_merged_equals_direct_within_the_error(spark, events, tmp_path):
    path = str(tmp_path / "by-day")
    by_day = sketches.sketched(events, ["day", "event_type"], ["user_id", "event_id"], ["value"])
    sketches.store(by_day, path, "day")
    sketches.store(by_day.where(F.col("day") == events.agg(F.min("day")).first()[0]), path, "day")  # a day done once more
    stored = spark.read.parquet(path)
    assert stored.select("day").distinct().count() > 5
    shares = [0.05, 0.5, 0.95]
    got = {r.event_type: r for r in sketches.read_off(sketches.merged(stored, ["event_type"]), shares).collect()}
    direct = {r.event_type: r for r in sketches.read_off(sketches.sketched(events, ["event_type"], ["user_id", "event_id"], ["value"]), shares).collect()}
    exact = events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.sum("value").alias("total"), F.sort_array(F.collect_list("value")).alias("values")).collect()
    assert set(got) == set(direct) == {r.event_type for r in exact}
    for r in exact:
        a, b, values = got[r.event_type], direct[r.event_type], np.array(r["values"])
        assert a.n == b.n == r.n and a.sum_value == pytest.approx(r.total)
        for c, want in (("user_id", r.users), ("event_id", r.n)):
            for kind in ("distinct", "set"):
                assert a[f"{kind}_{c}"] == pytest.approx(want, rel=0.07)  # four standard deviations
                assert a[f"{kind}_{c}"] == pytest.approx(b[f"{kind}_{c}"], rel=0.07)
        for s, q in zip(shares, a.quantiles_value, strict=True):
            assert np.searchsorted(values, q, "left") / len(values) - 0.04 <= s <= np.searchsorted(values, q, "right") / len(values) + 0.04


def test_common_users_of_days(events):
    by_type = sketches.sketched(events, ["event_type"], ["user_id"])
    a, b = (by_type.where(f"event_type = '{t}'").select(F.col("set_user_id").alias(t)) for t in ("click", "view"))
    both = a.join(b).select(F.theta_sketch_estimate(F.theta_intersection("click", "view"))).first()[0]  # one row each
    want = events.where("event_type = 'click'").select("user_id").intersect(events.where("event_type = 'view'").select("user_id")).count()
    assert both == pytest.approx(want, rel=0.1)


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "x", 2.0), ("b", "x", None)], "k string, u string, v double")
    got = {r.k: r for r in sketches.read_off(sketches.merged(sketches.sketched(df, ["k"], ["u"], ["v"]), ["k"])).collect()}
    assert (got["a"].n, got["a"].distinct_u, got["a"].quantiles_v) == (1, 0, None)
    assert (got["b"].n, got["b"].distinct_u, got["b"].set_u, got["b"].quantiles_v) == (2, 1, 1, [2.0])
    assert sketches.read_off(sketches.merged(sketches.sketched(df.limit(0), ["k"], ["u"], ["v"]), ["k"])).collect() == []

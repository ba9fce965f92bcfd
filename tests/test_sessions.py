"""Streams of sessions with a closing event, drained in shuffled batches, against sessions found over the whole table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.streaming import jobs, sessions

START, GAP, LATE = datetime(2024, 3, 1), timedelta(minutes=30), timedelta(hours=2)
SCHEMA = "user_id bigint, ts timestamp, value double, event_type string"


def whole(events):
    """(user, start, end, n, total, closed) of sessions of (user, time, value, type), and the time from which each is known."""
    out, by_user = [], {}
    for e in sorted(events):
        by_user.setdefault(e[0], []).append(e)
    for user, own in by_user.items():
        run = []
        for i, e in enumerate(own):
            run.append(e)
            buys = e[3] == "purchase"
            if buys or i + 1 == len(own) or own[i + 1][1] - e[1] > GAP:
                known = e[1] if buys else e[1] + GAP
                out.append(((user, run[0][1], e[1], len(run), round(sum(x[2] for x in run), 6), buys), known))
                run = []
    return out


@pytest.fixture(scope="module")
def events():
    rng = random.Random(8)
    # One user has a third of the events.
    return [(0 if rng.random() < 0.33 else rng.randrange(1, 25), START + timedelta(seconds=rng.randrange(86_400)), float(rng.randrange(100)), rng.choice(["view", "click", "click", "purchase"])) for _ in range(1500)]


def drained(spark, tmp_path, batches, lateness):
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = sessions.closing_sessions(stream, "user_id", "ts", "value", F.col("event_type") == "purchase", "30 minutes", lateness)
    folders = str(tmp_path / "sessions"), str(tmp_path / "late")
    for _ in range(2):  # the second run goes on where the first ended, and finds nothing new
        jobs.drain(out, sessions.apart(*folders), str(tmp_path / "state")).awaitTermination()
    read = lambda f: [(r.user_id, r.started, r.ended, r.n, round(r.total, 6), r.closed) for r in spark.read.parquet(f).drop("batch").collect()]
    return read(folders[0]), read(folders[1])


def test_shuffled_batches_give_the_sessions_of_the_whole(spark, tmp_path, events):
    rng = random.Random(9)
    # Events come up to an hour out of order, within the lateness of two.
    order = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.randrange(3600)))
    got, late = drained(spark, tmp_path, [order[i : i + 250] for i in range(0, len(order), 250)], "2 hours")
    passed = max(e[1] for e in events) - LATE
    assert late == [] and sorted(got) == sorted(s for s, known in whole(events) if known <= passed)
    assert any(s[5] for s in got) and any(not s[5] for s in got) and len(got) > 300


def test_late_rows_are_kept_aside(spark, tmp_path, events):
    early = sorted(e for e in events if e[1] < START + timedelta(hours=6))
    rest = sorted((e for e in events if e[1] >= START + timedelta(hours=6)), key=lambda e: e[1])
    held = early[::10]
    batches = [[e for e in early if e not in held], rest, held]
    got, late = drained(spark, tmp_path, batches, "2 hours")
    assert sorted((u, s) for u, s, *_ in late) == sorted((e[0], e[1]) for e in held)
    passed = max(e[1] for e in events) - LATE
    kept = [e for e in events if e not in held]
    assert sorted(got) == sorted(s for s, known in whole(kept) if known <= passed)


@pytest.mark.parametrize("watermark", [0, 5, 10, 11, 20, 31, 100])
def test_what_the_watermark_finishes(watermark):
    events = [(0, 1.0, False), (10, 1.0, False), (21, 1.0, True), (22, 1.0, False), (40, 1.0, False)]
    done, rest, again = sessions.finished(events, watermark, 10)
    want = {0: 0, 5: 0, 10: 0, 11: 0, 20: 1, 31: 2, 100: 4}[watermark]
    assert len(done) == want - (watermark == 31) * 0 and sum(d[2] for d in done) + len(rest) == 5
    assert (again is None) == (not rest) and (again is None or again > watermark)

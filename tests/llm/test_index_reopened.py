"""The fingerprint index is kept below its folder and goes on in a later session."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from gridloom.llm import substring_index as index  # noqa: E402
from gridloom.llm.scratch import scratch_dir, scratch_path  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(6)]
    prose = lambda: " ".join(f"v{rng.randrange(400)}" for _ in range(25))
    rows = [(i, f"{prose()} {rng.choice(passages)} {prose()}" if i % 3 else prose()) for i in range(90)]
    return index._texts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").cache()


def batch(texts, i):
    return texts.where(f"d >= {i * 30} and d < {(i + 1) * 30}")


def cuts(parts, texts):
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    return {(r.d, i) for r in index.verified(seen, texts).collect() for i in range(r.first, r.last + 1)}


@pytest.mark.parametrize("max_runs", [1, 4])
def test_a_later_session_goes_on(spark, texts, max_runs):
    whole = index.FingerprintIndex(spark, buckets=3, max_runs=max_runs)
    want = cuts([whole.add(batch(texts, i)) for i in range(3)], texts)
    assert whole.path.startswith(scratch_dir(spark)) and want
    folder = spark.sql(f"DESCRIBE EXTENDED {whole.name}").where("col_name = 'Location'").first().data_type
    assert folder.split("gridloom-index")[1] == whole._folder().split("gridloom-index")[1]
    whole.drop()

    path = scratch_path(spark, "kept-index")
    first = index.FingerprintIndex(spark, buckets=3, max_runs=max_runs, path=path)
    parts = [first.add(batch(texts, 0)), first.add(batch(texts, 1))]
    first.close()
    # What a killed batch leaves: a run that no state knows.
    spark.range(5).withColumn("run", F.lit(first.made)).write.partitionBy("run").mode("append").parquet(first._folder())
    later = spark.newSession()
    again = index.FingerprintIndex.open(later, path)
    assert (again.made, again.live, again.hot) == (first.made, first.live, first.hot)
    runs = [int(r.run) for r in later.table(again.name).select("run").distinct().collect()]
    assert runs and max(runs) < again.made
    parts.append(again.add(batch(texts, 2)))
    assert cuts(parts, texts) == want
    # A batch that is added once more finds nothing that it didn't find before.
    once_more = again.add(batch(texts, 2))
    assert cuts([*parts, once_more], texts) == want
    again.drop()
    assert not index._children(spark, path.rsplit("/", 1)[0]).count(path.rsplit("/", 1)[1])


@pytest.mark.parametrize("keys", [1, 1_000_000])
def test_a_small_batch_reads_the_parts_it_needs(spark, texts, monkeypatch, keys):
    whole = index.FingerprintIndex(spark, buckets=3)
    want = cuts([whole.add(batch(texts, i)) for i in range(3)], texts)
    whole.drop()
    monkeypatch.setattr(index.skew, "BROADCAST_KEYS", keys)  # the parts are broadcast, or joined by shuffle
    monkeypatch.setattr(index.FingerprintIndex, "SMALL", 1)  # the second and the third batch are smaller than what is there
    small = index.FingerprintIndex(spark, buckets=3)
    read = []
    to_join = small._to_join
    monkeypatch.setattr(small, "_to_join", lambda: (lambda df: (read.append((df.count(), small.rows)), df)[1])(to_join()))
    parts = [small.add(batch(texts, i)) for i in range(3)]
    assert cuts(parts, texts) == want and read[0][0] == read[0][1] and all(n < rows for n, rows in read[1:])
    small.drop()

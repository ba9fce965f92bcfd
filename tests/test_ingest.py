"""Chunks of arriving files under kills and re-ingests."""

import os

import pytest

from gridloom.retrieval import split_at_breaks
from gridloom.streaming import ingest


def put(source, name, text):
    put.clock = getattr(put, "clock", 1_700_000_000) + 10
    path = source / str(put.clock) / name
    path.parent.mkdir()
    path.write_text(text, encoding="utf-8")
    os.utime(path, (put.clock, put.clock))


def found(spark, folder):
    out = {}
    for r in ingest.current_chunks(spark, folder).collect():
        out.setdefault(r.file, {}).setdefault(r.chunk_no, []).append(r.chunk)
    return out


def expected(texts):
    return {n: {i: [c] for i, c in enumerate(split_at_breaks(t))} for n, t in texts.items() if split_at_breaks(t)}


@pytest.fixture
def places(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    return source, str(tmp_path / "out")


def test_a_kill_between_write_and_commit(spark, places, monkeypatch):
    source, folder = places
    texts = {"a.txt": "alpha beta " * 500, "b.txt": "short", "c.txt": " ", "d.txt": "é " * 2000}
    for n, t in texts.items():
        put(source, n, t)
    whole = ingest.commit

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(spark, str(source), folder)
    assert os.path.exists(f"{folder}/chunks/batch=0") and not os.path.exists(f"{folder}/commits")
    monkeypatch.setattr(ingest, "commit", whole)
    ingest.ingest(spark, str(source), folder)  # the batch is run again
    assert found(spark, folder) == expected(texts)
    assert {r.file: r.n_chunks for r in ingest.committed(spark, folder).collect()} == {n: len(split_at_breaks(t)) for n, t in texts.items()}
    ingest.ingest(spark, str(source), folder)  # nothing new
    assert found(spark, folder) == expected(texts)


def test_an_uncommitted_batch_does_not_count_and_a_new_state_replaces(spark, places, monkeypatch, tmp_path):
    source, folder = places
    put(source, "a.txt", "one two three " * 400)
    put(source, "b.txt", "stays as it is")
    ingest.ingest(spark, str(source), folder)
    first = found(spark, folder)
    put(source, "a.txt", "shorter now")
    put(source, "new.txt", "came later")
    whole = ingest.commit
    monkeypatch.setattr(ingest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(spark, str(source), folder)
    assert found(spark, folder) == first
    monkeypatch.setattr(ingest, "commit", whole)
    ingest.ingest(spark, str(source), folder)
    want = expected({"a.txt": "shorter now", "b.txt": "stays as it is", "new.txt": "came later"})
    assert found(spark, folder) == want
    ingest.compact(spark, folder, str(tmp_path / "compact"))
    assert found(spark, str(tmp_path / "compact")) == want

"""Decontamination against a search of every window in every text."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

from gridloom.llm import decontaminate as d  # noqa: E402
from gridloom.llm import queries  # noqa: E402
from gridloom.llm import words as words_of  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
PATHS = [{}, {"most_pairs": 0}]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def expected(docs, items):
    """(id, words, hit words, items) of each document."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    lengths = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if items_of := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    found |= items_of
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r.f.n_words, r.f.n_hit, [x or "" for x in r.f["items"]]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünter", "straße", "x" * 300, "né", "10", "中文"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([10, 11, 15, 30]))) for i in range(12)] + [(20, "w1 W2 w3"), (21, "w7"), (22, "w5 w5 w5 w5"), (23, ""), (24, None), (None, prose(14)), (25, "!?"), (26, "a b c d e f g h i"), (3, prose(12)), (27, "a a a a a a a a a a a")]
    hot = items[0][1]
    docs = [(i, f"{prose(rng.randint(0, 60))}; {(rng.choice(items)[1] or '').upper()}" if i % 3 else prose(rng.randint(0, 30))) for i in range(60)]
    docs += [(100 + i, f"{prose(3)} {hot} {prose(2)}") for i in range(40)] + [(200, None), (201, ""), (202, "..."), (None, hot), (203, hot), (203, hot), (204, "a " * 50), (205, f"{prose(9000)} {hot}\n{hot}"), (206, "a,b;c d-e f_g h i")]
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("path", PATHS)
def test_every_window(tables, path):
    docs, items, docs_df, items_df = tables
    got = found(d.with_hits(docs_df, items_df, name="f", **path).select("doc_id", "f"))
    assert got == expected(docs, items) and sum(bool(r[2]) for r in got) > 40


@pytest.mark.parametrize("path", PATHS)
def test_spans_and_clean_documents(tables, path):
    docs, items, docs_df, items_df = tables
    rows = d.with_hits(docs_df, items_df.where("item_id in (0, 26)"), name="f", **path).where("doc_id is not null").collect()
    for r in rows:
        assert sum(s.words for s in r.f.spans) == r.f.n_hit
        assert all(a.first + a.words < b.first for a, b in zip(r.f.spans, r.f.spans[1:], strict=False))
    kept = {r.doc_id for r in d.clean(docs_df, items_df.where("item_id in (0, 26)"), **path).collect()}
    assert kept == {r.doc_id for r in rows if not r.f.n_hit} and 206 not in kept and 204 in kept


@pytest.mark.parametrize("path", PATHS)
def test_extra_columns_and_empty_tables(spark, tables, path):
    docs, items, docs_df, items_df = tables
    plain = found(d.with_hits(docs_df, items_df, name="f", **path).select("doc_id", "f"))
    wide = docs_df.selectExpr("*", "'x' AS __text", "'x' AS sha", "'x' AS n", "'x' AS window", "'x' AS items", "'x' AS row", "'x' AS f", "'x' AS item", "'x' AS m", "'x' AS gram")
    out = d.with_hits(wide, items_df.selectExpr("*", "'x' AS window", "'x' AS item", "'x' AS m"), name="f", **path)
    assert sorted(out.columns) == sorted(wide.columns) and found(out.select("doc_id", "f")) == plain
    assert out.select("sha", "window", "row").distinct().collect() == [("x",) * 3]
    assert d.decontamination_digest(docs_df.limit(0), items_df, **path).collect() == []
    assert found(d.with_hits(docs_df, items_df.limit(0), name="f", **path).select("doc_id", "f")) == expected(docs, [])


def test_texts_longer_than_a_chunk():
    long = "q" * (2 * words_of.CHUNK + 17)
    text = f"one {long} two " + "three four five six seven eight nine ten eleven " * 60_000 + long.upper()
    w = words_of.Words(pa.array([text, None, "two three", ""]))
    want = words(text)
    assert len(w.hashes) == len(want) + 2 and w.firsts.tolist() == [0, len(want), len(want), len(want) + 2, len(want) + 2]
    assert w.hashes[1] == w.hashes[len(want) - 1] and w.text(1, 2) == f"{long} two".encode()
    assert len(set(w.hashes.tolist())) == len(set(want))
    kept = [int(k) + low for low, high in w.segments() for s, k, g in [d.winnowed(w, 10, low, high)] for k in set(k.tolist())]
    assert max(kept) >= len(want) - 10 and len(list(w.segments())) > 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("abc"), max_size=20), st.integers(1, 10))
def test_equal_windows_keep_equal_runs(shared, before, after, m):
    a, b = words_of.Words(pa.array([" ".join(shared)])), words_of.Words(pa.array([" ".join(before), " ".join([*before, *shared, *after])]))
    starts, kept, grams = d.winnowed(a, m)
    b_starts, b_kept, b_grams = d.winnowed(b, m)
    of = dict(zip(b_starts.tolist(), zip((b_kept - b_starts).tolist(), b_grams[b_kept].tolist(), strict=True), strict=True))
    assert len(starts) == max(0, len(shared) - m + 1) and len(b_starts) == max(0, len(before) - m + 1) + max(0, len(before) + len(shared) + len(after) - m + 1)
    for s, k in zip(starts.tolist(), kept.tolist(), strict=True):
        assert of[2 * len(before) + s] == (k - s, int(grams[k]))


def test_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op11_decontamination']})").fetchall()
    df = queries.op11_decontamination(spark, data)
    assert df.columns == COLUMNS
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got == sorted(sql, key=str) and any(r[-1] for r in got)

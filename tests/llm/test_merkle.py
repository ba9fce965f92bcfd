"""The Merkle manifest against trees built level by level."""

import hashlib
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from gridloom.llm import merkle, queries  # noqa: E402

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for row in levels[:-1]:
        out.append("" if i ^ 1 >= len(row) else "<>"[1 - i % 2] + row[i ^ 1])
        i >>= 1
    return out


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def expected(rows):
    """Digest rows of (doc_id, source, lang, n_chars, text), by whole trees."""
    runs = {}
    for r in rows:
        runs.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(r)
    for rs in runs.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {k: tree([leaf_of(r) for r in rs]) for k, rs in runs.items()}
    top = tree([trees[k][-1][0] for k in sorted(runs)])
    out = []
    for j, k in enumerate(sorted(runs)):
        for i, r in enumerate(runs[k]):
            path = siblings(trees[k], i) + siblings(top, j)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = merkle.fold(leaf_of((*r[:3], r[3] + 1, r[4])) if hit else leaf_of(r), path)
            out.append((r[0], leaf_of(r), trees[k][-1][0], top[-1][0], h(*[s[1:] for s in path]), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("span", [1, 2, 3, 4])
def test_fractal_paths_are_those_of_the_whole_tree(span):
    for n in [*range(1, 20), 31, 32, 33, 64, 65, 100, 129, 513]:
        leaves = [h(str(i)) for i in range(n)]
        levels, height = tree(leaves), merkle.height_of(n)
        given = [x.encode() for x in leaves]
        assert merkle.root_of(given, height).decode() == levels[-1][0]
        assert list(merkle.paths(given, height, span)) == [siblings(levels, i) for i in range(n)]


def test_traversal_keeps_two_subtrees_a_level_group(monkeypatch):
    most, alive = 0, []

    class Counted(merkle.Subtree):
        def __init__(self, *a):
            super().__init__(*a)
            alive.append(self)

    monkeypatch.setattr(merkle, "Subtree", Counted)
    for _ in merkle.paths([b"x"] * 4096, 12, 3):
        most = max(most, *(len(s.nodes) + len(s.stack) for s in alive[-8:]))
    assert most <= 2**4 + 12  # nodes of three levels and a stack


@pytest.mark.parametrize("most", [2, 3, 12])
def test_digest_over_small_and_large_blocks(spark, data, most):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = rows_of(merkle.manifest_digest(docs, most))
    assert got == expected(rows) and 0 < sum(not r[-1] for r in got) < len(got)


def test_nulls_ties_repeats_and_one_run(spark):
    rows = [(i % 9 if i % 5 else None, None if i % 3 else "s", [None, "", "é", "zz", "a"][i % 5] if i < 30 else "only" if i == 30 else "hot", None if i % 4 == 0 else i % 2, None if i % 7 == 0 else "x" * (i % 3)) for i in range(90)]
    rows += rows[:4] + [(2**62 + 1, "big", "hot", 2**63 - 1, "y" * 100_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    want = expected(rows)
    assert rows_of(merkle.manifest_digest(docs, 2)) == want
    wide = docs.selectExpr("*", "'x' AS run", "'x' AS at", "'x' AS n", "'x' AS block", "'x' AS digest", "'x' AS __no", "'x' AS id", "'x' AS root")
    assert rows_of(merkle.manifest_digest(wide)) == want
    assert rows_of(merkle.manifest_digest(docs.limit(0))) == []


def test_manifest_paths_fold_to_the_root(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = merkle.manifest(docs, fields=["doc_id", "text"], run="source").collect()
    assert len(found) == docs.count() and len({r.root for r in found}) == 1
    assert all(merkle.fold(r.leaf, r.path) == r.root for r in found)
    assert not any(merkle.fold(h("other"), r.path) == r.root for r in found)


def test_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    sql = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE_SQL['op12_merkle_manifest']})").fetchall()
    assert rows_of(queries.op12_merkle_manifest(spark, data)) == sorted(sql, key=str)

"""Quality verdicts, shards and the whole pipeline against plain Python over all rows."""

import re
import sys
import zlib
from collections import Counter
from fractions import Fraction
from math import comb
from pathlib import Path

import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from gridloom.llm import near_copies, packing, quality, queries, sharding  # noqa: E402
from test_pii_forms import KEY, brute  # noqa: E402

SPACES = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


# 7


def measured(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), len(lines) - len(set(lines)), len(hit)


def fails(m, step):
    n, _, symbols, lines, again, repeated = m
    return symbols / max(n, 1) >= step[0] or again / max(lines, 1) >= step[1] or repeated / max(n, 1) >= step[2]


def certified(documents, labels):
    """The step of each language, by exact binomial sums in fractions."""
    seen = {}
    for doc, text, lang in documents:
        m = measured(text)
        if doc in labels and not (m[0] < 10 or 100 * m[5] > 20 * m[0]):
            seen.setdefault(lang, []).append((m, labels[doc]))
    out = {}
    for lang, rows in seen.items():
        good, bad = [m for m, q in rows if q == 1], [m for m, q in rows if q == 0]
        best, gain = None, 0
        for i, step in enumerate(quality.PATH):
            wrong, right, n, p = sum(fails(m, step) for m in good), sum(fails(m, step) for m in bad), len(good), Fraction(1, 20)
            if not n or wrong > n * p or sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(wrong + 1)) > Fraction(1, 20) / len(seen):
                break
            if right - 10 * wrong > gain:
                best, gain = i, right - 10 * wrong
        out[lang] = best
    return out


def verdicts(documents, labels):
    steps = certified(documents, labels)
    out = {}
    for doc, text, lang in documents:
        m = measured(text)
        base = m[0] < 10 or 100 * m[5] > 20 * m[0]
        step = steps.get(lang)
        out[doc] = (m[0], m[1], m[2], m[4], m[5], base, not base and not (step is not None and fails(m, quality.PATH[step])))
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_quality_of_every_document(spark, scale):
    home = f"/root/testdata/{scale}"
    documents = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{home}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{home}/labels.parquet").collect() if r.quality in (0, 1)}
    got = {r[0]: tuple(r[1:8]) for r in queries.op7_quality_rules(spark, home).collect()}
    assert got == verdicts(documents, labels)
    assert scale == "sf0.001" or any(not v[-1] and not v[-2] for v in got.values())


# 9


def spark_hash(*values):
    """Spark's xxhash64 of integers, longs (as ``L``) and texts."""
    h = 42
    for v in values:
        raw = v.to_bytes(4, "little", signed=True) if isinstance(v, int) else v.to_bytes() if hasattr(v, "to_bytes") else v.encode()
        h = xxhash.xxh64_intdigest(raw, h)
    return h - 2**64 if h >= 2**63 else h


class L:
    def __init__(self, v):
        self.v = v

    def to_bytes(self):
        return self.v.to_bytes(8, "little", signed=True)


def test_shards_and_slots_of_every_document(spark, data):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    seed, n_blocks, n_shards = 20240, 64, 16
    rows = []
    for doc, raw in docs:
        size, crc = len(raw) + 1, zlib.crc32(raw)
        rows.append({"doc": doc, "size": size, "crc": crc, "block": spark_hash(L(doc), seed) % n_blocks, "h1": spark_hash(seed + 1, L(doc)), "h2": spark_hash(seed + 2, L(doc), L(doc), L(size), L(crc))})
    counts = Counter(r["block"] for r in rows)
    blocks = sorted(counts)
    drawn = sharding.communication_matrix([counts[b] for b in blocks], [len(rows) // n_shards + (i < len(rows) % n_shards) for i in range(n_shards)], seed)
    for i, b in enumerate(blocks):
        own = sorted((r for r in rows if r["block"] == b), key=lambda r: (r["h1"], r["h2"]))
        for r, shard in zip(own, np.repeat(np.arange(n_shards), drawn[i]).tolist(), strict=True):
            r["shard"] = shard
    n_ranges = -(-n_blocks // n_shards)
    want = set()
    for s in range(n_shards):
        own = sorted((r for r in rows if r["shard"] == s), key=lambda r: (spark_hash(seed + 3, L(r["h2"])) % n_ranges, spark_hash(seed + 4, L(r["h2"])), r["h2"], r["h1"]))
        want |= {(r["doc"], r["size"], r["crc"], "rows", s, slot, None) for slot, r in enumerate(own)}
    got = {tuple(r) for r in queries.op9_sharding(spark, data).collect()}
    assert got == want


# The pipeline


def near_copies_kept(documents):
    """The least id of each group of texts that share four fifths of their five-word shingles."""
    sets = {}
    for doc, text in documents:
        w = near_copies.lower_words(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            union = len(sets[a] | sets[b])
            if (union == 0) or 5 * len(sets[a] & sets[b]) >= 4 * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(d) for d in ids}


def without_repeats(documents):
    first, out = {}, {}
    split = {d: words(t) for d, t in documents}
    for d in sorted(split):
        for i in range(len(split[d]) - 12):
            first.setdefault(tuple(split[d][i : i + 13]), d)
    for d, text in documents:
        w, gone = split[d], set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text
    return out


def test_the_whole_pipeline(spark, data):
    spark.conf.set("spark.gridloom.pii.key", KEY)
    try:
        pieces = corpus_pipeline.run(spark, data).collect()
    finally:
        spark.conf.unset("spark.gridloom.pii.key")
    documents = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality in (0, 1)}
    kept = {d for d, v in verdicts(documents, labels).items() if v[-1]}
    documents = [(d, t) for d, t, _ in documents if d in kept]
    least = near_copies_kept(documents)
    texts = without_repeats([(d, t) for d, t in documents if d in least])
    texts = {d: brute(t) for d, t in texts.items()}
    assert 0 < len(texts) < len(documents)

    enc = packing.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    of, sequences = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    assert set(of) == set(texts)
    for d, text in texts.items():
        ids = np.array([*enc.encode_ordinary(text or ""), 0], dtype="<u4")
        at = 0
        for p in sorted(of[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024

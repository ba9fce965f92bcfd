"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints that differ in ``radius`` bits or fewer (two by default) agree on one of any ``radius + 1`` parts of the
bits. The upper nodes of the index are such shared bit patterns under a mask: they are keys of a shuffle. A node that
holds too many fingerprints is split by as many further parts of its remaining bits, and so on, which loses no link.
Below them, fingerprints are sorted by Gray rank and runs of them form nodes that keep the bits all their members
share; pairs of nodes are compared from the top, and a pair whose shared bits already differ in more places is dropped
with all that lies below it. A node gives links that span its local components, not all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.scratch import discard, materialize
from gridloom.llm.skew import join_hot

BITS, RADIUS, FANOUT = 64, 2, 16
#: A node of more fingerprints is split by further bits.
NODE_LIMIT = 2_000
#: Splitting ends where a node's fingerprints share so many bits (at most 256 can), or at so many masks, which a radius
#: of two or less doesn't reach; the nodes left are searched whole, eight bytes a fingerprint.
SHARED_BITS, MOST_MASKS = 56, 600
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingle_hashes(tokens: list[bytes], words: int, digest: Callable[..., int], *seed: int, chunk: int = 1 << 16) -> Iterator[np.ndarray]:
    """Hashes of the space-joined shingles, repeats included, a chunk at a time; fewer words are one shingle."""
    if not tokens:
        return
    joined = b" ".join(tokens)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)])
    n = max(1, len(tokens) - words + 1)
    firsts, lasts = starts[:n].tolist(), (starts[len(tokens) - n + 1 :] - 1).tolist()
    for i in range(0, n, chunk):
        yield np.array([digest(joined[a:b], *seed) for a, b in zip(firsts[i : i + chunk], lasts[i : i + chunk], strict=True)], dtype="<u8")


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the shingles of ``words`` words; no words give zero, as does a null text."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(lower_words(text), words, xxhash.xxh64_intdigest, 42):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, keep: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(b.num_columns - 1).to_pylist()], dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.int64())], [*b.schema.names[:-1], "fp"])

    given = df.select(*[F.col(f"`{c}`") for c in keep if c != "fp"], F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, (kept + ", " if kept else "") + "fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray order."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the labels of the pairs; a label is the least index of its component."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def local_components(prints: np.ndarray, radius: int = RADIUS, block: int = 4096) -> np.ndarray:
    """For distinct fingerprints in Gray order the index of the first member of each one's component."""
    if len(prints) <= 4 * FANOUT:  # one node: all its pairs at once
        i, j = np.triu_indices(len(prints), 1)
        near = np.bitwise_count(prints[i] ^ prints[j]) <= radius
        return _join(np.arange(len(prints)), i[near], j[near])
    levels = [(prints, np.full(len(prints), 2**64 - 1, dtype=np.uint64))]  # value, bits that all members share
    while len(levels[-1][0]) > FANOUT:
        value, shared = levels[-1]
        cuts = np.arange(0, len(value), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(value & shared, cuts), np.bitwise_and.reduceat(~value & shared, cuts)
        levels.append((ones, ones | zeros))
    label = np.arange(len(prints))
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    todo = [(top, i, j)]
    offsets = np.arange(FANOUT)
    while todo:
        level, i, j = todo.pop()
        value, shared = levels[level]
        near = np.bitwise_count((value[i] ^ value[j]) & shared[i] & shared[j]) <= radius
        i, j = i[near], j[near]
        if level == 0:
            label = _join(label, i, j)
            continue
        # Pairs of nodes that lie in one component already have nothing to add.
        cuts = np.arange(0, len(prints), FANOUT**level)
        low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
        go = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[go], j[go]
        below = len(levels[level - 1][0])
        for k in range(0, len(i), block):
            a = (i[k : k + block, None, None] * FANOUT + offsets[:, None] + 0 * offsets).ravel()
            b = (j[k : k + block, None, None] * FANOUT + 0 * offsets[:, None] + offsets).ravel()
            fit = (a < below) & (b < below) & (a <= b if level > 1 else a < b)
            todo.append((level - 1, a[fit], b[fit]))
    return label


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of every node; rows of a node follow each other."""
    held = [np.zeros(0, dtype=np.int64)] * 3

    def search(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        prints = fp.view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])) if len(fp) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(fp)))
        out = []
        for size in range(2, 9):  # small nodes of one size, all at once
            at = new[sizes == size]
            for a in range(size):
                for b in range(a + 1, size):
                    near = np.bitwise_count(prints[at + a] ^ prints[at + b]) <= radius
                    out.append((fp[at + a][near], fp[at + b][near]))
        for start, size in zip(new[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            own = prints[start : start + size]
            own = own[np.argsort(gray_rank(own), kind="stable")]
            label = local_components(own, radius)
            linked = np.flatnonzero(label != np.arange(size))
            out.append((own[linked].view(np.int64), own[label[linked]].view(np.int64)))
        a, b = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        rows = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns, strict=True)]
        mask, key, _ = rows
        last = np.flatnonzero((mask != mask[-1]) | (key != key[-1])) if len(mask) else []
        cut = int(last[-1]) + 1 if len(last) else 0  # the last node may go on
        if cut:
            yield search(*(r[:cut] for r in rows))
        held = [r[cut:] for r in rows]
    yield search(*held)


def _parts(mask: int, radius: int) -> list[int]:
    """The mask with each of ``radius + 1`` parts of its remaining bits."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [len(rest) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in rest[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, node_limit: int = NODE_LIMIT, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that span the components of distinct fingerprints ``fp`` at ``radius`` differing bits or fewer.

    Each level of nodes is written once, with the size of its nodes; the rows of a large node meet in no task.
    """
    masks, rows, found, level = [0], prints.select(F.lit(0).cast("bigint").alias("mask"), "fp"), [], None
    while True:
        parts = {m: _parts(m, radius) for m in masks}
        split = F.create_map(*[x for m, p in parts.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in p]))])
        rows = rows.select(F.explode(split[F.col("mask")]).alias("mask"), "fp").withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        above, level = level, materialize(join_hot(rows, sizes, ["mask", "key"]), "level")
        if above is not None:
            discard(above)
        masks = [m for p in parts.values() for m in p]
        last = bin(masks[0]).count("1") >= SHARED_BITS or len(masks) >= MOST_MASKS
        large = level.where(F.col("n") > node_limit)
        last = last or large.isEmpty()
        small = level if last else level.where(F.col("n") <= node_limit)
        ordered = small.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
        found.append(materialize(ordered.mapInArrow(lambda rows: _links(rows, radius), "a bigint, b bigint"), "level-links"))
        discard(sizes)
        if last:
            discard(level)
            return reduce(DataFrame.union, found)
        rows = large.select("mask", "fp")


def near_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = RADIUS, node_limit: int = NODE_LIMIT) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id``, the least id reachable over links of ``radius`` differing bits or fewer.

    Texts without words (null and empty ones too) have fingerprint zero and link like any others; equal ids keep a row
    each; an empty table gives no rows.
    """
    given = materialize(with_fingerprints(documents.select(id_col, text_col), [id_col], text_col, words), "fingerprints")
    prints = materialize(given.groupBy("fp").agg(F.min(id_col).alias("__least"), F.count("*").alias("__rows")), "distinct")
    linked = components(near_links(prints, node_limit, radius)).withColumnRenamed("node", "fp")
    grouped = materialize(prints.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "grouped")
    least = materialize(grouped.groupBy("root").agg(F.min("__least").alias("component_id"), F.count("*").alias("n")), "least")
    classes = materialize(join_hot(grouped, least, ["root"]).select("fp", "component_id", "__rows"), "classes")
    discard(prints, grouped, least)
    return join_hot(given, classes, ["fp"], n="__rows").select(id_col, "fp", "component_id")


def near_digest(documents: DataFrame) -> DataFrame:
    return near_groups(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

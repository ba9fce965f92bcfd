"""Near copies: texts that share four fifths of their distinct shingles of five words.

Candidates meet in buckets: the nodes of the SimHash index (:mod:`gridloom.llm.simhash`), whose links alone find less
than half of such texts, and equal bands of least hashes of the shingle sets. A bucket is never gathered. Its least
member, the hub, is first compared with all others by their whole shingle sets. Members that are linked so far share a
label; as long as a bucket holds several labels, the members outside its largest label are hubs in turn, a bounded
number in a round. The other members pass by the hubs, dealt over as many tasks as a bucket needs, and only links leave
those tasks. All pairs of a bucket but those already linked through others are compared in the end, so no link of a
bucket is lost. Pairs at a likeness of just four fifths share a band with a chance of 0.999.

Equal texts are one class from the start, named by 64 bits; shingles are named by 32 bits, which changes a likeness
by less than one shingle in texts of a hundred thousand words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.scratch import discard, materialize
from gridloom.llm.simhash import NODE_LIMIT, RADIUS, fingerprint, lower_words, near_links, shingle_hashes
from gridloom.llm.skew import join_hot, only_keys

#: Near copies share at least SHARED of OF of the distinct shingles of SHINGLE words that either has.
SHINGLE, SHARED, OF = 5, 4, 5
BANDS, ROWS = 14, 4
#: Rows that one task compares with the hubs of a bucket, and its hubs in one round.
PART_ROWS, HUBS = 500, 1024
#: Hashes after which a worker hands on what it has made.
OUT_HASHES = 1_000_000
_TURNS = np.random.default_rng(5).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle."""
    found = [(part >> np.uint64(32)).astype(np.uint32) for part in shingle_hashes(lower_words(text), words, xxhash.xxh3_64_intdigest)]
    return np.unique(np.concatenate(found)) if found else np.zeros(1, dtype=np.uint32)


def bands(shingles: np.ndarray, chunk: int = 1 << 12) -> list[int]:
    """A hash of each band of least hashes of the set."""
    shingles = shingles.astype(np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), chunk):
        np.minimum(least, ((shingles[i : i + chunk, None] + np.uint64(1)) * _TURNS[0] + _TURNS[1]).min(axis=0), out=least)
    return [xxhash.xxh3_64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]


def _content(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _described(documents: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id``, ``content`` (a name of the text), ``fp`` and ``bands`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            prints = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64)
            keys = np.array([bands(shingle_set(t)) for t in texts], dtype=np.uint64).astype(np.int64).ravel()
            lists = pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints), lists], ["id", "content", "fp", "bands"])

    given = documents.select(F.col(id_col).alias("id"), _content(text_col).alias("content"), F.col(text_col))
    return given.mapInArrow(run, f"id {given.schema[0].dataType.simpleString()}, content bigint, fp bigint, bands array<bigint>")


def _buckets(classes: DataFrame, node_limit: int, radius: int) -> DataFrame:
    """``bucket``, ``content``, ``hub`` and ``n`` for the buckets of two contents or more."""
    prints = materialize(classes.groupBy("fp").agg(F.count("*").alias("n")), "distinct")
    links = near_links(prints, node_limit, radius)
    nodes = links.groupBy(F.col("a").alias("fp")).agg(F.collect_set("b").alias("others"))  # at most one for each mask
    indexed = materialize(prints.join(nodes, "fp", "left"), "indexed")
    placed = join_hot(classes.select("content", "fp", "bands"), indexed, ["fp"])
    of_index = F.transform(F.concat(F.array("fp"), F.coalesce("others", F.array().cast("array<bigint>"))), lambda x: F.xxhash64(F.lit(-1), x))
    members = placed.select("content", F.explode(F.array_distinct(F.concat(of_index, F.transform("bands", lambda x, i: F.xxhash64(i, x))))).alias("bucket"))
    members = materialize(members, "members")
    hubs = materialize(members.groupBy("bucket").agg(F.min("content").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    out = materialize(join_hot(members, hubs, ["bucket"]), "buckets")
    discard(prints, indexed, members, hubs)
    return out


def _sets(documents: DataFrame, text_col: str, involved: DataFrame) -> DataFrame:
    """``content`` and ``shingles`` of each content of ``involved``."""

    def made(keys: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(s) for s in sets]
        lists = pa.ListArray.from_arrays(np.cumsum([0, *sizes], dtype=np.int32), pa.array(np.concatenate(sets).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["content", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found, size = [], [], 0
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(key)
                found.append(shingle_set(text))
                size += len(found[-1])
                if size > OUT_HASHES:
                    yield made(keys, found)
                    keys, found, size = [], [], 0
            if keys:
                yield made(keys, found)

    texts = documents.select(_content(text_col).alias("content"), F.col(text_col).cast("string").alias("text"))
    one = only_keys(texts, involved, ["content"]).groupBy("content").agg(F.first("text").alias("text"))  # copies go before the shuffle
    return materialize(one.mapInArrow(run, "content bigint, shingles array<int>"), "sets")


def near_pairs(hubs: list[np.ndarray], members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hubs and of the members that are near copies of each other."""
    if len(hubs) * len(members) == 1:
        n, both = len(hubs[0]) + len(members[0]), len(np.intersect1d(hubs[0], members[0], assume_unique=True))
        found = np.zeros(int(OF * both >= SHARED * (n - both)), dtype=np.int64)
        return found, found
    sizes = np.array([len(s) for s in members], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    names, rest = np.unique(np.concatenate(members), return_inverse=True)
    out = []
    for hub in hubs:
        mark = np.zeros(len(names), dtype=np.int64)
        at = np.minimum(np.searchsorted(names, hub), len(names) - 1)
        mark[at[names[at] == hub]] = 1
        common = np.add.reduceat(mark[rest], starts)
        out.append(np.flatnonzero(OF * common >= SHARED * (sizes + len(hub) - common)))
    return np.repeat(np.arange(len(hubs)), [len(x) for x in out]), np.concatenate(out)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows ``bucket``, ``part``, ``hub``, ``content``, ``shingles``, sorted so that hubs come first."""
    bucket, held = None, ([], [])  # the hubs of the bucket at hand: contents and sets
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(0)), np.asarray(b.column(1)).astype(np.int64)], axis=1)
        is_hub, content = np.asarray(b.column(2)), np.asarray(b.column(3))
        offsets, values = np.asarray(b.column(4).offsets), np.asarray(b.column(4).values)
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]]).tolist()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if bucket != (now := tuple(key[start].tolist())):
                bucket, held = now, ([], [])
            own = [values[offsets[i] : offsets[i + 1]] for i in range(start, stop)]
            n_hubs = int(is_hub[start:stop].sum())
            held[0].extend(content[start : start + n_hubs].tolist())
            held[1].extend(own[:n_hubs])
            if held[0] and n_hubs < len(own):
                i, j = near_pairs(held[1], own[n_hubs:])
                left.append(content[start + n_hubs : stop][j])
                right.append(np.array(held[0], dtype=np.int64)[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def _verified(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` of near copies between the ``hub`` rows and the others of each ``bucket`` and ``part``."""
    # Sets join by shuffle at every size, so that the costs of a small run are those of a large one.
    joined = rows.join(sets.hint("merge"), "content").select("bucket", "part", "hub", "content", "shingles")
    ordered = joined.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("hub"))
    return materialize(ordered.mapInArrow(_compare, "a bigint, b bigint").where("a <> b").distinct(), "near")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows ``bucket``, ``content``, ``n``, ``hub`` with ``part``: hubs are in all parts of their bucket."""
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    of_row = F.array(F.pmod(F.xxhash64("content"), parts).cast("int"))
    # A hub is compared with the other hubs too: it passes by as a member of its own part.
    placed = rows.select("bucket", "content", "hub", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0), parts - 1)).otherwise(of_row)).alias("part"))
    return placed.unionByName(rows.where("hub").select("bucket", "content", F.lit(False).alias("hub"), F.explode(of_row).alias("part")))


def _linked(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the contents that have a near copy, over the links of all buckets."""
    # First round: each hub with all that it is the hub of, once however many buckets they share.
    pairs = materialize(members.where("content <> hub").select("content", F.col("hub").alias("bucket")).distinct(), "pairs")
    counts = materialize(pairs.groupBy("bucket").agg(F.count("*").alias("n")), "pair-counts")
    stars = join_hot(pairs, counts, ["bucket"]).withColumn("hub", F.lit(False))
    hubs = counts.select("bucket", F.col("bucket").alias("content"), "n", F.lit(True).alias("hub"))
    links = _verified(_dealt(stars.unionByName(hubs)), sets)
    labels = materialize(components(links), "labels")
    rest = members.where("content <> hub").select("bucket", "content")
    while True:
        labelled = rest.join(labels, rest["content"] == labels["node"], "left").select("bucket", "content", F.coalesce("root", "content").alias("label"))
        labelled = materialize(labelled, "labelled")
        by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"))
        mixed = by_label.groupBy("bucket").agg(F.max_by("label", "c").alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
        mixed = materialize(mixed, "mixed")
        if mixed.isEmpty():
            discard(labelled, mixed, pairs, counts)
            return labels
        turn = (F.col("label") != F.col("main")) & (F.pmod(F.xxhash64("content", "bucket"), F.col("others")) < HUBS)
        rows = materialize(join_hot(labelled, mixed, ["bucket"]).withColumn("hub", turn), "open")
        links = links.union(_verified(_dealt(rows), sets))
        labels = materialize(components(links), "labels")
        rest = rows.where("not hub").select("bucket", "content")
        discard(labelled, mixed)


def near_classes(documents: DataFrame, id_col: str, text_col: str, words: int = 3, radius: int = RADIUS, node_limit: int = NODE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The documents (``id``, ``content``, ``fp``), and ``content``, ``n`` and ``component_id`` of each content.

    ``component_id`` is the least id of the group of near copies. Texts without words are near copies of each other,
    null and empty ones too; a text of fewer than five words has those of the same words. Null ids count last.
    """
    given = materialize(_described(documents, id_col, text_col, words), "described")
    classes = given.groupBy("content").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes = materialize(classes, "contents")
    members = _buckets(classes, node_limit, radius)
    involved = materialize(members.select("content").distinct(), "involved")
    sets = _sets(documents, text_col, involved)
    labels = _linked(members, sets)
    labelled = materialize(classes.select("content", "least", "n").join(labels, F.col("content") == F.col("node"), "left").withColumn("root", F.coalesce("root", "content")).drop("node"), "labelled")
    roots = materialize(labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "roots")
    out = materialize(join_hot(labelled, roots, ["root"], n="members").select("content", "n", "component_id"), "classes")
    discard(classes, members, involved, sets, labels, labelled, roots)
    return given.select("id", "content", "fp"), out


def near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` of every document; see :func:`near_classes`."""
    given, classes = near_classes(documents, id_col, text_col)
    return join_hot(given, classes, ["content"]).select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """The document of least id of each group of near copies; of rows that repeat that id, all stay.

    Documents without an id count as repeating one: if one of them is the least of its group, all of them stay.
    """
    _, classes = near_classes(documents, "doc_id", "text")
    kept = classes.select(F.col("component_id").alias("__kept")).distinct()
    found = documents.join(kept.hint("merge"), documents["doc_id"] == F.col("__kept"), "left_semi")
    if kept.where(F.col("__kept").isNull()).isEmpty():
        return found
    return found.unionByName(documents.where(F.col("doc_id").isNull()))

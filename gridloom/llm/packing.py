"""Packing token sequences by cutting-stock column generation.

A document is cut into pieces of the sequence length and a remainder. Piece lengths are counted in classes of
``QUANTUM`` tokens; the driver sees that histogram only, at most ``SEQUENCE / QUANTUM`` numbers however many documents
there are. A linear program over packing patterns is solved by column generation: an unbounded knapsack by dynamic
programming prices new patterns with the dual values. Patterns are rounded down; what is left over goes into bins by
first fit. Pieces are then ranked within their class and the ranks dealt to the patterns.

Ranks come from counts of sub-buckets, so a length that a third of all pieces share doesn't meet in one task.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import materialize

SEQUENCE, QUANTUM, END_ID = 1024, 4, 0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}


def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The worker's tokenizer; the added tokens of the vocabulary's JSON file, beside the rank file, are found in text."""
    key = (rank_file, pattern)
    if key not in _ENCODINGS:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(f"{os.path.splitext(rank_file)[0]}.json", "rb") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _ENCODINGS[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODINGS[key]


def cut_pieces(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Pieces of every whole text; a null text is empty and consists of the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(np.asarray(enc.encode_to_numpy(text or "", allowed_special="all"), dtype="<u4"), np.uint32(END_ID)).astype("<u4")
                n, raw = len(ids), ids.tobytes()
                for start in range(0, n, SEQUENCE):
                    stop = min(n, start + SEQUENCE)
                    rows.append((doc_id, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def _best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits: unbounded knapsack over the capacities up to ``room``.

    ``sizes`` descend, so that of equal gains the larger piece is taken.
    """
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    first = len(sizes) - np.searchsorted(sizes[::-1], np.arange(room + 1), side="right")
    for space in range(int(sizes[-1]), room + 1):
        k = int(first[space])
        gains = values[k:] + best[space - sizes[k:]]
        k += int(gains.argmax())
        best[space], took[space] = values[k] + best[space - sizes[k]], k
    pattern, space = np.zeros(len(sizes), dtype=np.int64), room
    while space > 0 and took[space] >= 0:
        pattern[took[space]] += 1
        space -= int(sizes[took[space]])
    return float(best[room]), pattern


def _greedy_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: fill a sequence with the largest sizes left, repeat it until one of its sizes is used up.

    As every pattern uses up one size for good, the patterns are independent and their amounts meet the demand.
    """
    left, alive = demand.astype(float).copy(), np.ones(len(sizes), dtype=bool)
    patterns, amounts = [], []
    while alive.any():
        space, pattern = room, np.zeros(len(sizes))
        for k in np.flatnonzero(alive).tolist():
            each = min(space // int(sizes[k]), max(1, int(left[k])))
            pattern[k] = each
            space -= each * int(sizes[k])
        used = pattern > 0
        ratio = np.where(used, left / np.where(used, pattern, 1), np.inf)
        out = int(ratio.argmin())
        patterns.append(pattern)
        amounts.append(ratio[out])
        left = np.maximum(left - ratio[out] * pattern, 0)
        alive[out] = False
    return np.array(patterns).T, np.array(amounts)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination, row by row: threads of a linear algebra library wait long on a busy driver."""
    m = len(matrix)
    work = np.concatenate([matrix, np.eye(m)], axis=1)
    for k in range(m):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        column = work[:, k].copy()
        column[k] = 0
        work -= column[:, None] * work[k]
    return work[:, m:]


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, within ``gap`` of the linear program's optimum.

    ``sizes`` descend. Prices are smoothed towards the best dual solution so far, at first a price in proportion to
    size, and demands are disturbed a little against degenerate steps. A negative price brings in a surplus column.
    """
    m = len(sizes)
    disturbed = demand * (1 + 1e-4 * np.random.default_rng(1).random(m))
    patterns, amount = _greedy_patterns(sizes, disturbed, room)
    inverse, cost = _inverse(patterns), np.ones(m)
    centre, bound, fresh = sizes / room, float(disturbed @ sizes) / room, True
    for step in range(rounds):
        if cost @ amount - bound <= gap * bound:
            break
        prices = (cost[:, None] * inverse).sum(axis=0)
        pattern, price = np.zeros(m, dtype=np.int64), 1.0
        if prices.min() < -1e-9:
            pattern[prices.argmin()], price = -1, 0.0
        else:
            for smooth in (0.9, 0.5, 0.0):
                tried = smooth * centre + (1 - smooth) * prices
                value, pattern = _best_pattern(tried, sizes, room)
                below = float(disturbed @ tried) / max(1.0, value)
                if below > bound:
                    centre, bound = tried / max(1.0, value), below
                if prices @ pattern > 1 + 1e-7:
                    break
            else:
                if fresh:
                    break  # no pattern improves on these
                pattern = None
        if pattern is not None:
            direction = np.einsum("ij,j->i", inverse, pattern.astype(float))
            up = direction > 1e-9
            ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
            out = int(ratio.argmin())
            theta = ratio[out]
            amount = np.maximum(amount - theta * direction, 0)
            amount[out], cost[out], patterns[:, out] = theta, price, pattern
            inverse[out] /= direction[out]
            rest = direction.copy()
            rest[out] = 0
            inverse -= rest[:, None] * inverse[out]
        fresh = pattern is None or step % 500 == 499
        if fresh:  # rounding errors
            inverse = _inverse(patterns)
            amount = np.maximum(np.einsum("ij,j->i", inverse, disturbed), 0)
    real = cost > 0
    return patterns.T[real].astype(np.int64), amount[real]


def pack_histogram(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: how many} and how many sequences follow each; every piece of the histogram is in one."""
    sizes = np.array(sorted((s for s, n in histogram.items() if n > 0), reverse=True), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    out: list[tuple[dict[int, int], int]] = []
    patterns, amounts = solve_patterns(sizes, left.astype(float), room)
    for pattern, amount in zip(patterns, np.floor(amounts + 1e-7).astype(np.int64).tolist(), strict=True):
        used = pattern > 0
        amount = min([amount, *(left[used] // pattern[used]).tolist()])
        if amount > 0:
            left -= amount * pattern
            out.append(({int(s): int(a) for s, a in zip(sizes[used], pattern[used], strict=True)}, amount))
    bins: list[tuple[int, dict[int, int]]] = []  # what is left: a few pieces for each pattern
    for size, n in zip(sizes.tolist(), left.tolist(), strict=True):
        for _ in range(n):
            at = min((i for i, (space, _) in enumerate(bins) if space >= size), key=lambda i: bins[i][0], default=None)
            if at is None:
                bins.append((room, {}))
                at = len(bins) - 1
            space, content = bins[at]
            content[size] = content.get(size, 0) + 1
            bins[at] = (space - size, content)
    return out + [(content, 1) for _, content in bins]


def _deals(packed: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each size, in order of rank: first rank, ranks past it, pieces per sequence, first sequence."""
    deals: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, copies in packed:
        for size, each in pattern.items():
            first = used.get(size, 0)
            used[size] = first + each * copies
            deals.setdefault(size, []).append((first, used[size], each, sequence))
        sequence += copies
    return deals


def assign(pieces: DataFrame, sub_buckets: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; reads ``pieces`` more than once, so give a written table."""
    spark = pieces.sparkSession
    if sub_buckets is None:
        sub_buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumns({
        "__size": F.ceil(F.col("length") / QUANTUM).cast("int"),
        "__sub": F.pmod(F.xxhash64("doc_id", "start", F.lit(1)), F.lit(sub_buckets)).cast("int"),
    })
    counts = materialize(keyed.groupBy("__size", "__sub").count(), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("__size").agg(F.sum("count")).collect()}
    deals = _deals(pack_histogram(histogram, SEQUENCE // QUANTUM))
    deal_rows = spark.createDataFrame([(s, x) for s, x in deals.items()], "__at int, __deals array<struct<first:bigint,past:bigint,each:bigint,sequence:bigint>>")
    before = F.sum("count").over(Window.partitionBy("__size").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__size", "__sub", F.coalesce(before, F.lit(0)).alias("__before"))

    order = Window.partitionBy("__size", "__sub").orderBy(F.xxhash64("doc_id", "start", F.lit(2)), "doc_id", "start", "ids_crc32")
    rank = F.col("__before") + F.row_number().over(order) - 1
    deal = F.filter("__deals", lambda d: (d["first"] <= F.col("__rank")) & (F.col("__rank") < d["past"]))[0]
    dealt = (
        keyed.join(offsets, ["__size", "__sub"])
        .withColumn("__rank", rank)
        .join(F.broadcast(deal_rows), F.col("__size") == F.col("__at"))  # a row for each of at most 256 sizes
        .withColumn("__deal", deal)
        .withColumn("sequence_id", (F.col("__deal.sequence") + F.expr("(__rank - __deal.first) div __deal.each")).cast("bigint"))
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("bigint")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Every id of every document in one piece of one sequence; an empty table has no pieces."""
    return assign(materialize(cut_pieces(documents, rank_file, pattern), "pieces"))

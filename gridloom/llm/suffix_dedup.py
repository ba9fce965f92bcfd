"""Exact substring deduplication over bytes, by distributed prefix doubling on the positions that can repeat.

Naming every byte position by sorted rank pairs would shuffle some thirty bytes for each byte of text and round, so
positions enter the rounds only where a repeat is possible:

1. Every window of ``LENGTH`` bytes has an anchor, its least hashed gram of ``GRAM`` bytes (the leftmost of equals).
   Consecutive windows of one anchor form a span. Equal windows have equal grams at equal offsets, so a window can
   repeat only if its anchor's gram does. Ranking grams drops the positions whose gram is unique.
2. Spans of equal content repeat whole. One of each content goes on, with its number, if others share its gram.
3. Rounds rank runs of window positions by pairs of names: the name of what all windows of the run share and the name
   of what they cover together. A shared part that is unique makes the whole run unique; a covered part that repeats
   makes the whole run a repeat; otherwise the run is split into single positions.
4. Single positions in doubt are ranked by prefix doubling: their first ranks are of the next 50 bytes; each round pairs
   the rank of a position with the rank one offset further on (50, 100, 200 bytes), sorts the pairs and numbers the
   distinct ones, which gives the ranks of twice the length. A position whose pair no other one in doubt has is unique
   and leaves; one whose pair at the threshold is not its own is a repeat. Ranks at offsets that a position in doubt
   needs later are carried along.

Rows of a hot gram, content or pair are counted first and joined where they are, so they meet in no task. Names of the
first three steps are digests of the bytes themselves, 128 bits in all (gram and content, core and cover, or the two
first ranks). Matches never cross documents. A null text is empty. Texts shorter than the threshold lose nothing. Rows
that repeat an id are documents of their own (equal rows are copies). A document is named by 76 bits of its id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import discard, materialize, release
from gridloom.llm.skew import join_hot

LENGTH, GRAM, RUN = 400, 32, 16
#: Offsets at which ranks are paired; twice the last one is the threshold.
OFFSETS = (LENGTH // 8, LENGTH // 4, LENGTH // 2)
#: Bits of a place: the document's check, the first window, and twice ten for anchor and last window.
CHECK_BITS, LO_BITS = 12, 31
#: Bytes of text whose grams are hashed at a time, and bits that hold a place in them.
CHUNK, PLACE_BITS = 2_000_000, 27
#: Rows after which a worker hands on what it has made.
OUT_ROWS = 50_000
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
_SEED = np.random.default_rng(20240)
_BYTE_HASH = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = [np.uint64(int(x) | 1) for x in _SEED.integers(2**62, 2**63, 16)]


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    out, size, k = _BYTE_HASH[np.frombuffer(data, dtype=np.uint8)], 1, 0
    while size < gram:
        out = out[:-size] * _FACTORS[k] + out[size:]
        size, k = 2 * size, k + 1
    return out


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, leftmost of equals."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    keys = (mixed & ~_PLACE) | np.arange(len(mixed), dtype=np.uint64)
    n = len(keys) - width + 1
    rows = np.concatenate([keys, np.full((-len(keys)) % width + width, 2**64 - 1, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Runs of whole texts, or of overlapping parts of long ones: row, place in the row, bytes, ends in the bytes."""
    rows, starts, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), CHUNK):
            part = text[start : start + CHUNK + length - 1]
            if len(part) < length:
                continue
            rows.append(row)
            starts.append(start)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.array(rows), np.array(starts), b"".join(parts), np.cumsum([len(p) for p in parts])
                rows, starts, parts, size = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(starts), b"".join(parts), np.cumsum([len(p) for p in parts])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def pack_place(check: np.ndarray, lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The document's check and the first window, anchor and last window of a span in one long."""
    return check << (LO_BITS + 20) | lo << 20 | (at - lo) << 10 | (hi - lo)


def _first_window(place: int) -> int:
    return place >> 20 & ((1 << LO_BITS) - 1)


def find_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans of each text: its key ``k``, the packed ``place``, the anchor's ``gram`` and a name of the content.

    ``texts`` has ``k``, ``check`` and ``data`` (bytes). The name is seeded with the anchor's place in the span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            k, check = np.asarray(b.column(0)), np.asarray(b.column(1))
            for rows, starts, data, ends in _pieces([x or b"" for x in b.column(2).to_pylist()], length):
                grams = gram_hashes(data, gram)
                at = least_places(grams, length - gram + 1)
                part = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
                windows = np.flatnonzero(part[: len(at)] == part[length - 1 :])
                at, owner = at[windows], part[windows]
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
                lo, hi = windows[new], windows[np.append(new[1:], len(windows)) - 1]
                at, owner = at[new], owner[new]
                view = memoryview(data)
                names = [digest(view[x : z + length], y - x) for x, y, z in zip(lo.tolist(), at.tolist(), hi.tolist(), strict=True)]
                shift = starts[owner] - (ends - np.diff(ends, prepend=0))[owner]
                place = pack_place(check[rows[owner]], lo + shift, at + shift, hi + shift)
                yield pa.RecordBatch.from_arrays([pa.array(k[rows[owner]]), pa.array(place), pa.array(grams[at].view(np.int64)), _signed(names)], ["k", "place", "gram", "s"])

    return texts.select("k", "check", "data").mapInArrow(run, "k bigint, place bigint, gram bigint, s bigint")


def _batch(columns: list, names: list[str], binary: str = "") -> pa.RecordBatch:
    columns = list(columns) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) if n == binary else _signed(c) if n in ("ck", "cover", "w1", "w2") else pa.array(c, pa.int64()) for c, n in zip(columns, names, strict=True)], names)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for k, data, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for s in spans:
                lo, width = _first_window(s["place"]), s["place"] & 1023
                rows.append((k, s["place"], s["gram"], s["n"], data[lo : lo + width + LENGTH]))
            if len(rows) >= OUT_ROWS:
                yield _batch(zip(*rows, strict=True), ["k", "place", "gram", "n", "bytes"], "bytes")
                rows = []
        yield _batch(zip(*rows, strict=True), ["k", "place", "gram", "n", "bytes"], "bytes")


def _name_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``RUN`` offsets of each span: names of what their windows share and of what they cover together."""
    digest = xxhash.xxh3_64_intdigest
    for b in batches:
        rows = []
        for k, place, gram, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, width = place >> 10 & 1023, place & 1023  # both from the span's first window
            # A window that starts at w has offset at - w; the span's offsets run from at - width to at.
            for run in range((at - width) // RUN, at // RUN + 1):
                first, last = max(run * RUN, at - width), min(run * RUN + RUN - 1, at)
                core = digest(data[at - run * RUN : at - run * RUN - RUN + 1 + LENGTH], (gram ^ run) & (2**64 - 1))
                cover = digest(data[at - last : at - first + LENGTH], first << 16 | last)
                rows.append((k, place, n, first << 16 | last, core, cover))
            if len(rows) >= OUT_ROWS:
                yield _batch(zip(*rows, strict=True), ["k", "place", "n", "offsets", "ck", "cover"])
                rows = []
        yield _batch(zip(*rows, strict=True), ["k", "place", "n", "offsets", "ck", "cover"])


PAIRS = ["w1", "w2", "k", "place", "mark"]  # mark: position in the span, in doubt, stands for several


def _first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of digests at the first offset, for each position in doubt and those whose ranks it needs later."""
    digest, half = xxhash.xxh3_64_intdigest, OFFSETS[0]
    for b in batches:
        rows = []
        for k, place, data, runs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, flags, named = place >> 10 & 1023, {}, {}
            for r in runs:
                for offset in range(r["offsets"] >> 16, (r["offsets"] & 65535) + 1):
                    flags[at - offset] = 2 | (r["weight"] > 1)
            for start in list(flags):
                for x in range(start + 2 * half, start + LENGTH, 2 * half):
                    flags.setdefault(x, 0)
            for x, flag in flags.items():
                for y in (x, x + half):
                    if y not in named:
                        named[y] = digest(data[y : y + half])
                rows.append((named[x], named[x + half], k, place, x << 2 | flag))
            if len(rows) >= OUT_ROWS:
                yield _batch(zip(*rows, strict=True), PAIRS)
                rows = []
        yield _batch(zip(*rows, strict=True), PAIRS)


def _pair_ranks(half: int):
    """Pairs of ranks ``half`` apart, from rows ``k``, ``place``, ``mark``, ``rank`` sorted by span and position."""

    def pairs(k: np.ndarray, place: np.ndarray, mark: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        span = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (place[1:] != place[:-1])])[: len(k)])
        key = span << 12 | mark >> 2
        doubt = key[mark & 2 > 0]
        wanted = np.unique(np.concatenate([doubt + x for x in range(0, LENGTH, 2 * half)]))
        i, j = np.searchsorted(key, wanted), np.searchsorted(key, wanted + half)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rank[i], rank[j], k[i], place[i], mark[i])], PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 4
        for b in batches:
            rows = [np.concatenate([h, np.asarray(c)]) for h, c in zip(held, b.columns, strict=True)]
            k, place = rows[:2]
            other = np.flatnonzero((k != k[-1]) | (place != place[-1])) if len(k) else []
            cut = int(other[-1]) + 1 if len(other) else 0  # the last span may go on
            if cut:
                yield pairs(*(r[:cut] for r in rows))
            held = [r[cut:] for r in rows]
        yield pairs(*held)

    return run


def repeated_starts(texts: DataFrame) -> DataFrame:
    """``k``, ``check`` and ``cuts``, the runs ``first`` to ``last`` of starts of windows that start elsewhere too.

    Each step is a written table, so that the shuffle files of one can go before the next; all but the last are
    deleted.
    """
    spark = texts.sparkSession
    made: list[DataFrame] = []

    def step(df: DataFrame, name: str) -> DataFrame:
        made.append(materialize(df, name))
        release(spark)
        return made[-1]

    one = lambda *names: [F.first(c).alias(c) for c in names]
    spans = step(find_spans(texts), "spans")
    contents = step(spans.groupBy("gram", "s").agg(F.count("*").alias("n"), *one("k", "place")), "contents")
    check, lo = F.shiftright("place", LO_BITS + 20).alias("check"), F.shiftright("place", 20).bitwiseAND(F.lit((1 << LO_BITS) - 1))
    whole = join_hot(spans, contents.where("n > 1").select("gram", "s", "n"), ["gram", "s"], "left_semi")
    whole = step(whole.select("k", check, lo.alias("first"), (lo + F.col("place").bitwiseAND(F.lit(1023))).alias("last")), "whole")

    mixed = step(contents.groupBy("gram").agg(F.count("*").alias("u")).where("u > 1"), "mixed")
    chosen = join_hot(contents, mixed, ["gram"], "left_semi", n="u")
    discard(spans)
    per_text = step(chosen.groupBy("k", check).agg(F.collect_list(F.struct("place", "gram", "n")).alias("spans")), "chosen")  # spans of one text
    bytes_of = step(texts.join(per_text, ["k", "check"]).select("k", "data", "spans").mapInArrow(_cut_out, "k bigint, place bigint, gram bigint, n bigint, bytes binary"), "span-bytes")
    discard(contents, mixed, per_text)

    runs = step(bytes_of.mapInArrow(_name_runs, "k bigint, place bigint, n bigint, offsets bigint, ck bigint, cover bigint"), "runs")
    covers = step(runs.groupBy("ck", "cover").agg(F.sum("n").alias("weight"), F.count("*").alias("rows"), *one("k", "place", "offsets")), "covers")
    anchor = lo + F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    repeated = join_hot(runs.where("n = 1"), covers.where("weight > 1").select("ck", "cover", "rows"), ["ck", "cover"], "left_semi", n="rows")
    repeated = repeated.select("k", check, (anchor - F.col("offsets").bitwiseAND(F.lit(65535))).alias("first"), (anchor - F.shiftright("offsets", 16)).alias("last"))
    repeated = step(repeated, "repeated-runs")
    discard(runs)

    open_cores = step(covers.groupBy("ck").agg(F.count("*").alias("u"), F.min("weight").alias("least")).where("u > 1 and least = 1").select("ck", "u"), "open-cores")
    doubt = join_hot(covers, open_cores, ["ck"], "left_semi", n="u")
    per_span = doubt.groupBy("k", "place").agg(F.collect_list(F.struct("offsets", "weight")).alias("runs"))  # runs of one span
    named = per_span.join(bytes_of.select("k", "place", "bytes"), ["k", "place"]).select("k", "place", "bytes", "runs")
    pairs = step(named.mapInArrow(_first_ranks, ", ".join(f"{c} bigint" for c in PAIRS)), "pairs")
    discard(covers, open_cores, bytes_of)
    in_doubt = F.col("mark").bitwiseAND(F.lit(2)) > 0
    for half in OFFSETS:
        # Equal pairs get one rank: the pairs are counted, sorted and numbered. Positions whose pair is their own leave.
        several = F.when(in_doubt, 1 + F.col("mark").bitwiseAND(F.lit(1))).otherwise(0)
        counted = pairs.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.sum(several).alias("weight"))
        ranks = step(counted.sortWithinPartitions("w1", "w2").withColumn("rank", F.monotonically_increasing_id()), "ranks")
        ranked = join_hot(pairs, ranks, ["w1", "w2"])
        if 2 * half == LENGTH:
            doubt = step(ranked.where(in_doubt & (F.col("weight") > 1)).select("k", "place", "mark"), "repeated-positions")
            discard(pairs, ranks)
            break
        mark = F.when(in_doubt & (F.col("weight") > 1), F.col("mark")).otherwise(F.col("mark").bitwiseAND(F.lit(-4)))
        by_span = ranked.select("k", "place", mark.alias("mark"), "rank").repartition("k", "place").sortWithinPartitions("k", "place", "mark")
        before, pairs = pairs, step(by_span.mapInArrow(_pair_ranks(2 * half), ", ".join(f"{c} bigint" for c in PAIRS)), "pairs")
        discard(before, ranks)
    start = lo + F.shiftright("mark", 2)
    settled = doubt.where("mark & 1 = 0").select("k", check, start.alias("first"), start.alias("last"))
    found = whole.unionByName(repeated).unionByName(settled)
    cuts = step(found.groupBy("k", "check").agg(F.collect_list(F.struct("first", "last")).alias("cuts")), "cuts")  # ranges of one text
    discard(*made[:-1])
    return cuts


def merge_windows(firsts: list[int], lasts: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows starting in the given ranges cover."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(firsts, lasts, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z + length))
        else:
            out.append((a, z + length))
    return out


def removals(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id ``d`` and ``data`` of each text and the window ranges ``cuts`` that repeat (null if none)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = documents.select(F.col(id_col).cast("bigint").alias("d"), F.xxhash64(id_col, text).alias("k"), F.pmod(F.xxhash64(text, F.lit(1), id_col), F.lit(1 << CHECK_BITS)).alias("check"), text.cast("binary").alias("data"))
    cuts = repeated_starts(texts.where(F.length("data") >= LENGTH))
    return texts.join(cuts, ["k", "check"], "left").select("d", "data", "cuts")


def dedup_digest(documents: DataFrame) -> DataFrame:
    """Per document its bytes, the bytes and runs removed, and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, removed, n_spans, sha = [], [], [], []
            for data, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out = merge_windows([c["first"] for c in cuts or []], [c["last"] for c in cuts or []])
                digest, at = hashlib.sha256(), 0
                for a, z in out:
                    digest.update(data[at:a])
                    at = z
                digest.update(data[at:])
                n_bytes.append(len(data))
                removed.append(sum(z - a for a, z in out))
                n_spans.append(len(out))
                sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n_bytes, removed, n_spans)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removals(documents).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

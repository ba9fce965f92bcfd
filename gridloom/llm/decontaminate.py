"""Benchmark decontamination by winnowing: which words of documents lie in passages of a test set.

Words are runs of ASCII letters (upper case as lower), ASCII digits and all characters beyond ASCII. A window is
``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window. For windows of m words both
sides hash every run of k = (m + 1) // 2 words and keep, from each m words in a row, the least hash. Equal passages of m
words keep the same one, so joining what is kept finds every shared window. A hit is extended to the windows that kept
it, and those are compared word by word with the item's, so the result is exact.

Kept hashes of a test set of bounded size (counted first) are broadcast, and every document is finished where it is
read. Those of a larger one are joined by shuffle: texts are named by their SHA-256, so copies are searched once, and
hashes, windows or texts that many rows share are joined by ``join_hot``.

A null or empty text, or one without words, has no words and no hit. An item without words has no window. Items of equal
id are one item; a null id counts as an item. Repeated rows give repeated rows. Empty tables on either side are fine.
Extra columns are carried along and never read; of the result only the column named for it may replace one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.llm.scratch import materialize
from gridloom.llm.skew import join_hot
from gridloom.llm.words import Words, chunks

WINDOW = 10
#: A test set is broadcast up to so many pairs of window and item, and so many bytes of windows; beyond it is shuffled.
BROADCAST_PAIRS, BROADCAST_BYTES = 500_000, 32 << 20
def winnowed(words: Words, m: int, low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, from ``low`` to ``high``, of the windows of ``m`` words inside a text, which run each keeps, and the
    hashes of the runs from ``low`` on."""
    k = (m + 1) // 2
    high = len(words.hashes) - m + 1 if high is None else min(high, len(words.hashes) - m + 1)
    if high <= low:
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),)
    grams = words.runs(low, high + m - k, k)
    least, place, size = grams, np.arange(len(grams)), 1
    while size < m - k + 1:  # the least of twice as many runs, the leftmost of equals
        step = min(size, m - k + 1 - size)
        right = least[step:] < least[:-step]
        least, place, size = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step]), size + step
    whole = np.flatnonzero(words.last[low:high] - np.arange(low, high) >= m)
    return whole + low, place[whole], grams


class Members:
    """A set of hashes, looked up in a table of their upper bits first."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        bits = min(24, max(10, len(self.hashes).bit_length() + 4))
        self.shift, self.upper = np.uint64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.upper[(self.hashes >> self.shift).astype(np.int64)] = True

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = self.upper[(x >> self.shift).astype(np.int64)]
        if len(maybe := np.flatnonzero(out)):
            at = np.minimum(np.searchsorted(self.hashes, x[maybe]), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] == x[maybe]
        return out


class Index:
    """The windows of a test set of bounded size: kept runs and whole windows by their length, and the items of each."""

    def __init__(self, rows: list[tuple[str, int, int, int, list[str | None]]]):
        self.items = {window.encode(): items for window, _, _, _, items in rows}
        of = lambda k, m: Members(np.array([r[k] for r in rows if r[1] == m], dtype=np.int64).view(np.uint64))
        self.kept = {m: (of(2, m), of(3, m)) for m in sorted({r[1] for r in rows})}

    def occurrences(self, words: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """Start, words and items of every window that occurs: hits of kept runs, extended, then compared as texts."""
        for m, (grams, wholes) in self.kept.items():
            for start in _candidates(words, m, grams):
                at = start[wholes.holds(words.runs_at(start, m))]
                for i in at.tolist():
                    if (items := self.items.get(words.text(i, m))) is not None:
                        yield i, m, items


def _candidates(words: Words, m: int, grams: Members) -> Iterator[np.ndarray]:
    """Starts of the windows of ``m`` words whose kept run is among ``grams``."""
    for low, high in words.segments():
        starts, kept, hashes = winnowed(words, m, low, high)
        if len(starts):
            once = kept[np.flatnonzero(np.diff(kept, prepend=-1))]  # kept runs never go back
            hit = np.zeros(len(hashes), dtype=bool)
            hit[once[grams.holds(hashes[once])]] = True
            if hit.any():
                yield starts[hit[kept]]


def merged(windows: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Maximal runs of words under windows of (start, words)."""
    out: list[dict[str, int]] = []
    for start, n in sorted(windows):
        if out and start <= out[-1]["first"] + out[-1]["words"]:
            out[-1]["words"] = max(out[-1]["words"], start + n - out[-1]["first"])
        else:
            out.append({"first": start, "words": n})
    return out


SPANS = "array<struct<first:bigint,words:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
FOUND = f"struct<n_words:bigint,n_hit:bigint,spans:{SPANS},items:array<string>>"


def _result(n_words: int, windows: list[tuple[int, int]], items: set[str | None]) -> dict:
    spans = merged(windows)
    return {"n_words": n_words, "n_hit": sum(s["words"] for s in spans), "spans": spans, "items": sorted(items, key=lambda x: (x is not None, x or ""))}


def _search(words: Words, index: Index) -> list[dict]:
    """What is found in each text."""
    hits: dict[int, tuple[list, set]] = {}
    for start, m, items in index.occurrences(words):
        i = int(np.searchsorted(words.firsts, start, side="right")) - 1
        windows, of = hits.setdefault(i, ([], set()))
        windows.append((start - int(words.firsts[i]), m))
        of.update(items)
    return [_result(n, *hits.get(i, ([], set()))) for i, n in enumerate(np.diff(words.firsts).tolist())]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct ``item, window, m, gram, whole``: an item's windows of ``m`` words, the run each keeps, its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = Words(b.column(1).slice(i, 1))
                if m := min(window, len(words.hashes)):
                    starts, kept, grams = winnowed(words, m)
                    texts = pa.array([words.text(s, m) for s in starts.tolist()], pa.binary()).cast(pa.string())
                    ids = pa.array([b.column(0)[i].as_py()] * len(starts), pa.string())
                    yield pa.RecordBatch.from_arrays([ids, texts, pa.array(np.full(len(starts), m, dtype=np.int32)), pa.array(grams[kept].view(np.int64)), pa.array(words.runs_at(starts, m).view(np.int64))], ["item", "window", "m", "gram", "whole"])

    given = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, "item string, window string, m int, gram bigint, whole bigint").distinct()


def _row(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c != name]).alias("row")


def _by_broadcast(documents: DataFrame, windows: DataFrame, text_col: str, name: str) -> DataFrame:
    rows = windows.groupBy("window").agg(F.first("m"), F.first("gram"), F.first("whole"), F.collect_set(F.struct("item"))).collect()  # bounded: counted before
    index = documents.sparkSession.sparkContext.broadcast(Index([(w, m, g, h, [i["item"] for i in items]) for w, m, g, h, items in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for words in chunks(b.column(1)) for x in _search(words, index.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND)], ["row", "found"])

    given = documents.select(_row(documents, name), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, StructType([given.schema["row"], *StructType.fromDDL(f"found {FOUND}").fields])).select("row.*", F.col("found").alias(name))


def _by_shuffle(documents: DataFrame, windows: DataFrame, text_col: str, name: str) -> DataFrame:
    lengths = [r[0] for r in windows.select("m").distinct().collect()]  # ``WINDOW`` at most
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = documents.select(F.sha2(text, 256).alias("sha"), text.alias("text"))

    def kept_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = 0
            for words in chunks(b.column(1)):
                size = len(words.firsts) - 1
                runs: list[set] = [set() for _ in range(size)]
                for m in lengths:
                    for low, high in words.segments():
                        starts, kept, grams = winnowed(words, m, low, high)
                        for t, g in zip((np.searchsorted(words.firsts, starts, side="right") - 1).tolist(), grams[kept].view(np.int64).tolist(), strict=True):
                            runs[t].add((m, g))
                kind = pa.list_(pa.struct([("m", pa.int32()), ("gram", pa.int64())]))
                runs_of = pa.array([[{"m": m, "gram": g} for m, g in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, size), pa.array(np.diff(words.firsts).astype(np.int64)), runs_of], ["sha", "n_words", "runs"])
                i += size

    measured = materialize(texts.mapInArrow(kept_runs, "sha string, n_words bigint, runs array<struct<m:int,gram:bigint>>"), "kept-runs")
    copies = measured.groupBy("sha").agg(F.first("n_words").alias("n_words"), F.count("*").alias("n"))
    runs = measured.select("sha", F.inline("runs"))
    grams = materialize(windows.select("m", "gram").distinct().join(runs.groupBy("m", "gram").agg(F.count("*").alias("n")), ["m", "gram"]), "shared-runs")
    hits = join_hot(runs, grams, ["m", "gram"], "left_semi").distinct()
    hit_texts = materialize(hits.groupBy("sha").agg(F.collect_list(F.struct("m", "gram")).alias("runs")).join(copies.select("sha", "n"), "sha"), "hit-texts")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, runs in enumerate(b.column(2).to_pylist()):
                words = Words(b.column(1).slice(i, 1))
                for m in sorted({r["m"] for r in runs}):
                    own = Members(np.array([r["gram"] for r in runs if r["m"] == m], dtype=np.int64).view(np.uint64))
                    for starts in _candidates(words, m, own):
                        found = pa.array([words.text(s, m) for s in starts.tolist()], pa.binary()).cast(pa.string())
                        n = len(starts)
                        yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n), pa.array(starts.astype(np.int64)), pa.array(np.full(n, m, dtype=np.int32)), found], ["sha", "first", "m", "window"])

    near = join_hot(texts, hit_texts, ["sha"]).select("sha", "text", "runs").mapInArrow(extended, "sha string, first bigint, m int, window string")
    near = materialize(near.distinct(), "extended")
    shared = materialize(windows.select("window").distinct().join(near.groupBy("window").agg(F.count("*").alias("n")), "window"), "shared-windows")
    exact = materialize(join_hot(near, shared, ["window"], "left_semi"), "exact")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merged([(w["first"], w["m"]) for w in ws]) for ws in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], ["sha", "spans"])

    per_text = exact.groupBy("sha").agg(F.collect_list(F.struct("first", "m")).alias("windows"))  # bounded by the text
    covered = per_text.mapInArrow(spans, f"sha string, spans {SPANS}")
    pairs = exact.select("sha", "window").distinct().join(windows.select("window", "item"), "window").select("sha", "item").distinct()
    items = pairs.groupBy("sha").agg(F.transform(F.sort_array(F.collect_list(F.struct("item"))), lambda x: x["item"]).alias("items"))
    found = copies.join(covered, "sha", "left").join(items, "sha", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    found = found.select("sha", "n", F.struct("n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).cast(FOUND).alias("found"))
    rows = documents.select(F.sha2(text, 256).alias("sha"), _row(documents, name))
    return join_hot(rows, materialize(found, "found"), ["sha"]).select("row.*", F.col("found").alias(name))


def with_hits(documents: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", window: int = WINDOW, name: str = "found", most_pairs: int = BROADCAST_PAIRS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``documents`` with a struct: ``n_words``, ``n_hit``, the ``spans`` of hit words and the ``items`` that occur."""
    windows = materialize(item_windows(items, id_col, item_text, window), "item-windows")
    pairs, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    found = _by_broadcast if pairs <= most_pairs and size <= most_bytes else _by_shuffle
    return found(documents, windows, text_col, name)


def clean(documents: DataFrame, items: DataFrame, **named) -> DataFrame:
    """The documents in which no window of an item occurs."""
    rows = documents.select(F.col(f"`{named.get('text_col', 'text')}`").alias("text"), _row(documents, ""))
    return with_hits(rows, items, name="found", **(named | {"text_col": "text"})).where("found.n_hit = 0").select("row.*")


def decontamination_digest(documents: DataFrame, benchmark: DataFrame, **named) -> DataFrame:
    """Words, hit words and occurring items of every document. The id of an item without one reads as an empty text."""
    found = with_hits(documents.select("doc_id", "text"), benchmark, **named)
    ids = F.transform("found.items", lambda x: F.coalesce(x, F.lit("")))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )

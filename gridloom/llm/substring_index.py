"""Substring deduplication over words, with a log-structured index of fingerprints of past documents.

A window is ``WINDOW`` consecutive words. Its anchor is the least hashed gram of ``GRAM`` words in it (the leftmost of
equals), so equal windows have equal anchors at equal places; consecutive windows of one anchor form a span. The index
consists of immutable runs, bucketed and sorted by part, which is the gram: one row per span, with its gram, a name of
its words and its document. A batch of documents becomes a run of its own and is merge-joined with the live runs, bucket
by bucket and without a shuffle: a span whose content an earlier document has goes whole; where only the gram is shared,
the windows of one span of each content are verified by 128-bit names of their words. When runs grow many they are
compacted into one that keeps the first document of each content.

No passage or gram fills a bucket, however many documents share it. Spans that repeat inside a document are one row with
all their places. A content that a task has seen in an earlier document is known to repeat: its rows go to any part, so
of a passage that a third of all documents share about one row a task meets the others. A gram that many contents share
is dealt by content, and what its contents have in common is counted beside (``hot_grams``).

A null text has no words; a null id counts as larger than any other; documents that repeat an id are never earlier than
each other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import skew
from gridloom.llm.scratch import delete, discard, materialize, release, scratch_path
from gridloom.llm.suffix_dedup import least_places, merge_windows
from gridloom.llm.words import SPACED, Words, chunks, mix, powers

WINDOW, GRAM = 13, 4
#: Words whose grams are hashed at a time.
CHUNK = 300_000
#: Rows after which a worker hands on what it has made.
OUT_ROWS = 50_000
#: Share of the texts in which hot grams are counted; they decide where rows go, never which.
HOT_SAMPLE = 0.05
#: Most contents of which a task remembers the first document; then it forgets them, and more rows meet.
CONTENTS = 500_000
_FACTORS = [np.uint64(int(x) | 1) for x in np.random.default_rng(20250).integers(2**62, 2**63, GRAM)]
LAST_ID = 2**63 - 1


def word_places(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words joined by one space, and where each begins in that (with the end of the last, plus one)."""
    return b" ".join(words), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def find_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of texts ``d``, ``h`` (27 bits of the text's hash), ``data``; place packs first word, anchor, length, h.

    ``s`` is null where this task has seen the content in an earlier document.
    """
    firsts: dict[int, tuple[int, int]] = {}
    for b in batches:
        d, h, row = np.asarray(b.column(0)), np.asarray(b.column(1)), 0
        for words in chunks(b.column(2), SPACED, lower=False):
            n_rows = len(words.firsts) - 1
            for low, high in words.segments(CHUNK):
                found = _spans_of(words, low, min(high, len(words.hashes)))
                if found is None:
                    continue
                lo, at, hi, grams, names = found
                owner = np.searchsorted(words.firsts, lo, side="right") - 1
                rows = row + owner
                place = (lo - words.firsts[owner]) << 35 | (at - lo) << 31 | (hi - lo) << 27 | h[rows]
                kept, more = _gathered(rows, grams, names, place)
                rows, grams, names, place = rows[kept], grams[kept], names[kept], place[kept]
                known = _seen_before(grams, names, d[rows], firsts)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(names.view(np.int64), mask=known), pa.array(d[rows]), pa.array(place), more], ["gram", "s", "d", "place", "more"])
            row += n_rows


def _spans_of(words: Words, low: int, high: int) -> tuple[np.ndarray, ...] | None:
    """First window, anchor and last window of the spans of windows that start from ``low`` to ``high``, with the hash of
    the anchor's gram and a name of the words (and of the anchor's place in them); None without a window."""
    hashed = words.hashes[low : high + WINDOW - 1]
    n = len(hashed) - GRAM + 1
    if n < WINDOW - GRAM + 1:
        return None
    grams = sum(hashed[i : n + i] * _FACTORS[i] for i in range(GRAM))
    grams = grams ^ (grams >> np.uint64(32))
    at = least_places(grams, WINDOW - GRAM + 1)
    windows = np.flatnonzero(words.last[low : low + len(at)] - np.arange(low, low + len(at)) >= WINDOW)
    if not len(windows):
        return None
    at, owner = at[windows], words.last[low + windows]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    lo, hi, at = windows[new], windows[np.append(new[1:], len(windows)) - 1], at[new]
    up, down = powers()
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashed * up[: len(hashed)], dtype=np.uint64)])
    names = mix(((sums[hi + WINDOW] - sums[lo]) * down[lo]) ^ mix(((hi - lo) << 4 | (at - lo)).astype(np.uint64) + np.uint64(1)))
    return lo + low, at + low, hi + low, grams[at], names


def _gathered(row: np.ndarray, gram: np.ndarray, name: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Spans that repeat inside a document become one row before the shuffle: which stay, and the places of the rest."""
    order = np.lexsort((np.arange(len(row)), name, gram, row))
    new = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (gram[order][1:] != gram[order][:-1]) | (name[order][1:] != name[order][:-1])])
    if new.all():
        return np.arange(len(row)), pa.nulls(len(row), pa.list_(pa.int64()))
    rest = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
    offsets = pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32())
    return order[new], pa.ListArray.from_arrays(offsets, pa.array(place[order][~new]), mask=pa.array(rest == 0))


def _seen_before(gram: np.ndarray, name: np.ndarray, d: np.ndarray, firsts: dict[int, tuple[int, int]]) -> np.ndarray:
    """Which spans have a content that an earlier document has, here or in ``firsts``, which learns what repeats here."""
    order = np.lexsort((d, gram, name))
    g, n, own = gram[order], name[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (g[1:] != g[:-1])]))
    sizes = np.diff(np.append(new, len(order)))
    least = own[new].tolist()
    for i, (key, anchor, size) in enumerate(zip(n[new].tolist(), g[new].tolist(), sizes.tolist(), strict=True)):
        held = firsts.get(key)
        if held and held[0] == anchor:
            if held[1] <= least[i]:
                least[i] = held[1]
            else:
                firsts[key] = (anchor, least[i])
        elif size > 1:
            if len(firsts) >= CONTENTS:
                firsts.clear()
            firsts[key] = (anchor, least[i])
    out = np.empty(len(order), dtype=bool)
    out[order] = own > np.repeat(np.array(least, dtype=np.int64), sizes)
    return out


SPANS = "gram bigint, s bigint, d bigint, place bigint, more array<bigint>"


def _name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_intdigest

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([*map(_signed, columns[:2]), *(pa.array(c, pa.int64()) for c in columns[2:])], ["w1", "w2", "d", "h", "start"])

    for b in batches:
        rows: list[tuple] = []
        for d, data, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            joined, places = word_places((data or b"").split())
            places = places.tolist()
            for place in spans:
                lo = place >> 35
                for start in range(lo, lo + (place >> 27 & 15) + 1):
                    name = digest(joined[places[start] : places[start + WINDOW] - 1])
                    rows.append((name >> 64, name & (2**64 - 1), d, place & ((1 << 27) - 1), start))
                if len(rows) >= OUT_ROWS:
                    yield batch(rows)
                    rows = []
        yield batch(rows)


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name and document, those whose name an earlier document has."""
    w1 = w2 = first = None
    for b in batches:
        if not b.num_rows:
            continue
        n1, n2, d, h, start = (np.asarray(c) for c in b.columns)
        new = np.concatenate([[w1 is None or n1[0] != w1 or n2[0] != w2], (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])
        at = np.flatnonzero(new)
        firsts = np.concatenate([[d[0] if new[0] else first], d])[np.maximum.accumulate(np.where(new, np.arange(len(d)) + 1, 0))]
        later = d > firsts
        w1, w2, first = n1[-1], n2[-1], d[at[-1]] if len(at) else first
        yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (d, h, start, start)], ["d", "h", "first", "last"])


def hot_grams(texts: DataFrame) -> list[int]:
    """Grams of more than 1 in ``skew.HOT_KEYS`` of the spans of a sample of the texts; so their number is bounded."""
    counts = materialize(texts.sample(HOT_SAMPLE, seed=8).select("d", "h", "data").mapInArrow(find_spans, SPANS).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    limit = max(skew.HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // skew.HOT_KEYS)
    found = [r[0] for r in counts.where(F.col("n") > limit).select("gram").collect()]
    discard(counts)
    return found


class FingerprintIndex:
    """Runs of window fingerprints of the documents added so far; ``hot`` are grams to be dealt by content.

    The runs lie below ``path``, a folder that driver and executors share (one of the scratch folder unless given), with
    the index's state after every batch; :meth:`open` goes on from there in another application.
    """

    #: A batch of fewer than one in so many rows of the index is joined with the index's rows of its own parts alone.
    SMALL = 8

    def __init__(self, spark: SparkSession, buckets: int | None = None, max_runs: int = 4, hot: list[int] | None = None, path: str | None = None):
        self.spark, self.max_runs, self.hot = spark, max_runs, hot or []
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = (path or scratch_path(spark, "index")).rstrip("/")
        self.made = self.live = self.generation = self.steps = self.rows = 0
        self._name_table()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index below ``path`` as its last whole batch left it; what an ended batch had begun is deleted."""
        at = spark.read.parquet(f"{path.rstrip('/')}/state").orderBy(F.desc("step")).first()
        out = cls(spark, at.buckets, at.max_runs, list(at.hot), path)
        out.made, out.live, out.generation, out.rows, out.steps = at.made, at.live, at.generation, at.rows, at.step + 1
        known = {f"run={i}" for i in range(at.made)}
        for folder in _children(spark, out.path):
            if folder.startswith("runs-") and folder != f"runs-{at.generation}":
                delete(spark, f"{out.path}/{folder}")
        for folder in _children(spark, out._folder()):
            if folder.startswith("run=") and folder not in known:
                delete(spark, f"{out._folder()}/{folder}")
        spark.sql(
            f"CREATE TABLE {out.name} ({SPANS}, part bigint, run int) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (part) SORTED BY (part) INTO {out.buckets} BUCKETS LOCATION '{out._folder()}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {out.name}")
        return out

    def _name_table(self) -> None:
        self.name = f"gridloom_index_{uuid.uuid4().hex}"

    def _folder(self) -> str:
        return f"{self.path}/runs-{self.generation}"

    def _save(self) -> None:
        state = [(self.buckets, self.max_runs, self.hot, self.made, self.live, self.generation, self.rows)]
        df = self.spark.createDataFrame(state, "buckets int, max_runs int, hot array<bigint>, made int, live int, generation int, rows bigint")
        df.coalesce(1).write.parquet(f"{self.path}/state/step={self.steps}")
        self.steps += 1

    def _write_run(self, rows: DataFrame) -> None:
        """A run is a partition of the index's table; the files of a bucket, of all runs, are read by one task."""
        part = F.when(F.col("s").isNull(), F.xxhash64("d", "place")).when(F.col("gram").isin(self.hot), F.xxhash64("gram", "s")).otherwise(F.col("gram"))
        rows = rows.select("gram", "s", "d", "place", "more", part.alias("part"), F.lit(self.made).alias("run")).repartition(self.buckets, "part")
        rows.write.mode("append").partitionBy("run").bucketBy(self.buckets, "part").sortBy("part").format("parquet").option("path", self._folder()).saveAsTable(self.name)
        self.made, self.live = self.made + 1, self.live + 1
        release(self.spark)

    def _run(self) -> DataFrame:
        """The run written last."""
        return self.spark.table(self.name).where(F.col("run") == self.made - 1)

    def _to_join(self) -> DataFrame:
        """The rows that the last run's are compared with: all runs, of which a small batch's parts are enough."""
        n = self._run().count()
        self.rows += n
        every = self.spark.table(self.name)
        if n * self.SMALL >= self.rows:
            return every
        # The contents of a hot gram lie in many parts.
        parts = self._run().select("part").union(every.where(F.col("gram").isin(self.hot)).select("part"))
        return skew.only_keys(every, materialize(parts.distinct(), "parts"), ["part"])

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Indexes ``batch`` (``d``, ``h``, ``data``) and merge-joins it with the live runs.

        After the ``last`` batch, before the index is dropped, runs are not compacted.

        Gives spans ``d``, ``place``: ``whole``, those of the batch whose content an earlier document has, and
        ``verify``, one of each content of a gram of which the batch brings a content of its own; see :func:`verified`.
        """
        spans = batch.select("d", "h", "data").mapInArrow(find_spans, SPANS)
        self._write_run(spans)
        content = Window.partitionBy("part", "gram", "s")
        gram = Window.partitionBy("part", "gram").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        new, known = F.col("run") == self.made - 1, F.col("s").isNull()
        rows = (
            self._to_join()
            .withColumn("first", F.min("d").over(content))
            .withColumn("leads", ~known & (F.col("d") == F.col("first")))
            .withColumns({"mixed": F.min("s").over(gram) != F.max("s").over(gram), "fresh": F.max(new & F.col("leads")).over(gram)})
        )
        if self.hot:
            contents = self.spark.table(self.name).where(~known & F.col("gram").isin(self.hot)).groupBy("gram", "s").agg(F.min("d").alias("first"), F.min(F.when(new, F.col("d"))).alias("own"))
            of_hot = contents.groupBy("gram").agg((F.min("s") != F.max("s")).alias("hot_mixed"), F.max(F.col("own").eqNullSafe(F.col("first"))).alias("hot_fresh"))
            # At most skew.HOT_KEYS rows.
            rows = rows.join(F.broadcast(of_hot), "gram", "left").withColumns({"mixed": F.coalesce("hot_mixed", "mixed"), "fresh": F.coalesce("hot_fresh", "fresh")})
        seen = (
            rows.select("d", "place", "more", (new & (known | (F.col("d") > F.col("first")))).alias("whole"), (F.col("mixed") & F.col("fresh") & F.col("leads")).alias("verify"))
            .where("whole or verify")
            .withColumn("place", F.explode(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<bigint>")))))
            .drop("more")
        )
        seen = materialize(seen, "seen")
        if self.live > self.max_runs and not last:
            self.compact()
        if not last:
            self._save()
        return seen

    def compact(self) -> None:
        """Merges all runs into one that keeps, of each content, the spans of the first document."""
        first = F.min("d").over(Window.partitionBy("part", "gram", "s"))
        kept = self.spark.table(self.name).where("s is not null").withColumn("first", first).where("d = first")
        old, folder = self.name, self._folder()
        self.live, self.generation = 0, self.generation + 1
        self._name_table()
        self._write_run(kept)
        self.rows = self._run().count()
        self._save()
        self.spark.sql(f"DROP TABLE {old}")
        delete(self.spark, folder)

    def drop(self) -> None:
        """Deletes the index; :meth:`close` leaves it to be opened again."""
        self.close()
        delete(self.spark, self.path)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def _hash_bits() -> Column:
    return F.col("place").bitwiseAND(F.lit((1 << 27) - 1))


def verified(seen: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows that start in an earlier document too: ``d``, ``h``, ``first``, ``last``.

    Spans to verify are cut from ``texts`` and their windows named by 128 bits of their words; sorted by name and
    document, those after the first document of a name are repeats.
    """
    lo = F.shiftright("place", 35)
    whole = seen.where("whole").select("d", _hash_bits().alias("h"), lo.alias("first"), (lo + F.shiftright("place", 27).bitwiseAND(F.lit(15))).alias("last"))
    # The spans of one document.
    per_text = materialize(seen.where("verify").groupBy("d", _hash_bits().alias("h")).agg(F.collect_set("place").alias("spans")), "verify")
    named = texts.join(per_text, ["d", "h"]).select("d", "data", "spans").mapInArrow(_name_windows, "w1 bigint, w2 bigint, d bigint, h bigint, start bigint")
    later = named.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "d").mapInArrow(_later_windows, "d bigint, h bigint, first bigint, last bigint")
    later = materialize(later, "later")
    discard(per_text)
    release(seen.sparkSession)
    return whole.unionByName(later)


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("d"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << 27) - 1)).alias("h"),
        text.cast("binary").alias("data"),
    )


def window_cuts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """``d``, ``h`` and ``cuts``, the ranges of windows of each text that start in an earlier document too.

    The documents are added in ``batches`` by ascending id; any number gives the same result.
    """
    spark = documents.sparkSession
    texts = _texts(documents, id_col, text_col)
    edges = sorted(set(texts.agg(F.percentile_approx("d", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    index, parts = FingerprintIndex(spark, max_runs=1, hot=hot_grams(texts)), []
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        batch = texts if low is None else texts.where(F.col("d") > low)
        batch = batch if high is None else batch.where(F.col("d") <= high)
        parts.append(index.add(batch, last=high is None))
    index.drop()
    # Texts are read once to verify all batches; the first document of a content is the same in all of them.
    seen = reduce(DataFrame.unionByName, parts)
    cuts = verified(seen, texts).groupBy("d", "h").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))  # ranges of one text
    out = materialize(cuts, "cuts")
    discard(*parts)
    release(spark)
    return out


def kept_words(words: list[bytes], cuts: list[dict] | None) -> tuple[list[bytes], int]:
    """The words outside the windows, and how many lie inside."""
    if not cuts:
        return words, 0
    out, at, removed = [], 0, 0
    for a, z in merge_windows([c["first"] for c in cuts], [c["last"] for c in cuts], WINDOW):
        out += words[at:a]
        removed += z - a
        at = z
    return out + words[at:], removed


def dedup_digest(documents: DataFrame, batches: int = 3) -> DataFrame:
    """Per document its words, the words removed, and the digest of the words kept, joined by one space."""
    cuts = window_cuts(documents, batches=batches)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            n_words, removed, sha = [], [], []
            for data, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = data.split()
                kept, n = kept_words(words, own)
                n_words.append(len(words))
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    texts = _texts(documents, "doc_id", "text").withColumn("id", F.when(F.col("d") != LAST_ID, F.col("d")))
    return texts.join(cuts, ["d", "h"], "left").select("id", "data", "cuts").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(documents: DataFrame, batches: int = 3) -> DataFrame:
    """The documents without the windows that start in an earlier one; ``n_chars`` follows the text.

    A text that loses words becomes its kept words joined by one space, others stay as they are, and a document of
    which nothing is left keeps its row with an empty text.
    """
    cuts = window_cuts(documents, batches=batches).withColumnsRenamed({"d": "__d", "h": "__h", "cuts": "__cuts"})
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.withColumns({"__d": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), "__h": F.xxhash64(text).bitwiseAND(F.lit((1 << 27) - 1))})
    joined = keyed.join(cuts, ["__d", "__h"], "left").select(*documents.columns, "__cuts")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, texts = b.schema.get_field_index("text"), []
            for t, own in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                texts.append(b" ".join(kept_words(t.encode().split(), own)[0]).decode() if own else t)
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            if (chars := b.schema.get_field_index("n_chars")) >= 0:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])

    return joined.mapInArrow(run, documents.schema)

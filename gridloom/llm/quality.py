"""Quality rules whose cutoffs are certified on labelled holdouts.

A fixed path of rules, lenient before strict, is tested in each stratum on the labelled documents: a step passes if
the exact binomial test rejects "more than ``limit`` of the good documents are turned away" (the Clopper-Pearson bound
lies at or under the limit). Testing stops at the first step that fails (fixed-sequence testing), and the error level
is divided by the number of strata (Bonferroni), so that with probability ``1 - delta`` no stratum exceeds the limit.
Of the certified steps a stratum takes the one that turns away most bad documents, a good one counting ten times.
A stratum with too few labels to certify any step turns nothing away beyond the base rule.

All documents give features and all labels count; only sums per stratum are gathered, and they stay in a table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import materialize

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# What counts as a symbol and as white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Cutoffs on symbols per word, then on the share of repeated lines, then on the share of repeated words.
SYMBOL_STEPS = (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2)
LINE_STEPS = (0.6, 0.5, 0.4, 0.3)
WORD_STEPS = (0.18, 0.15, 0.12, 0.1)
NEVER = 1e18
PATH = (
    [(s, NEVER, NEVER) for s in SYMBOL_STEPS]
    + [(SYMBOL_STEPS[-1], s, NEVER) for s in LINE_STEPS]
    + [(SYMBOL_STEPS[-1], LINE_STEPS[-1], s) for s in WORD_STEPS]
)
#: More strata than this are joined, not broadcast.
BROADCAST_STRATA = 10_000
GOOD_WEIGHT = 10


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window found twice or more, by exact naming of ever longer windows."""
    n = len(words)
    if n <= window:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)
    name, length = ids, 1
    while length < window:
        step = min(length, window - length)
        pair = name[:-step] * (int(name.max()) + 1) + name[step:]
        values, name, counts = np.unique(pair, return_inverse=True, return_counts=True)
        length += step
        if len(values) == len(pair):
            return 0
    starts = np.flatnonzero(counts[name] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The features of one whole text; a null text has no words and no lines."""
    text = text or ""
    words = text.encode().split()
    lines = Counter(line for line in text.split("\n") if line.strip(SPACES))
    n_lines = sum(lines.values())
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), n_lines, n_lines - len(lines), repeated_words(words)


def with_features(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and the features of ``text_col``; a column of a feature's name is replaced.

    ``text_col`` may be a field of a struct that is kept (``struct.field``), which spares a copy of the text.
    """
    keep = [c for c in keep if c not in FEATURES]
    struct, _, field = text_col.partition(".")
    inside = keep.index(struct) if field else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)) if inside is None else b.column(inside).field(field)
            found = [measure(t.as_py()) for t in texts]
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *columns], [*b.schema.names[: len(keep)], *FEATURES])

    # A text of its own comes last, under a name of its own.
    given = df.select(*[F.col(f"`{c}`") for c in keep], *([F.col(text_col).alias("__text")] if inside is None else []))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(keep)])
    return given.mapInArrow(run, (kept + ", " if kept else "") + ", ".join(f"{c} bigint" for c in FEATURES))


def with_base(df: DataFrame) -> DataFrame:
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _fails(symbols: float | F.Column, lines: float | F.Column, words: float | F.Column) -> F.Column:
    as_column = lambda x: F.lit(x) if isinstance(x, float) else x
    n_words, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return (
        (F.col("n_symbols") / n_words >= as_column(symbols))
        | (F.col("n_dup_lines") / n_lines >= as_column(lines))
        | (F.col("n_repeat_words") / n_words >= as_column(words))
    )


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial, by exact terms."""
    log_p, log_q, top = math.log(p), math.log1p(-p), math.lgamma(n + 1)
    return math.fsum(math.exp(top - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q) for i in range(k + 1))


def certified_step(n: int, good: list[int], bad: list[int], limit: float, level: float) -> int | None:
    """The step of PATH to use for a stratum with ``n`` good documents, or None."""
    best, best_gain = None, 0
    for i, (g, b) in enumerate(zip(good, bad, strict=True)):
        if not n or g > n * limit or binomial_at_most(g, n, limit) > level:
            break
        if (gain := b - GOOD_WEIGHT * g) > best_gain:
            best, best_gain = i, gain
    return best


def cutoffs(features: DataFrame, labels: DataFrame, stratum: str, limit: float = 0.05, delta: float = 0.05) -> DataFrame:
    """A row for each stratum with labels: its cutoffs, and how many good documents they were certified on.

    ``features`` has doc_id, the stratum and base_failed; ``labels`` has doc_id and quality (1: good). Base failures
    are no part of the test, as no cutoff changes their fate; rows without a quality label count nowhere. A document
    counts once in its stratum, by the least of its labels and the largest of its features if rows repeat its id, so
    that the test stays exact.
    """
    fails = [_fails(*step) for step in PATH]
    sums = lambda quality: F.array(*[F.sum((f & (F.col("quality") == quality)).cast("bigint")) for f in fails])
    seen = (
        features.where(~F.col("base_failed"))
        .groupBy("doc_id", F.col(stratum).alias("stratum"))
        .agg(*[F.max(c).alias(c) for c in FEATURES])
        .join(labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
        .groupBy("stratum")
        .agg(F.sum((F.col("quality") == 1).cast("bigint")).alias("n"), sums(1).alias("good"), sums(0).alias("bad"))
    )
    seen = materialize(seen, "strata")
    level = delta / max(1, seen.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            steps = [certified_step(r["n"], r["good"], r["bad"], limit, level) for r in rows]
            cuts = [PATH[i] if i is not None else (NEVER,) * 3 for i in steps]
            columns = [b.column(0), b.column(1), *(pa.array([c[k] for c in cuts], pa.float64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["stratum", "n_good", "cut_symbols", "cut_lines", "cut_words"])

    kind = seen.schema["stratum"].dataType.simpleString()
    return materialize(seen.mapInArrow(run, f"stratum {kind}, n_good bigint, cut_symbols double, cut_lines double, cut_words double"), "cutoffs")


def judge(features: DataFrame, cuts: DataFrame, stratum: str) -> DataFrame:
    """``features`` with ``kept``: neither the base rule nor a certified cutoff of its stratum turns it away."""
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    joined = features.join(cuts, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    verdict = _fails(*(F.coalesce(F.col(c), F.lit(NEVER)) for c in ("cut_symbols", "cut_lines", "cut_words")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~verdict)


def quality_digest(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: its features, whether the base rule fails it, and whether it is kept."""
    features = materialize(with_base(with_features(documents, ["doc_id", stratum])), "features")
    out = judge(features, cutoffs(features, labels, stratum), stratum)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", stratum)


def keep_good(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents kept, with their own columns.

    Cutoffs are certified on the features of all documents, a narrow table; the texts then pass once more with their
    features beside them. That spares a shuffle of texts and a written copy of the corpus, at the price of measuring
    each text twice.
    """
    cuts = cutoffs(materialize(with_base(with_features(documents, ["doc_id", stratum])), "features"), labels, stratum)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    carried = documents.select(row.alias("__row"), F.col(stratum).alias("__stratum"))
    found = with_base(with_features(carried, ["__row", "__stratum"], "__row.text"))
    return judge(found, cuts, "__stratum").where("kept").select("__row.*")

"""Threshold-scaled sketches of documents, by DataFrame functions alone.

A sketch keeps every hash of a five-word shingle that lies below 1/``scale`` of the hash range, so its size follows the
document and the sketches of very unequal documents can be compared: the share of the smaller sketch that is in the
larger one estimates containment. A text of fewer than five words is one shingle. If no hash of a text lies below the
threshold, its least hash stands in, so that only texts without words have an empty sketch. Sketches merge by union;
a stand-in stays only if it is the least of both and nothing lies below the threshold, so the merged sketch is that of
both texts' shingles together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, SCALE = 5, 4
#: Fixed value: what separates words.
SPACES = r"[\x20\x09-\x0D]+"
_FLIP = -(2**63)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def shingle_hashes(tokens: Column) -> Column:
    """Hashes of the shingles of an array column of words (a column, not an expression, for speed)."""
    n = F.size(tokens)
    shingles = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(SHINGLE)]))
    # Arrays hash as their elements in turn, which is what the short text's only shingle needs.
    return F.when(n >= SHINGLE, shingles).when(n > 0, F.array(F.xxhash64(tokens))).otherwise(F.array().cast("array<bigint>"))


def threshold(hashes: Column, scale: int = SCALE) -> Column:
    """The sketch of the hashes: sorted and distinct, those below the threshold, or the least (unsigned) as a stand-in."""
    below = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: (h >= 0) & (h < 2**64 // scale))))
    least = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(_FLIP)))).bitwiseXOR(F.lit(_FLIP))
    return F.when((F.size(below) == 0) & (F.size(hashes) > 0), F.array(least)).otherwise(below)


def with_sketch(df: DataFrame, text: Column, name: str, scale: int = SCALE) -> DataFrame:
    """``df`` with the sketch of ``text`` as column ``name``; a null text counts as empty."""
    return (
        df.withColumn("__words", words(F.coalesce(text, F.lit(""))))
        .withColumn("__hashes", shingle_hashes(F.col("__words")))
        .withColumn(name, threshold(F.col("__hashes"), scale))
        .drop("__words", "__hashes")
    )


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    return threshold(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the larger one holds; 1 for two empty ones, 0 if only one is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise((F.size(a) == F.size(b)).cast("double"))


def text_of(a: Column) -> Column:
    """A sketch as text: twelve hexadecimal digits for each hash, its top 48 bits."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(F.shiftrightunsigned(h, 16)), 12, "0"))), "")


#: Bytes of text in a range of ids; there are at most ``MOST_RANGES``, which then hold more.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 1 << 20, 64, 1 << 20


def _quantiles(value: Column, n: int) -> Column:
    return F.percentile_approx(value, [i / n for i in range(1, n)], 10_000) if n > 1 else F.array().cast("array<bigint>")


def with_range(df: DataFrame, place: str, ties: str, text: Column, name: str, n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``, the number of the range of (``place``, ``ties``) that a row lies in; ranges follow the bytes of ``text``.

    Ranges lie between quantiles and are cut once more at quantiles of their own, so that a row is compared with twice
    the square root of their number. A value of ``place`` of many rows is a range of itself, which is cut by ``ties``.
    """
    if n_ranges is None:
        size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
        n_ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-size // RANGE_BYTES)))
    n_outer = math.isqrt(n_ranges)
    n_inner = -(-n_ranges // n_outer)
    found = df.agg(_quantiles(F.col(place), n_outer)).first()[0] or []
    edges = sorted({*found, *(e - 1 for e, times in Counter(found).items() if times > 1 and e > -(2**63))})
    below = lambda cuts, x: F.size(F.filter(cuts, lambda e: e < F.col(x)))
    ranged = df.withColumn(name, below(F.array(*[F.lit(e) for e in edges]).cast("array<bigint>"), place).cast("bigint"))
    # Quantiles of few distinct values are those of the ties, which need as many parts as the value has shares of all rows.
    parts = n_inner * (1 + max(Counter(found).values(), default=0))
    inner = ranged.groupBy(F.col(name).alias("__outer")).agg(
        (F.min(place) == F.max(place)).alias("__one"), F.array_distinct(_quantiles(F.col(place), n_inner)).alias("__cuts"), F.array_distinct(_quantiles(F.col(ties), parts)).alias("__tie_cuts"),
    )
    # A row for each of some thousand outer ranges at most.
    cut = ranged.join(F.broadcast(inner), F.col(name) == F.col("__outer"))
    number = F.when(F.col("__one"), below(F.col("__tie_cuts"), ties)).otherwise(below(F.col("__cuts"), place))
    return cut.withColumn(name, F.col(name) * parts + number).drop("__outer", "__one", "__cuts", "__tie_cuts")


def with_next(df: DataFrame, id_col: str, carried: list[str], ties: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, text: str = "text", n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``next``, a struct of ``carried`` of the row that follows in ascending id; the last has the first.

    Inside a range of ids the next row is found by a window; the last row of a range takes the first row of the next
    range, of which there is one for each range. Rows of equal ids follow each other by ``ties``, a long; a null id
    comes first. ``prepare`` adds columns to carry, after the only shuffle of whole rows.
    """
    place = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63)))
    keyed = with_range(df.withColumn("__place", place), "__place", ties, F.col(text), "__range", n_ranges)
    order = Window.partitionBy("__range").orderBy("__place", ties)
    rows = prepare(keyed.repartition("__range")).withColumn("__next", F.lead(F.struct(*carried)).over(order))

    # One head for each range. Only their ranges are ordered in one task; the heads' texts are joined to them afterwards.
    heads = keyed.groupBy("__range").agg(F.min(F.struct("__place", ties)).alias("__head")).select("__range", F.col("__head.__place").alias("__place"), F.col(f"__head.{ties}").alias(ties))
    whole = Window.orderBy("__range")  # one row of numbers for each range
    follows = heads.select(F.col("__range").alias("__of"), F.coalesce(F.lead("__range").over(whole), F.first("__range").over(whole)).alias("__range"))
    firsts = keyed.join(F.broadcast(heads), ["__range", "__place", ties], "left_semi").dropDuplicates(["__range"])  # three numbers for each range
    firsts = prepare(firsts).select("__range", F.struct(*carried).alias("__first")).join(F.broadcast(follows), "__range").drop("__range")
    joined = rows.join(firsts, F.col("__range") == F.col("__of"))
    return joined.withColumn("next", F.coalesce("__next", "__first")).drop("__place", "__range", "__next", "__of", "__first")


def sketch_digest(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    given = documents.select("doc_id", text.alias("text")).withColumn("tie", F.xxhash64("text"))
    paired = with_next(given, "doc_id", ["text", "own"], "tie", lambda rows: with_sketch(rows, F.col("text"), "own")).withColumn("n_chars", F.char_length("text").cast("bigint"))
    moved = F.floor(F.col("n_chars") / 4).cast("int")
    paired = paired.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - moved), F.substring("next.text", F.lit(1), moved)))
    both = with_sketch(paired, F.col("edited_text"), "edited")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next.own")).alias("near_next"),
    )

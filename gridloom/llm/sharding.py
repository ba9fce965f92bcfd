"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in blocks (a keyed hash of the id, so that a rerun task finds the same rows). The driver draws how many rows
of every block go to every shard: a multivariate hypergeometric draw, without replacement, so each shard gets exactly
its size. Rows are permuted inside their block, dealt to shards by the matrix, and permuted again inside their shard,
in ranges of a keyed hash whose sizes are counted. The result is a uniform shuffle whose shards differ by one row at
most.

Only the count of each block reaches the driver, and the matrix has ``n_blocks`` times ``n_shards`` numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import materialize

#: numpy's own draws are defined below this population.
_NUMPY_LIMIT = 10**9
P = "__shard_"


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good; any population size."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if total < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    mean = n * good / total
    spread = 50 + 9 * (mean * (bad / total) * max(1, total - n) / total) ** 0.5
    low, high = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Rows from each block to each shard; row sums are ``counts``, column sums are ``shards``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(shards, dtype=np.int64)
    out = np.zeros((len(counts), len(shards)), dtype=np.int64)
    for i, n in enumerate(counts):
        if left.sum() < _NUMPY_LIMIT:
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, n = int(left.sum()), int(n)
            for j, size in enumerate(left.tolist()):
                rest -= size
                out[i, j] = _hypergeometric(rng, size, rest, n)
                n -= int(out[i, j])
        left -= out[i]
    return out


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def uniform_shards(df: DataFrame, id_col: str, n_shards: int = 16, seed: int = 20240, n_blocks: int | None = None) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long (gapless from 0 in each shard), uniformly shuffled.

    Shard counts differ by one at most. Equal ids share a block but get slots of their own; a null id is an id like
    any other; an empty table stays empty. Columns of the names ``shard`` and ``slot`` are replaced. ``n_blocks``
    defaults to the number of shuffle partitions, within 64 and 4096. Rows are dealt in an order of their hashes, to
    which all columns that can be hashed belong, so that a rerun task deals rows of one id alike.
    """
    spark = df.sparkSession
    if n_blocks is None:
        n_blocks = min(4096, max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df = df.drop("shard", "slot")
    own = [F.col(f"`{c}`") for c in df.columns]
    whole = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    keyed = df.withColumns({
        P + "block": F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_blocks)).cast("int"),
        P + "h1": F.xxhash64(F.lit(seed + 1), id_col),
        P + "h2": F.xxhash64(F.lit(seed + 2), id_col, *whole),
    })

    counts = {r[0]: r[1] for r in keyed.groupBy(P + "block").count().collect()}
    blocks = sorted(counts)
    drawn = communication_matrix([counts[b] for b in blocks], _even(sum(counts.values()), n_shards), seed)
    ends = drawn.cumsum(axis=1)
    matrix = spark.createDataFrame([(b, ends[i].tolist()) for i, b in enumerate(blocks)], f"`{P}at` int, `{P}ends` array<bigint>")

    # A first permutation inside the block decides which rows go to which shard.
    first = Window.partitionBy(P + "block").orderBy(P + "h1", P + "h2")
    ranked = keyed.withColumn(P + "rank", F.row_number().over(first).cast("bigint") - 1).join(F.broadcast(matrix), F.col(P + "block") == F.col(P + "at"))  # at most 4096 rows
    dealt = ranked.withColumn("shard", F.size(F.filter(P + "ends", lambda x: x <= F.col(P + "rank"))))
    # A second permutation, by another hash, decides the slots: its ranges are counted, its rows numbered in their range.
    n_ranges = -(-n_blocks // n_shards)
    ranged = dealt.withColumns({P + "range": F.pmod(F.xxhash64(F.lit(seed + 3), P + "h2"), F.lit(n_ranges)).cast("int"), P + "h3": F.xxhash64(F.lit(seed + 4), P + "h2")})
    ranged = materialize(ranged.select(*own, "shard", P + "range", P + "h1", P + "h2", P + "h3"), "dealt")
    before = F.sum("count").over(Window.partitionBy("shard").orderBy(P + "range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("shard", P + "range").count().select("shard", P + "range", F.coalesce(before, F.lit(0)).alias(P + "start"))
    second = Window.partitionBy("shard", P + "range").orderBy(P + "h3", P + "h2", P + "h1")
    placed = ranged.join(F.broadcast(starts), ["shard", P + "range"])  # as many rows as blocks
    return placed.withColumn("slot", (F.col(P + "start") + F.row_number().over(second) - 1).cast("bigint")).select(*own, "shard", "slot")


def shard_documents(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """The digest of :func:`uniform_shards` on documents: a null text has no bytes and counts as size 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return uniform_shards(rows, "doc_id", n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

"""Merkle manifest of a dataset: one tree a language, one tree over their roots, and an authentication path a row.

A digest is the lowercase hexadecimal SHA-256 of its inputs' concatenation. A leaf has the fields of a row, each as its
length in UTF-8 bytes, ``:`` and its value, or ``-`` for null. Leaves of a run (a language; null is a run) ascend by
id; while several nodes remain, every two consecutive ones, or the last one alone, become their digest.

Rows get their place in ranges of the sorted ids whose sizes are counted. Aligned blocks of ``2 ** most``
leaves (4,096) are traversed in tasks of their own by the fractal method: the block keeps, for every ``SUBTREE_HEIGHT`` levels,
the existing subtree over the current leaf and the desired one that comes next, which grows by two units a leaf, and so
emits one path after the other. The blocks' roots are leaves of the next, shorter tree, which is built and traversed
alike, until every run is one block; its paths are appended to those of the block.

Rows of equal id follow each other by leaf, a null id comes first; rows that are equal as a whole get paths of their
own. A run of one row has its leaf as root. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.scratch import materialize

BLOCK_HEIGHT, SUBTREE_HEIGHT = 12, 3
#: Rows in a range of sorted ids, at most about.
RANGE_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Sides of a sibling in a path; a level without sibling is an empty text.
LEFT, RIGHT = "<", ">"


def combine(left: bytes | None, right: bytes | None) -> bytes | None:
    """The node over two nodes, of which the right one or both may be beyond the end."""
    return None if left is None else hashlib.sha256(left + (right or b"")).hexdigest().encode()


def height_of(n: int) -> int:
    return max(0, n - 1).bit_length()


class Subtree:
    """The nodes of levels ``bottom`` to ``top - 1`` below node ``index`` of level ``top``, by treehash, a unit at a time.

    A unit takes a leaf or merges two nodes. At most one node a level waits on the stack.
    """

    def __init__(self, leaves: Sequence[bytes], bottom: int, top: int, index: int):
        self.leaves, self.bottom, self.top = leaves, bottom, top
        self.next, self.end = index << top, (index + 1) << top
        self.nodes: dict[tuple[int, int], bytes | None] = {}
        self.stack: list[tuple[int, bytes | None]] = []

    def grow(self, units: int) -> None:
        stack = self.stack
        for _ in range(units):
            if len(stack) > 1 and stack[-1][0] == stack[-2][0] < self.top - 1:
                level, right = stack.pop()
                level, node = level + 1, combine(stack.pop()[1], right)
            elif self.next < self.end:
                level, node = 0, self.leaves[self.next] if self.next < len(self.leaves) else None
                self.next += 1
            else:
                return
            stack.append((level, node))
            if level >= self.bottom:
                self.nodes[level, (self.next - 1) >> level] = node

    def whole(self) -> Subtree:
        self.grow(2 << self.top)
        return self


def root_of(leaves: Sequence[bytes], height: int) -> bytes:
    """The root ``height`` levels above the leaves, by one treehash."""
    if height == 0:
        return leaves[0]
    top = Subtree(leaves, height - 1, height, 0).whole().nodes
    return combine(top[height - 1, 0], top[height - 1, 1])


def paths(leaves: Sequence[bytes], height: int, span: int = SUBTREE_HEIGHT) -> Iterator[list[str]]:
    """Authentication paths of the leaves in order: on each level the sibling with its side, or an empty text.

    Nodes kept at a time are those of two subtrees for every ``span`` levels.
    """
    levels = [(low, min(low + span, height)) for low in range(0, height, span)]
    existing = [Subtree(leaves, low, top, 0).whole() for low, top in levels]
    desired = [Subtree(leaves, low, top, 1) for low, top in levels[:-1]]
    for i in range(len(leaves)):
        path = []
        for level in range(height):
            at = i >> level
            node = existing[level // span].nodes[level, at ^ 1]
            path.append("" if node is None else (LEFT if at & 1 else RIGHT) + node.decode())
        yield path
        for k, (low, top) in enumerate(levels[:-1]):
            desired[k].grow(2)
            if (i + 1) % (1 << top) == 0:
                existing[k], desired[k] = desired[k], Subtree(leaves, low, top, ((i + 1) >> top) + 1)


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and a path lead to."""
    node = leaf.encode()
    for sibling in path:
        other = sibling[1:].encode()
        node = combine(other, node) if sibling[:1] == LEFT else combine(node, other)
    return node.decode()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields; a field is cast to text, so integers are decimal."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def placed(rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``at``, the place in its run from 0, and ``n``, the rows of the run.

    Sorted ranges are written with their own numbering and counted; only one row for each range and run is summed up.
    """
    spark = rows.sparkSession
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    keys = [run, *order]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n_ranges, *keys, "__tie").sortWithinPartitions(*keys, "__tie")
    ranged = materialize(ranged.drop("__tie").withColumn("__no", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("__range", F.shiftright("__no", 33))
    sizes = ranged.groupBy(run, "__range").agg(F.min("__no").alias("__first"), F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(run).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(run, "__range", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(run)).alias("n"))
    return ranged.join(sizes, [run, "__range"]).withColumn("at", F.col("__before") + F.col("__no") - F.col("__first")).drop("__no", "__range", "__first", "__before")


def _ordered(block: pa.Table, most: int) -> tuple[pa.Table, list[bytes], int]:
    """The rows of a block in order, their digests, and the block's height."""
    block = block.sort_by("at")
    n = block.column("n")[0].as_py()
    return block, [d.encode() for d in block.column("digest").to_pylist()], min(most, height_of(n))


def block_roots(nodes: DataFrame, most: int = BLOCK_HEIGHT) -> DataFrame:
    """``run, n, at, digest`` of the tree above the blocks of ``nodes``, which have the same columns."""

    def root(block: pa.Table) -> pa.Table:
        first, leaves, height = _ordered(block, most)
        n = first.column("n")[0].as_py()
        at = first.column("at")[0].as_py() >> most
        return pa.table({"run": first.column("run")[:1], "n": pa.array([-(-n >> most)], pa.int64()), "at": pa.array([at], pa.int64()), "digest": [root_of(leaves, height).decode()]})

    given = nodes.select("run", "n", "at", "digest").withColumn("block", F.shiftright("at", most))
    return given.groupBy("run", "block").applyInArrow(root, "run string, n bigint, at bigint, digest string")


def traversed(nodes: DataFrame, upper: DataFrame, emit: Callable[[pa.Table, Iterator[list[str]], dict], pa.Table], schema: str, most: int = BLOCK_HEIGHT) -> DataFrame:
    """``emit(rows of a block in order, their paths inside it, the block's row of upper)`` for every block."""

    def run(block: pa.Table, above: pa.Table) -> pa.Table:
        rows, leaves, height = _ordered(block, most)
        return emit(rows, paths(leaves, height), above.to_pylist()[0])

    right = upper.withColumnRenamed("at", "block").groupBy("run", "block")
    return nodes.withColumn("block", F.shiftright("at", most)).groupBy("run", "block").cogroup(right).applyInArrow(run, schema)


def proofs(nodes: DataFrame, most: int = BLOCK_HEIGHT) -> DataFrame:
    """``run, at, path, root`` for every node of ``run, n, at, digest``, a written table; as deep as blocks of blocks go."""

    def emit(rows: pa.Table, inside: Iterator[list[str]], above: dict) -> pa.Table:
        whole = [p + above["path"] for p in inside]
        return pa.table({"run": rows.column("run"), "at": rows.column("at"), "path": pa.array(whole, pa.list_(pa.string())), "root": [above["root"]] * len(whole)})

    return materialize(traversed(nodes, above(nodes, most), emit, "run string, at bigint, path array<string>, root string", most), "proofs")


def above(nodes: DataFrame, most: int = BLOCK_HEIGHT) -> DataFrame:
    """``run, at, path, root`` of the blocks over ``nodes``: the path that follows the one inside the block."""
    tops = materialize(block_roots(nodes, most), "block-roots")
    if (tops.agg(F.max("at")).first()[0] or 0) == 0:
        return tops.select("run", "at", F.array().cast("array<string>").alias("path"), F.col("digest").alias("root"))
    return proofs(tops, most)


def with_upper(leaves: DataFrame, most: int = BLOCK_HEIGHT) -> DataFrame:
    """``run, at, path, subroot, root`` for every block of leaves; the path leads through the subroot to the root."""
    inner = above(leaves, most)
    subroots = materialize(inner.where("at = 0").select(F.lit("").alias("one"), F.col("run").alias("of"), F.col("root").alias("digest")), "subroots")
    tree = materialize(placed(subroots, "one", ["of"]).withColumnRenamed("one", "run"), "subroots-placed")
    outer = tree.join(proofs(tree, most).select("run", "at", "path", "root"), ["run", "at"]).select(F.col("of").alias("run"), F.col("path").alias("rest"), F.col("root").alias("whole"))
    joined = inner.join(outer, "run")
    return joined.select("run", "at", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("whole").alias("root"))


def leaves_of(documents: DataFrame, carried: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, run: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``run, n, at, id, digest`` and ``carried`` for every row. A null run sorts before all others, which sort bytewise."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{run}`").cast("string")), F.lit("-"))
    rows = documents.select(key.alias("run"), F.col(f"`{id_col}`").alias("id"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), *[c.alias(name) for name, c in (carried or {}).items()])
    return materialize(placed(materialize(rows, "leaves"), "run", ["id", "digest"]), "leaves-placed")


def manifest(documents: DataFrame, fields: Sequence[str] = FIELDS, run: str = "lang", id_col: str = "doc_id", most: int = BLOCK_HEIGHT) -> DataFrame:
    """``id, leaf, path, subroot, root`` of every row; :func:`fold` leads from a leaf by its path to the root."""
    leaves = leaves_of(documents, fields=fields, run=run, id_col=id_col)

    def emit(rows: pa.Table, inside: Iterator[list[str]], upper: dict) -> pa.Table:
        whole = [p + upper["path"] for p in inside]
        return pa.table({"id": rows.column("id"), "leaf": rows.column("digest"), "path": pa.array(whole, pa.list_(pa.string())), "subroot": [upper["subroot"]] * len(whole), "root": [upper["root"]] * len(whole)})

    return traversed(leaves, with_upper(leaves, most), emit, f"id {dict(leaves.dtypes)['id']}, leaf string, path array<string>, subroot string, root string", most)


def manifest_digest(documents: DataFrame, most: int = BLOCK_HEIGHT) -> DataFrame:
    """Leaves, roots and paths of documents, and the roots that tampered rows lead to.

    Where 7 divides the CRC-32 of an id, a copy of the row with one character more is folded in place of the row; a null
    id or a null ``n_chars`` is left as it is.
    """
    more = [F.col(f) if f != "n_chars" else (F.col(f).cast("decimal(38,0)") + 1).cast("string") for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = leaves_of(documents, {"tampered": F.when(hit & F.col("n_chars").isNotNull(), leaf(more))})

    def emit(rows: pa.Table, inside: Iterator[list[str]], upper: dict) -> pa.Table:
        found, folded = [], []
        for own, other, path in zip(rows.column("digest").to_pylist(), rows.column("tampered").to_pylist(), inside, strict=True):
            path += upper["path"]
            found.append(hashlib.sha256("".join(s[1:] for s in path).encode()).hexdigest())
            folded.append(fold(other or own, path))
        n = len(found)
        return pa.table({
            "doc_id": rows.column("id"), "leaf": rows.column("digest"), "subroot": [upper["subroot"]] * n, "root": [upper["root"]] * n,
            "proof_sha256": found, "folded_root": folded, "verified": [f == upper["root"] for f in folded],
        })

    kind = dict(leaves.dtypes)["id"]
    return traversed(leaves, with_upper(leaves, most), emit, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", most)

"""Byte-level BPE over padded numpy matrices.

Every match of the splitting pattern is a piece. Pieces are bucketed by length into padded matrices of token ids, the
buckets doubling in width as far as the longest piece needs; in each round every row merges its leftmost pair of least
rank, found by hashed pair lookup, and rows that are done leave the matrix (compaction). In wide matrices a round takes
every place of a row at which the pair of least rank stands, from the left and without overlaps, as those are the
merges that follow each other anyway, unless one of them makes a pair of lesser rank. Workers keep the ids of pieces
they have met, up to a bounded number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

NONE = np.int32(2**31 - 1)
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Pieces that a worker remembers, rows of one matrix, and cells of one wider than the widest of these.
REMEMBERED, MATRIX_ROWS, MATRIX_CELLS = 400_000, 65_536, 1_000_000


class PairTable:
    """Open addressing from a pair of ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        keys, values = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, 2**64 - 1, dtype=np.uint64)
        self.values = np.full(1 << bits, NONE, dtype=np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == 2**64 - 1
            at, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; a negative id is padding and has none."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[todo].astype(np.uint64) << np.uint64(32) | right.ravel()[todo].astype(np.uint64)
        slot, flat = self._slot(keys), out.ravel()
        while len(todo):
            found = self.keys[slot]
            hit = found == keys
            flat[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != 2**64 - 1)
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return flat.reshape(left.shape)


class Codec:
    """Encodes and decodes whole texts by a rank file and a splitting pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.token_ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: t for t, i in self.token_ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.of_byte = np.array([self.token_ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(self.token_ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def _merge_matrix(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.of_byte[raw], np.int32(-1))
        rank = np.concatenate([self.pairs.ranks(ids[:, :-1], ids[:, 1:]), np.full((len(ids), 1), NONE)], axis=1).astype(np.int32)
        where, out = np.arange(len(pieces)), [()] * len(pieces)
        columns = np.arange(width)
        while len(where):
            rows = np.arange(len(where))
            at = rank.argmin(axis=1)
            least = rank[rows, at]
            done = least == NONE
            if done.any():
                for k, row, length in zip(where[done].tolist(), ids[done].tolist(), n[done].tolist(), strict=True):
                    out[k] = tuple(row[:length])
                go = ~done
                where, ids, rank, n, at, least = where[go], ids[go], rank[go], n[go], at[go], least[go]
                if not len(where):
                    break
                width = int(n.max())
                ids, rank, columns, rows = ids[:, :width], rank[:, :width], columns[:width], np.arange(len(where))
            # The pair becomes one id; what stands right of it moves left by one place.
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, take, axis=1), np.take_along_axis(rank, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            n = n - 1
            ids[rows, at] = least
            past = columns >= n[:, None]
            ids[past] = -1
            rank[columns >= n[:, None] - 1] = NONE
            before = np.maximum(at - 1, 0)
            rank[rows, before] = np.where(at > 0, self.pairs.ranks(ids[rows, before], ids[rows, at]), rank[rows, before])
            after = np.minimum(at + 1, width - 1)
            rank[rows, at] = np.where(at + 1 < n, self.pairs.ranks(ids[rows, at], ids[rows, after]), NONE)
        return out

    def _merge_wide(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """As :meth:`_merge_matrix`, with all merges of a row's least rank in one round."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.of_byte[raw], np.int32(-1))
        rank = np.full(ids.shape, NONE, dtype=np.int32)
        rank[:, :-1] = self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        where, out = np.arange(len(pieces)), [()] * len(pieces)
        while len(where):
            least = rank.min(axis=1)
            if (done := least == NONE).any():
                for k, row, length in zip(where[done].tolist(), ids[done], n[done].tolist(), strict=True):
                    out[k] = tuple(row[:length].tolist())
                where, ids, rank, n, least = (x[~done] for x in (where, ids, rank, n, least))
                continue
            # In a run of such pairs every second one goes, as the others lose their left half.
            columns, at = np.arange(ids.shape[1]), rank == least[:, None]
            begins = at & ~np.pad(at[:, :-1], ((0, 0), (1, 0)))
            run = np.maximum.accumulate(np.where(begins, columns, 0), axis=1)
            row, column = np.nonzero(at & ((columns - run) % 2 == 0))
            # A merge whose new pairs have a lesser rank ends the round of its row, as that pair is next.
            padded = np.pad(ids, ((0, 0), (1, 2)), constant_values=-1)
            after_merge = np.concatenate([[False], (row[1:] == row[:-1]) & (column[1:] == column[:-1] + 2)])
            before = np.where(after_merge, least[row], padded[row, column])
            lesser = (self.pairs.ranks(before, least[row]) < least[row]) | (self.pairs.ranks(least[row], padded[row, column + 3]) < least[row])
            if lesser.any():
                last = np.full(len(where), ids.shape[1])
                np.minimum.at(last, row[lesser], column[lesser])
                row, column = row[column <= last[row]], column[column <= last[row]]
            ids[row, column] = least[row]
            merged, keep = np.zeros(ids.shape, dtype=bool), columns < n[:, None]
            merged[row, column] = True
            keep[row, column + 1] = False
            # What is kept moves left; only pairs beside a merge get new ranks.
            place, n = np.cumsum(keep, axis=1) - 1, keep.sum(axis=1)
            shape = (len(where), int(n.max()))
            old_row, old_column = np.nonzero(keep)
            new_column = place[old_row, old_column]
            kept = []
            for values, fill in ((ids, -1), (rank, NONE), (merged, False)):
                moved = np.full(shape, fill, dtype=values.dtype)
                moved[old_row, new_column] = values[old_row, old_column]
                kept.append(moved)
            ids, rank, merged = kept
            row, column = np.nonzero(merged | np.pad(merged[:, 1:], ((0, 0), (0, 1))))
            rank[row, column] = self.pairs.ranks(ids[row, column], np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)[row, column + 1])
        return out

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of all ``pieces`` where :meth:`encode_all` finds them."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        buckets: dict[int, list[str]] = {}
        for piece in pieces - self.known.keys():
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.token_ranks.get(raw)) is not None:
                self.known[piece] = (whole,)
            else:
                width = next((w for w in WIDTHS if len(raw) <= w), 1 << (len(raw) - 1).bit_length())
                buckets.setdefault(width, []).append(piece)
        for width, group in buckets.items():
            merge, rows = (self._merge_matrix, MATRIX_ROWS) if width <= WIDTHS[-1] else (self._merge_wide, max(1, MATRIX_CELLS // width))
            for i in range(0, len(group), rows):
                part = group[i : i + rows]
                self.known.update(zip(part, merge([p.encode("utf-8", "surrogatepass") for p in part], width), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; pieces are learnt over runs of texts of a bounded length."""
        i = 0
        while i < len(texts):
            size, found = 0, []
            while i < len(texts) and (not found or size < 4_000_000):
                found.append(self.find(texts[i]))
                size += len(texts[i])
                i += 1
            self.learn(set().union(*found))
            known = self.known
            for pieces in found:
                yield [x for p in pieces for x in known[p]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """The worker's codec for these files, built once."""
    key = (rank_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` array<int> of every whole text; a null text is empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            ids = list(c.encode_all([t or "" for t in b.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the ``decoded`` bytes of every list of ids; a null list decodes to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def encode_digest(documents: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document the number and digest of its ids and the digest of the bytes they decode to.

    Encodes, digests and decodes in one pass, so that ids never leave the worker. Null and empty texts have no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file, pattern)
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in c.encode_all([t or "" for t in b.column(1).to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

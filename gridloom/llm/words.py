"""Words of whole texts as arrays: where each begins and ends, and a hash of each, made by numpy from the bytes.

What a word is depends on single bytes, as all separators are ASCII: bytes of characters beyond it belong to words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled together up to so many bytes; a longer one is handled alone.
CHUNK = 1 << 20
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of words between white space, and of words of letters and digits, read in lower case.
SPACED = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
ALPHANUMERIC = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, as many as a chunk has bytes."""
    out = np.full((2, CHUNK), 1, dtype=np.uint64)
    out[0, 1:], out[1, 1:] = _BASE, pow(_BASE, -1, 2**64)
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


class Words:
    """The words of some texts: lowered bytes, where each word starts and ends, its hash, and the words of each text."""

    def __init__(self, texts: pa.Array, inside: np.ndarray = ALPHANUMERIC, lower: bool = True):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        self.data = _LOWER[data] if lower else data
        values = np.where(inside, _BYTE, np.uint64(0))
        inside = np.concatenate([[False], inside[self.data], [False]])
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[ends] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        self.firsts = np.searchsorted(self.starts, ends)  # of each text, and one more
        self.hashes = np.empty(len(self.starts), dtype=np.uint64)
        up, down = powers()
        i = 0
        while i < len(self.starts):
            low = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, low + CHUNK, side="right")))
            if self.ends[i] - low > CHUNK:  # one word of several pieces
                pieces = range(low, int(self.ends[i]), CHUNK)
                sums = [(values[self.data[p : min(p + CHUNK, self.ends[i])]] * up[: min(CHUNK, self.ends[i] - p)]).sum() for p in pieces]
                self.hashes[i] = sum(int(v) * pow(_BASE, p - low, 2**64) for v, p in zip(sums, pieces, strict=True)) % 2**64
            else:
                high, at = self.ends[j - 1], self.starts[i:j] - low
                self.hashes[i:j] = np.add.reduceat(values[self.data[low:high]] * up[: high - low], at) * down[at]
            i = j
        self.hashes = mix(self.hashes)  # else words and runs of words would be sums of the same powers
        self.last = np.repeat(self.firsts[1:], np.diff(self.firsts))  # end of the text of each word

    def text(self, first: int, n: int) -> bytes:
        """``n`` words joined by one space."""
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True)])

    def runs(self, low: int, high: int, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words that start from ``low`` to ``high``."""
        return self._run([self.hashes[low + j : high + j] for j in range(n)])

    def runs_at(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of ``n`` words that start at the words ``at``."""
        return self._run([self.hashes[at + j] for j in range(n)])

    def _run(self, parts: list[np.ndarray]) -> np.ndarray:
        odd = powers()[0][1::2]
        total = parts[0] * odd[0]
        for h, x in zip(parts[1:], odd[1:], strict=False):
            total = total + h * x
        return mix(total + np.uint64(len(parts)))

    def segments(self, size: int = CHUNK // 4) -> Iterator[tuple[int, int]]:
        """Ranges of words, so that what is made of a long text needs no more memory than of a short one."""
        return ((i, i + size) for i in range(0, len(self.hashes), size))


def chunks(texts: pa.Array, inside: np.ndarray = ALPHANUMERIC, lower: bool = True) -> Iterator[Words]:
    """The words of a column of texts (or their bytes), several texts at a time up to ``CHUNK`` bytes."""
    sizes = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + CHUNK, side="right")) - 1)
        yield Words(texts.slice(i, j - i), inside, lower)
        i = j

"""Main text of web pages by a recurrent block labeller.

A page is read as its sequence of leaf blocks. Each block gives a vector: hashed marks of its tag path (element names,
classes, ids, roles), hashed words, and a few measures of its text. A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or not, so a block is judged by all that stands around it. The model is
trained in one Spark task on ``PRACTICE_PAGES`` practice pages of known labels, from fixed seeds, in some seconds.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.html_blocks import READ, Block, blocks, practice_page

PATH, WORDS, MEASURES, HIDDEN = 128, 32, 8, 20
PRACTICE_PAGES, EPOCHS, BATCH, GROUP = 1600, 8, 64, 64
#: Words that a worker remembers the place of.
REMEMBERED = 500_000
_PLACES: dict[str, int] = {}


def _place(word: str) -> int:
    place = _PLACES.get(word)
    if place is None:
        if len(_PLACES) > REMEMBERED:
            _PLACES.clear()
        place = _PLACES[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
    return place


_PATHS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Each name of the path that is read sets two places; the last four set places of their own kind too."""
    found = _PATHS.get(path)
    if found is None:
        found = np.zeros(PATH, dtype=np.float32)
        path_read = [m for m in path if m in READ]
        for mark in {*path_read, *(f"<{m}" for m in path_read[-4:])}:
            h = zlib.crc32(mark.encode())
            found[h % PATH] = 1
            found[(h >> 12) % PATH] = 1
        if len(_PATHS) < 50_000:
            _PATHS[path] = found
    return found


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), PATH + WORDS + MEASURES), dtype=np.float32)
    for i, b in enumerate(page):
        words = b.text.lower().split(" ")
        out[i, :PATH] = _path_vector(b.path)
        out[i, PATH : PATH + WORDS] = np.bincount(np.fromiter(map(_place, words), dtype=np.int64, count=len(words)), minlength=WORDS) / len(words)
        n = len(b.text)
        out[i, PATH + WORDS :] = (
            min(1.0, np.log1p(n) / 8), min(1.0, np.log1p(len(words)) / 6), min(1.0, b.linked / n), min(1.0, 4 * (b.text.count(".") + b.text.count(",")) / len(words)),
            float(b.text[-1] in ".!?"), min(1.0, i / 20), min(1.0, (len(page) - 1 - i) / 20), min(1.0, len(b.path) / 12),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(p) for p in pages])
    x = np.zeros((int(n.max()), len(pages), pages[0].shape[1]), dtype=np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j] = p
    return x, np.arange(len(x))[:, None] < n


def _forward(x: np.ndarray, live: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction; rows past a page's end leave its state as it is (zero, for the direction that starts there)."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    given = (x.reshape(steps * batch, -1) @ w + b).reshape(steps, batch, 4 * size)
    h, c, out, tape = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32), np.zeros((steps, batch, size), np.float32), []
    for t in range(steps):
        gates = given[t] + h @ u
        i, f, o = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in range(3))
        g = np.tanh(gates[:, 3 * size :])
        m = live[t][:, None]
        c_new = np.where(m, f * c + i * g, c)
        tc = np.tanh(c_new)
        h_new = np.where(m, o * tc, h)
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = h_new.astype(np.float32), c_new.astype(np.float32)
        out[t] = h
    return out, tape


def _backward(d_out: np.ndarray, x: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, batch, size = d_out.shape
    d_gates = np.zeros((steps, batch, 4 * size), np.float32)
    d_u, d_h, d_c = np.zeros_like(u), np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tc, m = tape[t]
        total = d_h + d_out[t]
        inner = np.where(m, total, 0)
        d_cell = np.where(m, d_c, 0) + inner * o * (1 - tc * tc)
        d_gates[t] = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), inner * tc * o * (1 - o), d_cell * i * (1 - g * g)], axis=1)
        d_u += h.T @ d_gates[t]
        d_h = np.where(m, 0, total) + d_gates[t] @ u.T
        d_c = np.where(m, d_cell * f, d_c)
    flat = d_gates.reshape(steps * batch, -1)
    return x.reshape(steps * batch, -1).T @ flat, d_u, flat.sum(axis=0)


class Labeller:
    """Weights: for each direction the input, the recurrent part and the bias; then the output's."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, seed: int = 5) -> Labeller:
        rng = np.random.default_rng(seed)
        inputs = PATH + WORDS + MEASURES
        weights: list[np.ndarray] = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            weights += [rng.normal(0, inputs**-0.5, (inputs, 4 * HIDDEN)).astype(np.float32), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32), bias]
        return cls([*weights, rng.normal(0, 0.2, (2 * HIDDEN + inputs, 1)).astype(np.float32), np.zeros(1, np.float32)])

    def _read(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        ahead, tape_a = _forward(x, live, *self.weights[:3], keep)
        behind, tape_b = _forward(x[::-1], live[::-1], *self.weights[3:6], keep)
        joined = np.concatenate([ahead, behind[::-1], x], axis=2)
        return _sigmoid(joined @ self.weights[6] + self.weights[7])[:, :, 0], joined, tape_a, tape_b

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for k in range(0, len(order), BATCH):
                chosen = order[k : k + BATCH]
                x, live = _padded([pages[j] for j in chosen])
                y = np.zeros(live.shape, np.float32)
                for column, j in enumerate(chosen):
                    y[: len(labels[j]), column] = labels[j]
                p, joined, tape_a, tape_b = self._read(x, live, keep=True)
                d = np.where(live, p - y, 0).astype(np.float32)[:, :, None] / live.sum()
                d_joined = d @ self.weights[6].T
                grads = [*_backward(d_joined[:, :, :HIDDEN], x, self.weights[1], tape_a), *_backward(d_joined[::-1, :, HIDDEN : 2 * HIDDEN], x[::-1], self.weights[4], tape_b)]
                grads += [joined.reshape(-1, joined.shape[2]).T @ d.reshape(-1, 1), d.sum(axis=(0, 1))]
                scale = min(1.0, 1 / (1e-9 + np.sqrt(sum(float((g * g).sum()) for g in grads))))
                step += 1
                for n, g in enumerate(grads):
                    first[n] = 0.9 * first[n] + 0.1 * g * scale
                    second[n] = 0.99 * second[n] + 0.01 * (g * scale) ** 2
                    self.weights[n] = (self.weights[n] - rate * 0.75**epoch * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page the probability of each block to be main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((j for j in range(len(pages)) if len(pages[j])), key=lambda j: len(pages[j]))
        for k in range(0, len(order), GROUP):
            chosen = order[k : k + GROUP]
            x, live = _padded([pages[j] for j in chosen])
            p = self._read(x, live)[0]
            for column, j in enumerate(chosen):
                out[j] = p[: len(pages[j]), column]
        return out

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, *self.weights)
        return to.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Labeller:
        found = np.load(io.BytesIO(raw))
        return cls([found[f"arr_{i}"] for i in range(8)])


def practice(first: int, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    xs, ys = [], []
    for seed in range(first, first + n):
        page, labels = practice_page(seed)
        found = blocks(page)
        if len(found) == len(labels):
            xs.append(vectors(found))
            ys.append(np.array(labels, np.float32))
    return xs, ys


_TRAINED: dict[str, bytes] = {}


def trained(spark: SparkSession) -> bytes:
    """The weights, trained in one task and kept for the application; some 150 KB."""
    app = spark.sparkContext.applicationId
    if app not in _TRAINED:

        def run(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Labeller.fresh()
            model.train(*practice(0, PRACTICE_PAGES))
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["weights"])

        _TRAINED[app] = spark.range(0, 1, 1, 1).mapInArrow(run, "weights binary").first()[0]
    return _TRAINED[app]


def main_text(page: list[Block], scores: np.ndarray) -> str:
    return "\n".join(b.text for b, s in zip(page, scores, strict=True) if s >= 0.5)


def extract(df: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """Columns ``keep`` and the main ``text`` of each page; a null or empty page has an empty text."""
    weights = trained(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller.load(weights)
        for b in batches:
            texts: list[str] = []
            pages = b.column(b.num_columns - 1).to_pylist()
            for k in range(0, len(pages), 512):
                found = [blocks(p or "") for p in pages[k : k + 512]]
                texts += [main_text(p, s) for p, s in zip(found, model.scores([vectors(p) for p in found]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    given = df.select(*[F.col(f"`{c}`") for c in keep if c != "text"], F.col(html_col).alias("__html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, (kept + ", " if kept else "") + "text string")


def page_digest(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("bigint"))

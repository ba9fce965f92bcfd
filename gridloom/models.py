"""What models do, behind functions that are plugged in: reshaping rows, reading pages, embedding and answering.

No model is part of the library. A function is given plain Python values and runs in the tasks, batch by batch, so any
client or local model will do; it must be picklable. A batch that fails is left out or marked, and fails no job.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.neighbours import VectorIndex

#: Rows that a model reshapes at a time, and characters of a cell that it is shown; chunks that an answer rests on.
BATCH, CELL, NEAREST = 12, 300, 6
WORDS = "path string, page int, text string, conf double, left int, top int, line_num int, block_num int"


def reshaped_by(df: DataFrame, wanted: list[str], model: Callable[[list[dict], list[str]], list[dict]], batch: int = BATCH, cell: int = CELL) -> DataFrame:
    """Rows of exactly the ``wanted`` columns, as texts, that ``model(rows, wanted)`` makes of ``batch`` rows at a time.

    Cells are cut to ``cell`` characters. A batch for which the model fails or gives no list of rows is left out; of its
    rows, columns that aren't wanted are dropped and missing ones are empty.
    """
    cut = df.select(*[F.left(F.col(f"`{c}`").cast("string"), F.lit(cell)).alias(c) for c in df.columns])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
            out = []
            for i in range(0, len(rows), batch):
                try:
                    made = model(rows[i : i + batch], wanted)
                    out += [["" if r.get(w) is None else str(r[w]) for w in wanted] for r in made]
                except Exception:  # noqa: BLE001, S112  whatever a model does wrong costs its batch only
                    continue
            yield pd.DataFrame(out, columns=wanted)

    return cut.mapInPandas(run, ", ".join(f"`{w}` string" for w in wanted))


def rows_of_reply(reply: str) -> list[dict]:
    """The rows in a model's reply: a JSON list, or an object that holds one, with or without a fence around it."""
    body = reply.strip().removeprefix("```json").removeprefix("```").removesuffix("```")
    found = json.loads(body)
    if isinstance(found, dict):
        found = next(v for v in found.values() if isinstance(v, list))
    if not all(isinstance(r, dict) for r in found):
        raise ValueError("a row is no object")
    return found


def read_pages(files: DataFrame, reader: Callable[[bytes], list[list[dict]]]) -> DataFrame:
    """Word boxes of scanned files (``path, content``), as :mod:`gridloom.operators.ocr` takes them.

    ``reader`` gives for each page its words with ``text, conf, left, top, line_num, block_num``. A file that it can't
    read has one row without a text on page 0.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WORDS.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, page, *(w[n] for n in names[2:])) for page, words in enumerate(reader(bytes(content)), 1) for w in words]
                except Exception:  # noqa: BLE001
                    rows = [(path, 0, None, None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda d: d.notna(), None)

    return files.select("path", "content").mapInPandas(run, WORDS)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "chunk", name: str = "embedding", batch: int = 64) -> DataFrame:
    """``chunks`` with ``name``, the vector of unit length that ``embed`` gives for the text; null for a null text or a zero vector."""
    kept = [c for c in chunks.columns if c != name]

    def unit(v: list[float]) -> list[float] | None:
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v] if size else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, found = frame[text_col].tolist(), [None] * len(frame)
            some = [i for i, t in enumerate(texts) if t is not None]
            for k in range(0, len(some), batch):
                for i, v in zip(some[k : k + batch], embed([texts[i] for i in some[k : k + batch]]), strict=True):
                    found[i] = unit([float(x) for x in v])
            yield frame[kept].assign(**{name: pd.Series(found, index=frame.index, dtype=object)})

    schema = ", ".join(f"`{n}` {t}" for n, t in chunks.select(*[f"`{c}`" for c in kept]).dtypes)
    return chunks.select(*[f"`{c}`" for c in kept]).mapInPandas(run, f"{schema}, `{name}` array<double>")


def grounded(questions: DataFrame, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], generate: Callable[[str, list[str]], str], k: int = NEAREST, probes: int | None = None) -> DataFrame:
    """``question_id, question, answer, sources`` for many questions (``question_id, question``) over embedded chunks
    (``chunk_id, chunk, embedding``).

    Each question's ``k`` nearest chunks are found through an index of cells, and ``generate(question, chunks)`` answers
    from them alone, nearest first. Without a chunk, or if ``generate`` fails, the answer is null.
    """
    asked = embedded(questions, embed, "question", "embedding")
    vectors = chunks.select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("id"), F.col("embedding").alias("v"))
    wanted = asked.select(F.concat(F.lit("q"), F.col("question_id").cast("string")).alias("id"), F.col("embedding").alias("v"))
    near = VectorIndex(vectors, "id", "v").nearest(wanted, k, probes)
    texts = near.join(chunks.select(F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("id"), "chunk_id", "chunk"), "id")
    context = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk", F.col("chunk_id").cast("string").alias("source")))).alias("near"))  # ``k`` rows
    joined = questions.withColumn("query_id", F.concat(F.lit("q"), F.col("question_id").cast("string"))).join(context, "query_id", "left")
    given = joined.select("question_id", "question", F.transform("near", lambda x: x["chunk"]).alias("context"), F.transform("near", lambda x: x["source"]).alias("sources"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = []
            for question, context in zip(frame["question"], frame["context"], strict=True):
                try:
                    answers.append(generate(question, list(context)) if context is not None and question is not None else None)
                except Exception:  # noqa: BLE001
                    answers.append(None)
            yield pd.DataFrame({"question_id": frame["question_id"], "question": frame["question"], "answer": pd.Series(answers, index=frame.index, dtype=object), "sources": frame["sources"]})

    kind = dict(questions.dtypes)["question_id"]
    return given.mapInPandas(run, f"question_id {kind}, question string, answer string, sources array<string>")

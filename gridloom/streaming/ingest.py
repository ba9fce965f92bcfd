"""Files that arrive, cut into chunks and committed once: a stream that may be killed at any point.

A batch writes the chunks of its files to a folder of its own and then commits: a small table, named by the batch, that
lists the files with their content keys. Chunks count only if their batch is committed, and of a file only those of its
last committed batch, so a batch that is run again after a kill puts each chunk there once, and a file that arrives again
replaces its earlier chunks. A file is known by its name; a later state of it arrives in a folder of its own, as a stream
reads no path twice. Nothing is looked up or locked while writing, and any number of files goes in one batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.retrieval import OVERLAP, SIZE, chunks
from gridloom.streaming import jobs

CHUNKS = "file string, content_key string, chunk_no int, chunk string, batch bigint"
COMMITS = "file string, content_key string, n_chunks bigint, batch bigint"


def batch_writer(folder: str, size: int = SIZE, overlap: int = OVERLAP) -> Callable[[DataFrame, int], None]:
    """Writes a batch of arrived files (:func:`jobs.file_arrivals`) into ``folder`` and commits it.

    Texts are read as UTF-8, other bytes replaced; a blank one has no chunk, and a file of no bytes isn't seen by Spark's
    file sources at all. Of a file that is in a batch twice the later state counts.
    """

    def write(arrived: DataFrame, batch: int) -> None:
        named = arrived.withColumn("file", F.element_at(F.split("path", "/"), -1))
        last = named.groupBy("file").agg(F.max_by(F.struct("content", "content_key"), F.struct("modificationTime", "path")).alias("f")).select("file", "f.*")
        texts = last.select("file", "content_key", F.expr("make_valid_utf8(cast(content as string))").alias("text"))
        cut = chunks(texts, "file", "text", size, overlap).join(texts.select("file", "content_key"), "file")
        cut.select("file", "content_key", "chunk_no", "chunk").write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch}")
        written = arrived.sparkSession.read.schema("file string, content_key string, chunk_no int, chunk string").parquet(f"{folder}/chunks/batch={batch}")
        commit(texts, written, f"{folder}/commits/batch={batch}")

    return write


def commit(texts: DataFrame, written: DataFrame, path: str) -> None:
    """Lists the files of a batch, also those without a chunk, with the chunks that were written."""
    n = written.groupBy("file").agg(F.count("*").alias("n_chunks"))
    texts.select("file", "content_key").join(n, "file", "left").na.fill({"n_chunks": 0}).write.mode("overwrite").parquet(path)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """``file, content_key, n_chunks, batch`` of the last committed batch of each file."""
    log = spark.read.schema(COMMITS).option("basePath", f"{folder}/commits").parquet(f"{folder}/commits")
    return log.groupBy("file").agg(F.max_by(F.struct("content_key", "n_chunks", "batch"), "batch").alias("c")).select("file", "c.*")


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that count, ``file, content_key, chunk_no, chunk``."""
    written = spark.read.schema(CHUNKS).option("basePath", f"{folder}/chunks").parquet(f"{folder}/chunks")
    return written.join(committed(spark, folder).select("file", "batch"), ["file", "batch"], "left_semi").drop("batch")


def ingest(spark: SparkSession, source: str, folder: str, pattern: str = "*") -> None:
    """Takes in what has arrived in ``source`` since the last run, and ends."""
    jobs.drain(jobs.file_arrivals(spark, source, pattern, below=True), batch_writer(folder), f"{folder}/state").awaitTermination()


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Copies what counts to a new folder as one committed batch, for a stream of its own to go on from."""
    current_chunks(spark, folder).write.mode("overwrite").parquet(f"{into}/chunks/batch=-1")
    committed(spark, folder).drop("batch").write.mode("overwrite").parquet(f"{into}/commits/batch=-1")

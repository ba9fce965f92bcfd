"""The log of interactions, ingestions and feedback, the jobs, and the file registry, all append-only."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """id string, timestamp string, type string, session_id string, file_id string, intent string, sink string, filename string, success boolean, error string,
    latency_sec double, prompt string, response string, messages array<struct<role:string,content:string>>, content_hash string, interaction_id string, rating string, notes string,
    original_filename string, extension string, kind string, tables_found int"""


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def record(kind: str, **fields) -> dict:
    """A log record of one of the kinds interaction, ingestion and feedback."""
    out = {"id": uuid.uuid4().hex[:8], "timestamp": time.strftime("%Y-%m-%d %H:%M:%S"), "type": kind, **fields}
    if kind == "interaction":
        note = ", ".join(f"{k}={out[k]}" for k in ("intent", "sink", "filename") if out.get(k))
        out["messages"] = [{"role": "system", "content": note}, {"role": "user", "content": out.get("prompt", "")}, {"role": "assistant", "content": out.get("response", "")}]
    if out.get("latency_sec") is not None:
        out["latency_sec"] = round(out["latency_sec"], 2)
    return out


def append(spark: SparkSession, records: list[dict], path: str) -> None:
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(1)
    lines.write.mode("append").text(path)


def uploads(log: DataFrame) -> DataFrame:
    return log.where("type = 'ingestion'")


def collisions(log: DataFrame) -> DataFrame:
    """Ingestions of a file id that has had different contents; null hashes count for nothing."""
    files = uploads(log)
    ids = files.groupBy("file_id").agg(F.count_distinct("content_hash").alias("n")).where("n > 1").select("file_id")
    return files.join(ids, "file_id", "left_semi").orderBy("file_id", "timestamp", "id")


def failures(log: DataFrame) -> DataFrame:
    """Interactions that failed or were rated badly, each once."""
    turns = log.where("type = 'interaction'")
    bad = log.where("type = 'feedback' and rating in ('bad', 'wrong_intent')").select(F.col("interaction_id").alias("id")).distinct()
    flagged = turns.join(bad, "id", "left_semi").withColumn("source", F.lit(1))
    errored = turns.where("success = false").withColumn("source", F.lit(0))
    first = Window.partitionBy("id").orderBy("source", "timestamp")
    return errored.unionByName(flagged).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "source")


def tail(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit).orderBy("timestamp", "id")


def recent_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str, n: int = 6, length: int = 300) -> DataFrame:
    """The last ``n`` turns of each conversation, long ones cut with an ellipsis."""
    last = Window.partitionBy(conversation).orderBy(F.desc(turn))
    short = F.when(F.length(text) > length, F.concat(F.left(F.col(text), F.lit(length)), F.lit("…"))).otherwise(F.col(text))
    return turns.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= n).select(conversation, turn, role, short.alias(text))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: how the state of jobs and the registry of files is read."""
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("e")).select(key, "e.*")


def job_event(job_id: str, status: str, result: dict | None = None, error: str | None = None) -> dict:
    """A state of a job: pending, running, done or error."""
    return {"job_id": job_id, "status": status, "result": json.dumps(result) if result is not None else None, "error": error, "updated_at": time.time()}

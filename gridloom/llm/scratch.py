"""Scratch tables as the library has them, and what the training-data operators need besides."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from gridloom.scratch import delete, discard, discard_all_but, materialize, run, scratch_dir, scratch_path
from gridloom.session import ship

__all__ = ["delete", "discard", "discard_all_but", "materialize", "release", "run", "scratch_dir", "scratch_path", "ship", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that nothing refers to any more, before the next large stage writes its own."""
    gc.collect()
    spark._jvm.System.gc()

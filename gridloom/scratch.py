"""Tables written to the shared scratch folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_SCRATCH = "/tmp/checkpoints/gridloom"
_LOCAL: set[str] = set()
#: Scratch tables made and not yet discarded, by run; the frame is kept so that its id stays its own.
Tables = dict[int, tuple[DataFrame, str]]
_OUTSIDE: Tables = {}
_RUN: contextvars.ContextVar[Tables | None] = contextvars.ContextVar("gridloom_run", default=None)


def _tables() -> Tables:
    found = _RUN.get()
    return _OUTSIDE if found is None else found


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset a local one, which goes at exit.

    On a cluster a local folder would be another one on every machine, so there the setting is required.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
    own = f"{LOCAL_SCRATCH}/{spark.sparkContext.applicationId}"
    if own not in _LOCAL:
        _LOCAL.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/gridloom-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the scratch folder and reads it back: one evaluation, no lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables()[id(out)] = (out, path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for df in tables:
        if found := _tables().pop(id(df), None):
            delete(df.sparkSession, found[1])


@contextlib.contextmanager
def run() -> Iterator[None]:
    """What is written inside belongs to this run, so ``discard_all_but`` leaves the tables of other runs and threads alone."""
    before = _RUN.set({})
    try:
        yield
    finally:
        inside = _RUN.get()
        _RUN.reset(before)
        _tables().update(inside)  # the result may still read them


def discard_all_but(*kept: DataFrame) -> None:
    """Deletes every scratch table of this run but these, once a stage's result is written and reads no other."""
    names = {id(df) for df in kept}
    discard(*[df for key, (df, _) in list(_tables().items()) if key not in names])

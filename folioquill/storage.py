"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor costs only the running stage."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()  # scopes of tidy calls, per thread
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, an own one on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or f"file://{os.path.join(tempfile.gettempdir(), 'folioquill-shared')}").rstrip("/")


#: Rows of an Arrow batch while a table is written: whole texts are wide, and both sides hold a batch of each task.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most BATCH_ROWS rows for the jobs that run inside; the session's own setting is put back."""
    before = spark.conf.get(_BATCH)
    if int(before) <= 0 or int(before) > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def materialize(df: DataFrame, tag: str, keep: bool = False, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, or to a new ``path`` that stays the caller's, and read it back.

    Tables made inside a ``tidy`` function go when it returns, except those to ``keep``, which its lazy
    result still reads; those, and tables made outside, go with ``sweep`` or the folder's own retention.
    """
    spark = df.sparkSession
    own, path = path is None, path or f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    if own:
        scopes = getattr(_local, "scopes", [])
        (scopes[-1] if scopes and not keep else _kept).append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, for files that lazy results read; ``sweep`` removes it."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def tidy(f):
    """Make ``f`` (its first argument a DataFrame) remove the tables that it wrote and does not keep."""
    @functools.wraps(f)
    def run(df, *args, **kwargs):
        _local.scopes = [*getattr(_local, "scopes", []), []]
        try:
            return f(df, *args, **kwargs)
        finally:
            _delete(df.sparkSession, _local.scopes.pop())

    return run


def sweep(spark: SparkSession) -> int:
    """Remove every table that this process has kept, once their results are no longer read; returns how many."""
    paths = _kept[:]
    _delete(spark, paths)
    del _kept[: len(paths)]
    return len(paths)

"""Where operators put what several jobs read: one shared folder, never a local one."""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from typing import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Largest table, in bytes of its rows, that is broadcast after its size was measured.
BROADCAST_BYTES = 32 << 20

#: Arrow batches between Spark and Python.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the checkpoint folder set in the session; executors elsewhere couldn't read a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="lacuna-")  # one machine, one process: nobody else reads it
        spark.sparkContext.setCheckpointDir(base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def refuse_own_names(docs: DataFrame) -> None:
    """Operators name their own columns with two underscores first; input columns of such names would clash."""
    if own := [c for c in docs.columns if c.startswith("__")]:
        raise ValueError(f"columns that begin with two underscores are the operators' own: {own}")


def shielded(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage whose input may have columns with names of the stage's own: they have other names within it and come back as they were."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        own = [c for c in docs.columns if c.startswith("__")]
        if not own:
            return stage(docs, *args, **options)
        mark = "kept"
        while any(c.lower().startswith(mark) for c in docs.columns):
            mark += "x"
        names = {c: mark + c for c in own}
        asked = [names.get(a, a) if isinstance(a, str) else a for a in args]
        options = {k: names.get(v, v) if isinstance(v, str) else v for k, v in options.items()}
        out = stage(docs.withColumnsRenamed(names), *asked, **options)
        return out.withColumnsRenamed({new: c for c, new in names.items() if new in out.columns})

    return run


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lacuna-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lacuna_path = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = BATCH_BYTES):
    """Jobs that run inside exchange batches of at most about ``size`` with Python, whatever the length of the texts."""
    old = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow and the like, giving freed memory back when a task ends: workers live on between tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_lacuna_path", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written[:] = [(s, p) for s, p in _written if p != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:  # the JVM may have ended before
            return


def fits_broadcast(rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``rows`` counted rows of ``row_bytes`` may be broadcast; callers join by shuffle beyond it."""
    return rows * row_bytes <= limit

"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the session's checkpoint folder; a folder of our own only where one process does all the work."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        base = "file://" + tempfile.mkdtemp(prefix="lacuna-")
        context.setCheckpointDir(base)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written and read again; with ``by`` a part each value, so that a filter by it reads only that."""
    path = f"{shared_dir(df.sparkSession)}/lacuna-cut-{uuid.uuid4().hex}"
    _written[path] = df.sparkSession
    (df.repartition(by).write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lacuna_cut = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote; nothing may read it any more."""
    path = getattr(df, "_lacuna_cut", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before
            return

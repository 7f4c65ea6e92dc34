"""Tables between jobs, in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session has one of its own; a cluster raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/mergeloom-checkpoint"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{folder(spark)}/mergeloom-{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns what was written.

    This cuts the lineage: a later loss of an executor only repeats reads of it.
    """
    path = path or new_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that stored() wrote."""
    if path in _made:
        _made.remove(path)
    _delete(spark.sparkContext, path)


def mark() -> int:
    """A point in time for forget_since."""
    return len(_made)


def forget_since(spark: SparkSession, point: int, keep: tuple[str, ...] = ()) -> None:
    """Deletes the tables written since mark() returned point, for a caller whose results no longer read them."""
    for path in _made[point:]:
        if path not in keep:
            forget(spark, path)


def _delete(context: SparkContext, path: str) -> None:
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    """What results may still have read goes with the session; without one, only local folders can be reached."""
    context = SparkContext._active_spark_context
    for path in _made:
        if "://" not in path:
            shutil.rmtree(path, ignore_errors=True)
        elif context is not None and context._jsc is not None:
            try:
                _delete(context, path)
            except Exception:  # noqa: BLE001 - the JVM may be gone already
                return

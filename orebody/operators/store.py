"""Tables that loops write between their rounds, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def cut(df: DataFrame) -> DataFrame:
    """Write and read back, in the folder that spark.checkpoint.dir names (in local mode only: one of our own where it is unset). The
    files are deleted by `discard`, or when the Python process ends."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="orebody-graph-"))
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def by_sorting(df: DataFrame) -> DataFrame:
    """`df` for a join that sorts both sides and never sends one through the driver. Spark takes a written file's size, which may be a tenth of its rows',
    and that of rows before they are exploded for the size of a side, and broadcasts what looks small by that."""
    return df.hint("merge")


def _delete(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` returned and that nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "_cut_path", None)) in _written:
            _delete(path)


@atexit.register
def release() -> None:
    """Delete what `cut` wrote in this process."""
    while _written:
        path = next(iter(_written))
        try:
            _delete(path)
        except Exception:  # the session is gone; nothing is left to delete with
            return

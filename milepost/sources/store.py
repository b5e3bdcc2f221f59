"""Tables in the folder that all executors see (spark.checkpoint.dir): derived once, read by many queries."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_made: list[tuple[SparkSession, str]] = []
_kept: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def on_file_system(spark: SparkSession, path: str):
    """The path as Hadoop knows it, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at exit. Where no folder is named (tests in local mode), below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    path = f"{base.rstrip('/')}/sources-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        try:
            p, fs = on_file_system(spark, path)
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone
            return


def kept(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: str | None = None, spread: bool = True) -> DataFrame:
    """The table that build makes from sf_dir, written by the first call of this application and read by all others.

    by: a column to partition the files by, so that a filter on it prunes them. spread=False: rows of a value are together already (a window
    by it comes last), so they are written where they are and not shuffled again. The inputs must not change meanwhile."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    found = _kept.get(key)
    if found:
        p, fs = on_file_system(spark, f"{found[0]}/_SUCCESS")
        if not fs.exists(p):
            found = None
    if not found:
        df, path = build(), folder(spark, name)
        out = (df.hint("rebalance", by) if spread else df).write.partitionBy(by) if by else df.write
        out.parquet(path)
        found = _kept[key] = (path, df.schema)
    return spark.read.schema(found[1]).parquet(found[0]).select(*found[1].names)

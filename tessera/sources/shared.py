"""Tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``; a temporary one is set only where it is unset, as in tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Rows of at most 40 bytes that are broadcast (20 MB); more are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame) -> DataFrame:
    """A stored table, broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, path: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` derives from the table at ``path``: made when it is first asked for, and again when the table's files change."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{{,/*}}"))
    state = tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files or ())
    key = (spark.sparkContext.applicationId, path, name, state)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut lineage: ``df`` written under a fresh name (partitioned ``by`` columns) and read back, so that the loss of executors costs nothing."""
    path = os.path.join(shared_dir(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What several operators of this folder share: table access, shared-folder tables, line helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern for any Unicode white space.
WHITE = r"\p{IsWhite_Space}"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the named columns."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a temporary one is set only where it is unset."""
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


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder under a fresh name and read it back.

    The written table survives the loss of any executor, unlike cached or locally checkpointed blocks.
    """
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete folders, in whatever file system they are."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(spark: SparkSession, path: str, text: str) -> None:
    """A small new file, in whatever file system; fails if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only values."""
    return c.isNull() | (F.regexp_replace(c, f"{WHITE}+", "") == "")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A file of the public tokenizers; the folder is a parameter, or the environment's TOKENIZERS_DIR."""
    return os.path.join(folder or os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, those with the least hash of the key: what a model is fitted on, whatever order rows come in."""
    total = df.select(key).count()
    if total <= rows:
        return df
    order = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 1)
    part = (1 << 63) / total * (rows + 6 * rows**0.5)  # nearly always some more than asked for
    return df.where(order < F.lit(int(min(part, (1 << 63) - 1))).cast("long")).orderBy(order, key).limit(rows)

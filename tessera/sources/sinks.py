"""Writers: exports, body files, logs, children by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_lines(docs: DataFrame, path: str) -> None:
    """JSON lines of the public fields, ordered by id within files of about equal size."""
    fields = ["doc_id", "url", "title", "summary", "source", "lang", "status", "topics", "keywords", "n_chars", "document_type"]
    docs.select(*fields).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").json(path)


def bodies(docs: DataFrame, path: str, shards: int = 256) -> None:
    """Bodies by shard of the id's hash, a folder each."""
    shard = F.lpad(F.hex(F.pmod(F.xxhash64("doc_id"), F.lit(shards))), 2, "0")
    docs.where("body_text is not null").select("doc_id", "body_text", shard.alias("shard")).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def append_log(rows: DataFrame, path: str, time: str) -> None:
    """Appends log rows, partitioned by day."""
    # days are gathered before writing (a day that is too large for a task is split), so that not every task writes to every day
    rows.withColumn("day", F.to_date(time)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def replace_buckets(children: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Overwrites only the buckets that the new children fall in (rows of a bucket are given whole)."""
    rows = children.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

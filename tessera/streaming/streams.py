"""Structured Streaming over the event and log tables: windows, sessions, late and repeated rows, claims, merges.

Each function takes a streaming DataFrame and returns one; ``drained`` runs it until its source is empty and gives
the result as a table. The folder of checkpoints is the shared one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.shared import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. (The pattern lets a table be one file as well as a folder.)"""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/{name}.parque[t]")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as a timestamp that watermarks accept; naive times are read as UTC, whatever the session's zone."""
    e = stream(spark, sf_dir, "events")
    if dict(e.dtypes)["ts"] == "timestamp_ntz":
        e = e.withColumn("ts", F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")))
    return e


def drained(df: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a streaming query on all that is there and reads its result back.

    Append mode adds files; update mode adds what changed, and of each of the ``keys`` the latest batch's row holds, so
    that closed windows leave the state and nothing is written twice; complete mode replaces the result with each
    batch (sessions, which know no updates). ``sink`` takes the batches instead.
    """
    spark = df.sparkSession
    base = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink or write).trigger(availableNow=True).start()
    query.awaitTermination()
    if sink is not None:
        return None
    if mode != "update":
        return spark.read.schema(df.schema).parquet(out if mode == "complete" else f"{out}/*")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    values = [c for c in df.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_v.{c}") for c in df.columns])


def tumbling(df: DataFrame, width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows per window and key."""
    g = df.withWatermark("ts", "1 day").groupBy(F.window("ts", width).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(F.unix_micros("w.start").alias("start_us"), key, "n")


def sliding(df: DataFrame, width: str = "60 minutes", step: str = "30 minutes") -> DataFrame:
    """Rolling counts."""
    g = df.withWatermark("ts", "1 day").groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "n", "errors")


def sessions(df: DataFrame, gap: str = "30 minutes", key: str = "user_id") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    g = df.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.unix_micros("w.start").alias("start_us"), "n")


def first_deliveries(df: DataFrame, key: str = "id", time: str = "logged_at") -> DataFrame:
    """Rows delivered twice pass once, within a bounded state."""
    return df.withWatermark(time, "60 days").dropDuplicatesWithinWatermark([key])


def claims(df: DataFrame) -> DataFrame:
    """A micro-batch owns its rows, so a claim is a projection: pending rows become processing."""
    return df.where("status = 'pending'").select("doc_id", F.lit("processing").alias("status_new"))


def upserted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Latest state by key of an append-only stream, for complete mode."""
    return df.groupBy(key).agg(*[F.max_by(c, "order_us").alias(c) for c in columns])

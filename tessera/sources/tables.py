"""Reading the corpus tables. Columns are pruned and filters pushed down by Spark from what a query uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of the queries that need one, as a parameter: microseconds of 2025-09-30 00:00 UTC.
NOW_US = 1_759_190_400_000_000
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """A timestamp as microseconds, whatever the session's time zone."""
    return F.unix_micros(F.col(column))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).where("status = 'ready'")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vector (double): the document vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))

"""Sinks with merge semantics: what a store with upserts does, as whole-table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_documents(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per ``key`` after applying ``rows`` in ``order``.

    An empty new summary keeps the old one, ``ready`` never goes back, the first ``published_at`` stays, the version
    counts the rows, and everything else is the last row's. All are map-side combined aggregates: no window.
    """
    last = lambda c: F.max_by(c, order)
    some = F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary"))
    return rows.groupBy(key).agg(
        last("title").alias("title"),
        F.max_by(some, F.when(some.isNotNull(), order)).alias("summary"),
        F.when(F.max((F.col("status") == "ready").cast("int")) == 1, "ready").otherwise(last("status")).alias("status"),
        F.min_by("published_us", F.when(F.col("published_us").isNotNull(), order)).alias("published_us"),
        F.count("*").alias("version"),
    )


def upsert_edges(rows: DataFrame) -> DataFrame:
    """The greatest weight per (source_id, target_id, rel_type); null weights lose."""
    return rows.groupBy("source_id", "target_id", "rel_type").agg(F.max("weight").alias("weight"))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the children of the parents in ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without those that refer to one of ``keys`` in any of ``columns`` (a cascade of deletes)."""
    name = keys.columns[0]
    for c in columns:
        rows = rows.join(keys.select(F.col(name).alias(c)), c, "left_anti")
    return rows

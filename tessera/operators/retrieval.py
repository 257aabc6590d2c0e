"""Lexical and vector signals. Each returns doc_id, score; every top-k has a total order (score, then doc_id)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens
from tessera.sources.shared import stored

K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, in order."""
    out: list[str] = []
    word = ""
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            if word not in out:
                out.append(word)
            word = ""
    return out


def top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)


@dataclass
class Index:
    """Postings (b, term, doc_id, tf, dl) in buckets of terms, and the collection's size and mean length."""

    postings: DataFrame
    buckets: int
    n: int
    avgdl: float

    def rows(self, terms: list[str]) -> DataFrame:
        """The postings of some terms: only their buckets are read, and in these only the row groups that can hold them."""
        buckets = [F.pmod(F.hash(F.lit(t)), F.lit(self.buckets)) for t in terms]
        return self.postings.where(F.col("b").isin(*buckets) & F.col("term").isin(*terms)).select("term", "doc_id", "tf", "dl")


def build_index(docs: DataFrame, text: Column) -> Index:
    """One pass over the texts: terms with their frequencies, and one row without a term for each document.

    Buckets are balanced by a rebalance that splits what is too large, so a term in all documents is spread.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = docs.select("doc_id", F.coalesce(tokens(text), F.array().cast("array<string>")).alias("t"))
    each = words.select("doc_id", F.size("t").alias("dl"), F.explode(F.array_append("t", F.lit(None).cast("string"))).alias("term"))
    b = F.pmod(F.when(F.col("term").isNull(), F.hash("doc_id")).otherwise(F.hash("term")), F.lit(n))
    rows = each.groupBy("term", "doc_id", "dl").agg(F.count("*").cast("int").alias("tf")).withColumn("b", b)
    postings = stored(rows.hint("rebalance", "b").sortWithinPartitions("b", "term"), "index", "b")
    size = postings.where("term is null").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    return Index(postings, n, size.n, size.avgdl or 0.0)


def bm25(index: Index, terms: list[str], long: list[str]) -> DataFrame:
    """doc_id, score, matched over the terms; the same over the long ones. Frequencies are a row per query term."""
    found = index.rows(terms)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (index.avgdl or 1.0)))
    is_long = F.col("term").isin(*long)
    return found.join(F.broadcast(df), "term").groupBy("doc_id").agg(
        F.round(F.sum(part), 9).alias("score"), F.count("*").alias("matched"), F.round(F.sum(F.when(is_long, part)), 9).alias("long_score"), F.count_if(is_long).alias("long_matched")
    )


def fts(index: Index, query: str, limit: int) -> DataFrame:
    """Documents with all terms; if there are fewer than three, those with any term of four letters or more come after them."""
    terms = query_terms(query)
    long = [t for t in terms if len(t) > 3]
    scored = bm25(index, terms, long)
    whole = F.col("matched") == len(terms)
    every = top(scored.where(whole).select("doc_id", "score"), limit).withColumn("tier", F.lit(0))
    if not long or scored.where(whole).limit(3).count() == 3:
        return every
    some = top(scored.where(~whole & (F.col("long_matched") > 0)).select("doc_id", F.col("long_score").alias("score")), limit)
    return every.unionByName(some.withColumn("tier", F.lit(1)))


def fts_like(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """Substring hits: a title hit counts two, a body hit one, over at most eight words of three letters or more."""
    words = [w for w in query_terms(query) if len(w) > 2][:8]
    score = sum((F.when(F.lower("title").contains(w), 2).otherwise(0) + F.when(F.lower("text").contains(w), 1).otherwise(0) for w in words), F.lit(0))
    return top(docs.select("doc_id", score.alias("score")).where("score > 0"), limit)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def similar(rows: DataFrame, query: list[float], *keep: str) -> DataFrame:
    """The ``keep`` columns and ``score``: the cosine of ``vector`` to one query vector, a product a batch.

    A null vector or one of another length has no score; a norm of 0 gives 0.
    """
    q = np.array(query, dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(keep))
            fits = pc.fill_null(pc.equal(pc.list_value_length(own), len(q)), False)
            m = own.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(q))
            norm = np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum())
            score = np.full(batch.num_rows, np.nan)
            score[np.asarray(fits)] = np.divide((m * q).sum(1), norm, out=np.zeros(len(m)), where=norm > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.round(score, 9), from_pandas=True)], names=[*keep, "score"])

    schema = T.StructType([*[rows.schema[k] for k in keep], T.StructField("score", T.DoubleType())])
    return rows.select(*keep, "vector").mapInArrow(run, schema)


def vec(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Nearest vectors to one query vector: no join, one map and a top-k."""
    return top(similar(vectors, query, "doc_id"), limit)


def best_per_doc(rows: DataFrame, limit: int) -> DataFrame:
    """The best score of each document's parts."""
    return top(rows.groupBy("doc_id").agg(F.max("score").alias("score")), limit)


def parts_vec(parts: DataFrame, query: list[float], cut: int, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """Nearest parts (questions or chunks: doc_id, vector) cut at ``cut`` rows, then documents by their best part."""
    near = top(similar(parts, query, "doc_id"), cut)
    best = near.groupBy("doc_id").agg(F.max("score").alias("score"))
    return top(best if allowed is None else best.join(allowed, "doc_id", "left_semi"), limit)


def entity_match(docs: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Share of the query's terms that an entity contains or that contain an entity."""
    hit = lambda t: F.exists("entities", lambda e: F.lower(e).contains(t) | F.lit(t).contains(F.lower(e)))
    score = sum((F.when(hit(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / len(terms)
    return top(docs.select("doc_id", score.alias("score")).where("score > 0"), limit)


def minmax(scored: DataFrame, column: str = "score") -> DataFrame:
    """(s - min) / (max - min) over a bounded result; all equal -> 1."""
    w = Window.partitionBy()
    low, high = F.min(column).over(w), F.max(column).over(w)
    return scored.withColumn(column, F.when(high > low, (F.col(column) - low) / (high - low)).otherwise(F.lit(1.0)))

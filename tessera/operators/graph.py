"""Building and walking the document graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import bounded, stored


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, weight, rel_type in either direction."""
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "rel_type")
    return e.union(edges.select("target_id", "source_id", "weight", "rel_type"))


def neighbors(edges: DataFrame, doc_id: int, limit: int = 20) -> DataFrame:
    """Heaviest edges at a document, in either direction; no dedupe across types."""
    near = both_ways(edges.where((F.col("source_id") == doc_id) | (F.col("target_id") == doc_id))).where(F.col("src") == doc_id)
    return near.orderBy(F.desc_nulls_last("weight"), "dst", "rel_type").limit(limit).select("dst", "rel_type", "weight")


def intersect(edges: DataFrame, pinned: list[int], least: int | None = None, limit: int = 10, directed: bool = False) -> DataFrame:
    """Documents reached from at least ``least`` of the pinned ones (default: all)."""
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight", "rel_type") if directed else both_ways(edges)
    hit = e.where(F.col("src").isin(*pinned) & ~F.col("dst").isin(*pinned))
    g = hit.groupBy("dst").agg(F.count_distinct("src").alias("overlap"), F.avg("weight").alias("avg_weight"))
    return g.where(F.col("overlap") >= (least or len(pinned))).orderBy(F.desc("overlap"), F.desc_nulls_last("avg_weight"), "dst").limit(limit)


def bridge(edges: DataFrame, source: int, target: int, most: int = 5, directed: bool = False) -> DataFrame:
    """dst, hop, parent of the breadth-first levels up to the target (at most eight); edges are walked both ways unless ``directed``.

    The walkable pairs are stored once. Each level is a join of the frontier (new documents only) with them; a new
    document keeps its heaviest parent, of equal ones the smallest.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "weight") if directed else both_ways(edges)
    walk = stored(e.groupBy("src", "dst").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("weight")), "bridge-walk")
    seen = spark.createDataFrame([(source, 0, None)], "dst long, hop int, parent long")
    frontier = seen
    for hop in range(1, min(most, 8) + 1):
        step = frontier.select(F.col("dst").alias("src")).join(walk, "src").join(seen.select("dst"), "dst", "left_anti")
        frontier = step.groupBy("dst").agg(F.max_by("src", F.struct("weight", (-F.col("src")).alias("m"))).alias("parent")).select("dst", F.lit(hop).alias("hop"), "parent")
        frontier = stored(frontier, "bridge")
        seen = seen.unionByName(frontier)
        there = frontier.agg(F.count("*").alias("n"), F.max(F.col("dst") == target).alias("met")).first()
        if not there.n or there.met:
            break
    return seen


def paths(levels: DataFrame, target: int, most: int = 8) -> DataFrame:
    """step, doc_id of the way to the target along the parents; empty if the target wasn't met. One row a level."""
    at = levels.where(F.col("dst") == target)
    out = [at]
    for _ in range(most):
        at = levels.join(F.broadcast(at.select(F.col("parent").alias("dst"))), "dst")  # one row
        out.append(at)
    return reduce(DataFrame.union, [x.select("dst", "hop", "parent") for x in out]).select(F.col("hop").alias("step"), F.col("dst").alias("doc_id"))


def best_of_both(edges: DataFrame, a: str, b: str, most: int) -> DataFrame:
    """Edges (a, b, weight) among the ``most`` heaviest of either end. Two separate limits, each of which runs before its shuffle (a hub costs no task its whole degree)."""

    def best(one: str, other: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(one).orderBy(F.desc("weight"), other))
        return edges.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")

    return best(a, b).join(best(b, a).select(a, b), [a, b], "left_semi").select(a, b, "weight")


def keyword_edges(docs: DataFrame, least: float = 0.05, per_side: int = 20, most_df: int = 500) -> DataFrame:
    """Token-Jaccard edges over keywords, entities and topics.

    Terms in 2 to ``most_df`` documents only (part of the definition: it bounds the self-join to most_df per term and
    document); both ends keep the edge among their ``per_side`` best.
    """
    terms = terms_of(docs)
    used = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(2, most_df)).select("term")
    kept = terms.join(used, "term")
    size = kept.groupBy("doc_id").agg(F.count("*").alias("n"))
    pairs = kept.select("term", F.col("doc_id").alias("a")).join(kept.select("term", F.col("doc_id").alias("b")), "term").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    wide = pairs.join(size.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")
    scored = wide.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("weight")).where(F.col("weight") >= least)
    return best_of_both(stored(scored, "edges"), "a", "b", per_side)


def terms_of(docs: DataFrame) -> DataFrame:
    """doc_id, term: the distinct lower-cased keywords, entities and topics of three characters or more."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("keywords", "entities", "topics"), lambda x: F.lower(x)))).alias("term")).where(F.length("term") >= 3)


@dataclass
class Frequencies:
    """What a full build leaves behind for the next batch: terms (doc_id, term), df (term, df), sizes (doc_id, n of used terms)."""

    terms: DataFrame
    df: DataFrame
    sizes: DataFrame


def frequencies(docs: DataFrame, most_df: int = 500) -> Frequencies:
    terms = stored(terms_of(docs), "graph-terms")
    df = stored(terms.groupBy("term").agg(F.count("*").alias("df")), "graph-df")
    used = df.where(F.col("df").between(2, most_df)).select("term")
    return Frequencies(terms, df, stored(terms.join(used, "term").groupBy("doc_id").agg(F.count("*").alias("n")), "graph-sizes"))


def incremental_edges(state: Frequencies, batch: DataFrame, least: float = 0.05, most_df: int = 500) -> DataFrame:
    """a, b, weight of the edges that a batch of new documents has by the full build's definition, before limits per side.

    Only the batch's terms are counted and joined: their frequencies are added to the kept ones, and where one enters
    or leaves the range of used terms, the sizes of the documents that carry it are corrected.
    """
    new = stored(terms_of(batch), "graph-new")
    old_df = F.coalesce("df", F.lit(0))
    touched = new.groupBy("term").agg(F.count("*").alias("more")).join(state.df, "term", "left").select("term", old_df.between(2, most_df).alias("was"), (old_df + F.col("more")).between(2, most_df).alias("used"))
    touched = stored(touched, "graph-touched")
    mine = bounded(touched)
    change = F.when(F.col("used"), 1).otherwise(-1)
    shift = state.terms.join(mine.where("was <> used"), "term").groupBy("doc_id").agg(F.sum(change).alias("shift"))
    both = state.terms.join(mine.where("used").select("term"), "term").select("term", "doc_id", F.lit(False).alias("is_new"))
    own = new.join(mine.where("used").select("term"), "term").select("term", "doc_id", F.lit(True).alias("is_new"))
    other = both.union(own).select("term", F.col("doc_id").alias("o"), "is_new")
    pairs = own.select("term", "doc_id").join(other, "term").where(F.when(F.col("is_new"), F.col("doc_id") < F.col("o")).otherwise(True)).groupBy("doc_id", "o").agg(F.count("*").alias("both"))
    old_sizes = state.sizes.join(shift, "doc_id", "full").select("doc_id", (F.coalesce("n", F.lit(0)) + F.coalesce("shift", F.lit(0))).alias("n"))
    sizes = stored(old_sizes.union(own.groupBy("doc_id").agg(F.count("*").alias("n"))), "graph-new-sizes")
    wide = pairs.join(sizes.withColumnRenamed("n", "na"), "doc_id").join(sizes.select(F.col("doc_id").alias("o"), F.col("n").alias("nb")), "o")
    weight = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return wide.select(F.least("doc_id", "o").alias("a"), F.greatest("doc_id", "o").alias("b"), weight.alias("weight")).where(F.col("weight") >= least)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.5, block: int = 2048, most: int = 16_384) -> DataFrame:
    """Exact nearest neighbours of a stated query set among all vectors: src, dst, cosine.

    Up to ``most`` queries (counted: 8 MB at 64 dimensions) are sent to the scan of the vectors, which don't move: each
    task keeps the k best of every query, and a second top-k merges the tasks'. More queries go in blocks.
    """
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("cosine", 9)), "dst"))
    if queries.limit(most + 1).count() <= most:
        near = _scanned(queries, vectors, k, least)
    else:
        near = _blocks(queries, vectors, k, least, block)
    return near.withColumn("r", r).where(F.col("r") <= k).drop("r")


def _scanned(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    rows = queries.select("doc_id", "vector").collect()
    shared = queries.sparkSession.sparkContext.broadcast((np.array([x.doc_id for x in rows], dtype=np.int64), _unit(np.array([x.vector for x in rows], dtype=float))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_id, best = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches if len(ids) else ():
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                s = q @ _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)).T
                s[ids[:, None] == own[None, :]] = -2
                best, best_id = np.hstack([best, s]), np.hstack([best_id, np.broadcast_to(own, s.shape)])
                order = np.lexsort((best_id, -np.round(best, 9)))[:, :k]
                best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
        keep = best >= least
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(1))), pa.array(best_id[keep]), pa.array(best[keep])], names=["src", "dst", "cosine"])

    return vectors.select(F.col("doc_id").cast("long"), "vector").mapInArrow(run, "src long, dst long, cosine double")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300) if m.size else m


def _blocks(queries: DataFrame, vectors: DataFrame, k: int, least: float, block: int) -> DataFrame:
    """Both sides in blocks of about ``block`` rows; each pair of blocks is one task of a dense product, whatever the sizes."""

    def blocks(side: DataFrame, i: str, rows: str) -> tuple[DataFrame, int]:
        n = max(1, -(-side.count() // block))
        own = side.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias(i), F.struct("doc_id", "vector").alias("r"))
        return own.groupBy(i).agg(F.collect_list("r").alias(rows)), n

    (left, n), (right, m) = blocks(queries, "i", "x"), blocks(vectors, "j", "y")
    tasks = left.crossJoin(right).repartition(min(n * m, 100_000), "i", "j")

    def run(parts):
        for p in parts:
            out = []
            for x, y in zip(p.x, p.y):
                a, b = (np.array([r["vector"] for r in z], dtype=float) for z in (x, y))
                ia, ib = (np.array([r["doc_id"] for r in z]) for z in (x, y))
                s = _unit(a) @ _unit(b).T
                s[ia[:, None] == ib[None, :]] = -2
                for row, d in zip(s, ia):
                    best = np.lexsort((ib, -np.round(row, 9)))[:k]
                    out += [(int(d), int(ib[c]), float(row[c])) for c in best if row[c] >= least]
            yield pd.DataFrame(out, columns=["src", "dst", "cosine"])

    return tasks.select("x", "y").mapInPandas(run, "src long, dst long, cosine double")


def vector_edges(queries: DataFrame, vectors: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """source_id, target_id, weight = min(0.7 x cosine, 1), the smaller id first, by the greater weight."""
    e = knn(queries, vectors, k, least)
    return e.groupBy(F.least("src", "dst").alias("source_id"), F.greatest("src", "dst").alias("target_id")).agg(F.max(F.least(F.col("cosine") * 0.7, F.lit(1.0))).alias("weight"))


def typed_edges(docs: DataFrame, one: int, least: float = 0.05) -> DataFrame:
    """One document against all by Jaccard of topics, entities and keywords: the best type of each pair."""
    src = docs.where(F.col("doc_id") == one).select(*[F.col(c).alias(f"s_{c}") for c in ("topics", "entities", "keywords")])
    wide = docs.where(F.col("doc_id") != one).crossJoin(F.broadcast(src))  # one row
    jac = lambda c: F.when(F.size(F.array_union(c, f"s_{c}")) > 0, F.size(F.array_intersect(c, f"s_{c}")) / F.size(F.array_union(c, f"s_{c}"))).otherwise(F.lit(0.0))
    best = F.greatest(*[F.struct(jac(c).alias("w"), F.lit(t).alias("rel_type")) for c, t in (("topics", "same_topic"), ("entities", "same_entity"), ("keywords", "same_keyword"))])
    return wide.select("doc_id", best.alias("b")).where(F.col("b.w") >= least).select("doc_id", "b.rel_type", F.round("b.w", 4).alias("weight"))


def traverse_scores(docs: DataFrame, seeds: list[str], limit: int = 20) -> DataFrame:
    """0.7 x coverage of the seeds + 0.3 x their density among a document's terms, over all documents."""
    terms = F.array_distinct(F.transform(F.concat("topics", "keywords", "entities"), lambda x: F.lower(x)))
    q = F.array(*[F.lit(s.lower()) for s in seeds])
    n = F.size(F.array_intersect(terms, q))
    score = F.round(0.7 * n / len(seeds) + 0.3 * n / F.greatest(F.size(terms), F.lit(1)), 4)
    return docs.select("doc_id", n.alias("n"), score.alias("score")).where("n > 0").orderBy(F.desc("score"), "doc_id").limit(limit).select("doc_id", "score")


def next_clusters(docs: DataFrame, seeds: list[str], among: DataFrame, most_terms: int = 50, explore: bool = False) -> DataFrame:
    """Terms of the matched documents grouped by the two smallest documents that carry them; ``explore`` favours frequent ones."""
    terms = docs.join(among.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("topics", "keywords", "entities"), lambda x: F.lower(x)))).alias("term"))
    n = among.agg(F.count("*").alias("n_docs"))
    g = terms.where(~F.col("term").isin(*[s.lower() for s in seeds])).groupBy("term").agg(F.count("*").alias("df"), F.slice(F.sort_array(F.collect_set("doc_id")), 1, 2).alias("anchor"))
    g = g.crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("df") / F.col("n_docs") * (1 + 0.1 * F.col("df") if explore else F.lit(1.0)), 6)).orderBy(F.desc("score"), "term").limit(most_terms)  # one row
    return g.groupBy("anchor").agg(F.count("*").alias("terms"), F.round(F.max("score"), 6).alias("best")).select(F.array_join(F.transform("anchor", lambda x: x.cast("string")), ",").alias("anchor"), "terms", "best")

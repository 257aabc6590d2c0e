"""Retrieval signals, rankers, the search pipeline and its diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.query import NO_ENTITY, diverse, entity_terms
from tessera.operators import fusion as U
from tessera.operators import retrieval as V
from tessera.plans.registry import Registry
from tessera.plans.tables import degrees
from tessera.sources.shared import kept
from tessera.sources.tables import DAY_US, NOW_US, corpus, micros, ready, table, vectors

R = Registry()
QUERY = "reservoir gates pressure zones"
RARE = "kiln shelves torrelima telemetry patchy"
QVEC_ID = 3
LIMIT = 20


# Inputs


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """Stands in for the embedder: a stored vector (one row)."""
    row = vectors(spark, sf).where(F.col("doc_id") == QVEC_ID).first()
    return list(row.vector) if row else [0.0]


def ready_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).join(ready(spark, sf).select("doc_id"), "doc_id", "left_semi")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return ready(spark, sf).select("doc_id", F.posexplode("answers_questions").alias("q", "question"))


def part_vectors(spark: SparkSession, sf: str, parts: DataFrame, factor: int) -> DataFrame:
    """doc_id, vector of document parts (doc_id, q): part q of document d has vector (factor x d + q) mod the table's size."""
    v = vectors(spark, sf)
    n = v.count()
    at = parts.withColumn("vec", F.pmod(F.col("doc_id") * factor + F.col("q"), F.lit(max(1, n))))
    return at.join(v.withColumnRenamed("doc_id", "vec"), "vec").drop("vec")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, q: three chunks per ready document."""
    return corpus(spark, sf).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("q"))


# Signals


def text_index(spark, sf):
    return kept(spark, f"{sf}/documents.parquet", "text", lambda: V.build_index(ready(spark, sf), F.col("text")))


def fts(spark, sf, query=QUERY, limit=LIMIT):
    return V.fts(text_index(spark, sf), query, limit)


def vec(spark, sf, limit=LIMIT):
    return V.vec(ready_vectors(spark, sf), query_vector(spark, sf), limit)


def aq_vec(spark, sf, limit=LIMIT):
    return V.parts_vec(part_vectors(spark, sf, questions(spark, sf), 5), query_vector(spark, sf), 8 * limit, limit)


def chunk_vec(spark, sf, limit=LIMIT):
    return V.parts_vec(part_vectors(spark, sf, chunk_rows(spark, sf), 3), query_vector(spark, sf), 20 * limit, limit, ready(spark, sf).select("doc_id"))


def aq_fts(spark, sf, query=QUERY, limit=LIMIT):
    index = kept(spark, f"{sf}/documents.parquet", "questions", lambda: V.build_index(ready(spark, sf), F.array_join("answers_questions", " ")))
    return V.fts(index, query, limit)


def entity_signal(spark, sf, limit=LIMIT):
    return V.entity_match(ready(spark, sf), ["archive", "quorn", "copperfen"], limit)


# The same in SQL: each function gives common table expressions that end in a table of the given name


def fts_sql(name: str, query: str = QUERY, limit: int = LIMIT, text: str = "text") -> str:
    terms = V.query_terms(query)
    long = [t for t in terms if len(t) > 3]

    def scored(n: str, words: list[str]) -> str:
        inside = ", ".join(f"'{w}'" for w in words)
        return f"""{n}_o as (select doc_id, len(t) as dl, unnest(list_filter(t, lambda x: x in ({inside}))) as term from {name}_t), {n}_p as (select doc_id, term, any_value(dl) as dl, count(*) as tf from {n}_o group by doc_id, term),
        {n}_d as (select term, count(*) as df from {n}_p group by term), {n} as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) as score, count(*) as matched from {n}_p join {n}_d using (term), {name}_s group by doc_id)"""

    return f"""{name}_t as (select doc_id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') as t from documents where status = 'ready'), {name}_s as (select count(*) as n, avg(coalesce(len(t), 0)) as avgdl from {name}_t),
    {scored(name + "_a", terms)}, {name}_all as (select doc_id, score, 0 as tier from {name}_a where matched = {len(terms)} order by score desc, doc_id limit {limit}),
    {scored(name + "_b", long)}, {name}_any as (select doc_id, score, 1 as tier from {name}_b where doc_id not in (select doc_id from {name}_all) order by score desc, doc_id limit {limit}),
    {name} as (select * from {name}_all union all select * from {name}_any where (select count(*) from {name}_all) < 3)"""


_COS = "round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)), 9)"


def vec_sql(name: str, limit: int = LIMIT) -> str:
    return f"{name} as (select vec_id as doc_id, {_COS} as score, 0 as tier from embeddings where vec_id in (select doc_id from documents where status = 'ready') order by score desc, doc_id limit {limit})"


def _parts_sql(name: str, rows: str, factor: int, cut: int, limit: int, only: str = "true") -> str:
    return f"""{name}_r as ({rows}), {name}_n as (select r.doc_id, {_COS} as score from {name}_r r join embeddings on vec_id = (r.doc_id * {factor} + q) % (select count(*) from embeddings) order by score desc, r.doc_id limit {cut}),
    {name} as (select doc_id, max(score) as score, 0 as tier from {name}_n where {only} group by doc_id order by score desc, doc_id limit {limit})"""


def aq_vec_sql(name: str, limit: int = LIMIT) -> str:
    return _parts_sql(name, "select doc_id, generate_subscripts(answers_questions, 1) - 1 as q from documents where status = 'ready'", 5, 8 * limit, limit)


def chunk_vec_sql(name: str, limit: int = LIMIT) -> str:
    return _parts_sql(name, "select doc_id, unnest([0, 1, 2]) as q from documents", 3, 20 * limit, limit, "doc_id in (select doc_id from documents where status = 'ready')")


def aq_fts_sql(name: str, query: str = QUERY, limit: int = LIMIT) -> str:
    return fts_sql(name, query, limit, "array_to_string(answers_questions, ' ')")


def entity_sql(name: str, limit: int = LIMIT) -> str:
    terms = ("archive", "quorn", "copperfen")
    hit = " + ".join(f"case when len(list_filter(entities, lambda e: contains(lower(e), '{t}') or contains('{t}', lower(e)))) > 0 then 1.0 else 0.0 end" for t in terms)
    return f"{name} as (select * from (select doc_id, ({hit}) / 3 as score, 0 as tier from documents where status = 'ready') where score > 0 order by score desc, doc_id limit {limit})"


def rrf_sql(names: list[str], k: int = 60, limit: int = LIMIT, weights: list[float] | None = None) -> str:
    weights = weights or [1.0] * len(names)
    parts = " union all ".join(f"select doc_id, {w} / ({k} + row_number() over (order by tier, score desc, doc_id)) as s from {n}" for n, w in zip(names, weights))
    return f"select doc_id, round(sum(s), 9) as score from ({parts}) group by doc_id order by score desc, doc_id limit {limit}"


def norm_sql(name: str) -> str:
    return f"(select doc_id, case when max(score) over () > min(score) over () then (score - min(score) over ()) / (max(score) over () - min(score) over ()) else 1.0 end as score from {name})"


def blend_sql(parts: list[tuple[str, float]], limit: int = LIMIT) -> str:
    rows = " union all ".join(f"select doc_id, score * {w} as s from {norm_sql(n)}" for n, w in parts)
    return f"select doc_id, round(sum(s), 9) as score from ({rows}) group by doc_id order by score desc, doc_id limit {limit}"


def _out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"))


def _sql(ctes: list[str], final: str) -> str:
    return f"with {', '.join(ctes)} select doc_id, round(score, 6) as score from ({final})"


# Signals as queries


@R.add("fts_match", _sql([fts_sql("f")], "select * from f"))
def fts_match(spark, sf):
    return _out(fts(spark, sf))


@R.add("fts_fallback", _sql([fts_sql("f", RARE)], "select * from f"))
def fts_fallback(spark, sf):
    """V01 where fewer than three documents have all terms."""
    return _out(fts(spark, sf, RARE))


@R.add("fts_like", "select doc_id, cast(s as int) as score from (select doc_id, " + " + ".join(f"case when contains(lower(title), '{w}') then 2 else 0 end + case when contains(lower(text), '{w}') then 1 else 0 end" for w in V.query_terms(QUERY)) + " as s from documents) where s > 0 order by s desc, doc_id limit 50")
def fts_like(spark, sf):
    return V.fts_like(corpus(spark, sf), QUERY, 50).select("doc_id", F.col("score").cast("int").alias("score"))


@R.add("vec_topk", _sql([vec_sql("v")], "select * from v"))
def vec_topk(spark, sf):
    return _out(vec(spark, sf))


@R.add("aq_vec", _sql([aq_vec_sql("v")], "select * from v"))
def aq_vec_query(spark, sf):
    return _out(aq_vec(spark, sf))


@R.add("chunk_vec", _sql([chunk_vec_sql("v")], "select * from v"))
def chunk_vec_query(spark, sf):
    return _out(chunk_vec(spark, sf))


@R.add("aq_fts", _sql([aq_fts_sql("f")], "select * from f"))
def aq_fts_query(spark, sf):
    return _out(aq_fts(spark, sf))


@R.add("entity_match", _sql([entity_sql("e")], "select * from e"))
def entity_match(spark, sf):
    return _out(entity_signal(spark, sf))


@R.add("cosine_pairs", "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    v = vectors(spark, sf)
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("w"))
    return v.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.round(V.cosine(F.col("vector"), F.col("w")), 6).alias("cosine"))


@R.add("mrl_truncate", "select vec_id as doc_id, len(embedding[1:16]) as dims, round(list_sum(embedding[1:16]::double[]), 6) as total from embeddings")
def mrl_truncate(spark, sf):
    """Vectors cut to 16 dimensions, not renormalised."""
    cut = F.slice("vector", 1, 16)
    return vectors(spark, sf).select("doc_id", F.size(cut).alias("dims"), F.round(F.aggregate(cut, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@R.add("best_chunk", f"select r.doc_id, arg_max(q, struct_pack(s := {_COS}, q := -q)) as chunk_index, round(max({_COS}), 6) as score from (select doc_id, unnest([0, 1, 2]) as q from documents) r join embeddings on vec_id = (r.doc_id * 3 + q) % (select count(*) from embeddings) group by r.doc_id")
def best_chunk(spark, sf):
    """The best chunk of each document."""
    rows = V.similar(part_vectors(spark, sf, chunk_rows(spark, sf), 3), query_vector(spark, sf), "doc_id", "q").withColumnRenamed("score", "s")
    return rows.groupBy("doc_id").agg(F.max(F.struct("s", (-F.col("q")).alias("m"))).alias("b")).select("doc_id", (-F.col("b.m")).alias("chunk_index"), F.round("b.s", 6).alias("score"))


@R.add("recency_feature", f"select doc_id, round(exp(-greatest({NOW_US} - epoch_us(coalesce(published_at, ingested_at)), 0) / {30.0 * DAY_US}), 6) as recency from documents")
def recency_feature(spark, sf):
    return corpus(spark, sf).select("doc_id", F.round(recency(), 6).alias("recency"))


def recency():
    return F.exp(-F.greatest(NOW_US - F.coalesce(micros("published_at"), micros("ingested_at")), F.lit(0)) / (30.0 * DAY_US))


@R.add("quality_feature", "select doc_id, coalesce(enrichment_quality_score / 100.0, 0.5) as quality from documents")
def quality_feature(spark, sf):
    return corpus(spark, sf).select("doc_id", F.coalesce(F.col("enrichment_quality_score") / 100.0, F.lit(0.5)).alias("quality"))


_STALE = f"case when age is null then 1.0 when age > {365 * DAY_US} then 0.8 when age > {90 * DAY_US} then 0.88 when age > {30 * DAY_US} then 0.93 when age > {7 * DAY_US} then 0.97 else 1.0 end"


@R.add("staleness_penalty", f"select doc_id, cast({_STALE} as double) as factor from (select doc_id, {NOW_US} - epoch_us(published_at) as age from documents)")
def staleness_penalty(spark, sf):
    age = NOW_US - micros("published_at")
    steps = F.when(age.isNull(), 1.0).when(age > 365 * DAY_US, 0.8).when(age > 90 * DAY_US, 0.88).when(age > 30 * DAY_US, 0.93).when(age > 7 * DAY_US, 0.97).otherwise(1.0)
    return corpus(spark, sf).select("doc_id", steps.alias("factor"))


@R.add("degree_feature", f"with g as (select id as doc_id, count(*) as score from (select source_id as id from document_edges union all select target_id from document_edges) group by 1) select doc_id, round(score, 6) as score from {norm_sql('g')}")
def degree_feature(spark, sf):
    low_high = degrees(spark, sf).agg(F.min("degree").alias("a"), F.max("degree").alias("b"))
    g = degrees(spark, sf).crossJoin(F.broadcast(low_high))  # one row
    return g.select(F.col("id").alias("doc_id"), F.round(F.when(F.col("b") > F.col("a"), (F.col("degree") - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(1.0), 6).alias("score"))


# Rankers: name -> (Spark, SQL). Each takes (spark, sf) and gives doc_id, score


def rrf2(spark, sf, limit=LIMIT):
    return U.rrf([fts(spark, sf, limit=limit), vec(spark, sf, limit)], limit)


def four(spark, sf, limit=LIMIT):
    return [fts(spark, sf, limit=limit), vec(spark, sf, limit), aq_vec(spark, sf, limit), chunk_vec(spark, sf, limit)]


_FOUR = [fts_sql("f"), vec_sql("v"), aq_vec_sql("a"), chunk_vec_sql("c")]


def ranker(name: str, ctes: list[str] | None = None, final: str | None = None):
    """Registers a ranker as a query."""

    def keep(f):
        RANKERS[name] = f
        R.add(f"rank_{name}", _sql(ctes, final) if ctes else None)(lambda spark, sf: _out(f(spark, sf)))
        return f

    return keep


RANKERS: dict = {}


@ranker("bm25", [fts_sql("f")], f"select * from {norm_sql('f')}")
def rank_bm25(spark, sf):
    return V.minmax(fts(spark, sf).select("doc_id", "score"))


@ranker("vector", [vec_sql("v")], f"select * from {norm_sql('v')}")
def rank_vector(spark, sf):
    return V.minmax(vec(spark, sf))


@ranker("rrf", _FOUR, rrf_sql(["f", "v", "a", "c"]))
def rank_rrf(spark, sf):
    return U.rrf(four(spark, sf), LIMIT)


@ranker("rrf_chunks", _FOUR, rrf_sql(["f", "v", "a", "c"]))
def rank_rrf_chunks(spark, sf):
    return U.rrf(four(spark, sf), LIMIT)


@ranker("rrf_k10", [fts_sql("f"), vec_sql("v")], rrf_sql(["f", "v"], 10))
def rank_rrf_k10(spark, sf):
    return U.rrf([fts(spark, sf), vec(spark, sf)], LIMIT, 10)


@ranker("linear_blend", [fts_sql("f", limit=2 * LIMIT), vec_sql("v", 2 * LIMIT)], blend_sql([("v", 0.7), ("f", 0.3)]))
def rank_linear(spark, sf):
    return U.blend([(vec(spark, sf, 2 * LIMIT), 0.7), (fts(spark, sf, limit=2 * LIMIT), 0.3)], LIMIT)


@ranker("linear_blend_50", [fts_sql("f", limit=2 * LIMIT), vec_sql("v", 2 * LIMIT)], blend_sql([("v", 0.5), ("f", 0.5)]))
def rank_linear_50(spark, sf):
    return U.blend([(vec(spark, sf, 2 * LIMIT), 0.5), (fts(spark, sf, limit=2 * LIMIT), 0.5)], LIMIT)


@ranker("aq_boosted", [fts_sql("f", limit=2 * LIMIT), aq_fts_sql("a")], blend_sql([("f", 0.6), ("a", 0.4)]))
def rank_aq_boosted(spark, sf):
    return U.blend([(fts(spark, sf, limit=2 * LIMIT), 0.6), (aq_fts(spark, sf), 0.4)], LIMIT)


@ranker("vec_aq_boosted", [vec_sql("v", 2 * LIMIT), aq_fts_sql("a")], blend_sql([("v", 0.7), ("a", 0.3)]))
def rank_vec_aq_boosted(spark, sf):
    return U.blend([(vec(spark, sf, 2 * LIMIT), 0.7), (aq_fts(spark, sf), 0.3)], LIMIT)


def degree_values(spark, sf):
    return degrees(spark, sf).select(F.col("id").alias("doc_id"), F.col("degree").cast("double").alias("value"))


def recency_values(spark, sf):
    return corpus(spark, sf).select("doc_id", recency().alias("value"))


def quality_values(spark, sf):
    return corpus(spark, sf).select("doc_id", F.coalesce(F.col("enrichment_quality_score") / 100.0, F.lit(0.5)).alias("value"))


_V = {
    "degree": "select id as doc_id, count(*)::double as value from (select source_id as id from document_edges union all select target_id from document_edges) group by 1",
    "recency": f"select doc_id, exp(-greatest({NOW_US} - epoch_us(coalesce(published_at, ingested_at)), 0) / {30.0 * DAY_US}) as value from documents",
    "quality": "select doc_id, coalesce(enrichment_quality_score / 100.0, 0.5)::double as value from documents",
}


def feature_sql(base: float, features: list[tuple[str, float, bool]]) -> tuple[list[str], str]:
    ctes = [fts_sql("f"), vec_sql("v"), f"fused as ({rrf_sql(['f', 'v'])})"]
    total, joins = f"fused.score * {base}", ""
    for i, (n, w, normalise) in enumerate(features):
        value = "case when max(value) over () > min(value) over () then (value - min(value) over ()) / (max(value) over () - min(value) over ()) else 1.0 end" if normalise else "value"
        ctes.append(f"x{i} as (select doc_id, {value} as value from ({_V[n]}) where doc_id in (select doc_id from fused))")
        total += f" + coalesce(x{i}.value, 0) * {w}"
        joins += f" left join x{i} on x{i}.doc_id = fused.doc_id"
    return ctes, f"select fused.doc_id, round({total}, 9) as score from fused{joins} order by score desc, fused.doc_id limit {LIMIT}"


@ranker("rrf_graph_boosted", *feature_sql(1.0, [("degree", 0.15, True)]))
def rank_graph(spark, sf):
    return U.with_features(rrf2(spark, sf), 1.0, [(degree_values(spark, sf), 0.15, True)], LIMIT)


@ranker("rrf_recency", *feature_sql(0.8, [("recency", 0.2, True)]))
def rank_recency(spark, sf):
    return U.with_features(rrf2(spark, sf), 0.8, [(recency_values(spark, sf), 0.2, True)], LIMIT)


@ranker("rrf_graph_recency", *feature_sql(0.7, [("degree", 0.15, True), ("recency", 0.15, True)]))
def rank_graph_recency(spark, sf):
    return U.with_features(rrf2(spark, sf), 0.7, [(degree_values(spark, sf), 0.15, True), (recency_values(spark, sf), 0.15, True)], LIMIT)


@ranker("rrf_quality", *feature_sql(0.9, [("quality", 0.1, False)]))
def rank_quality(spark, sf):
    return U.with_features(rrf2(spark, sf), 0.9, [(quality_values(spark, sf), 0.1, False)], LIMIT)


@ranker("answers_questions_rrf", [aq_fts_sql("f"), aq_vec_sql("a"), vec_sql("v")], rrf_sql(["f", "a", "v"]))
def rank_aq_rrf(spark, sf):
    """R13, also under the advertised name rrf_aq."""
    return U.rrf([aq_fts(spark, sf), aq_vec(spark, sf), vec(spark, sf)], LIMIT)


RANKERS["rrf_aq"] = rank_aq_rrf


@ranker("rrf_mmr")
def rank_mmr(spark, sf):
    return U.mmr_frame(rrf2(spark, sf, max(3 * LIMIT, 30)), ready_vectors(spark, sf), LIMIT)


def _rerank_pool(spark, sf, pool):
    hits = rrf2(spark, sf, pool)
    near = V.similar(vectors(spark, sf).join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi"), query_vector(spark, sf), "doc_id")
    return U.rerank(hits, near, pool)


_POOL = max(4 * LIMIT, 40)


@ranker("rrf_rerank", [fts_sql("f", limit=_POOL), vec_sql("v", _POOL), f"pool as ({rrf_sql(['f', 'v'], limit=_POOL)})"], f"select pool.doc_id, coalesce({_COS}, -1.0) as score from pool left join embeddings on vec_id = pool.doc_id order by score desc, pool.doc_id limit {LIMIT}")
def rank_rerank(spark, sf):
    return V.top(_rerank_pool(spark, sf, _POOL), LIMIT)


@ranker("rrf_rerank_mmr")
def rank_rerank_mmr(spark, sf):
    return U.mmr_frame(_rerank_pool(spark, sf, max(5 * LIMIT, 50)), ready_vectors(spark, sf), LIMIT)


@ranker("rrf_rerank_mmr_full")
def rank_rerank_mmr_full(spark, sf):
    """Untruncated vectors where there are any (here all are)."""
    return rank_rerank_mmr(spark, sf)


@ranker("entity_match", [entity_sql("e")], "select * from e")
def rank_entity(spark, sf):
    return entity_signal(spark, sf)


@ranker("adaptive", [entity_sql("e"), fts_sql("f"), aq_vec_sql("a")], rrf_sql(["e", "f", "a"], weights=[2.0, 1.0, 1.0]))
def rank_adaptive(spark, sf):
    """A short query without a question word weighs entities double; others go to R13."""
    if len(QUERY.split()) <= 5 and QUERY.split()[0] not in ("what", "how", "why", "when", "where", "who", "which"):
        return U.rrf([entity_signal(spark, sf), fts(spark, sf), aq_vec(spark, sf)], LIMIT, weights=[2.0, 1.0, 1.0])
    return rank_aq_rrf(spark, sf)


# Pipeline and diagnostics


def search(spark, sf, name: str = "rrf_chunks", min_quality: int | None = None, sources: list[str] | None = None, after_us: int | None = None) -> DataFrame:
    """Ranks, then filters, then hydrates: filters come after the cut, so fewer rows than the limit can return."""
    hits = RANKERS.get(name, rank_rrf)(spark, sf)
    docs = corpus(spark, sf).where("status = 'ready'")
    if min_quality is not None:
        docs = docs.where(F.col("enrichment_quality_score").isNull() | (F.col("enrichment_quality_score") >= min_quality))
    if sources:
        docs = docs.where(F.lower("source").isin(*sources))
    if after_us is not None:
        docs = docs.where(micros("ingested_at") >= after_us)
    return docs.select("doc_id", "title", "summary", "source", "topics").join(F.broadcast(hits), "doc_id").select("doc_id", "title", "source", F.round("score", 6).alias("score"))


@R.add("search_pipeline", f"with {', '.join(_FOUR)}, hits as ({rrf_sql(['f', 'v', 'a', 'c'])}) select doc_id, title, source, round(score, 6) as score from hits join documents using (doc_id) where status = 'ready' and (enrichment_quality_score is null or enrichment_quality_score >= 30)")
def search_pipeline(spark, sf):
    return search(spark, sf, min_quality=30)


@R.add("rank_positions", f"with {fts_sql('f')} select doc_id, row_number() over (order by tier, score desc, doc_id) - 1 as rank0 from f")
def rank_positions(spark, sf):
    return U.ranked(fts(spark, sf))


@R.add("score_gap", f"with {', '.join(_FOUR)}, h as ({rrf_sql(['f', 'v', 'a', 'c'])}), n as (select score / max(score) over () as s, row_number() over (order by score desc, doc_id) as r from h) select round(max(s) filter (where r = 1) - max(s) filter (where r = 2), 6) as gap, round((max(s) - min(s)) / max(s), 6) as spread from n")
def score_gap(spark, sf):
    """W07 over scores relative to the best."""
    h = U.rrf(four(spark, sf), LIMIT)
    n = h.select((F.col("score") / F.max("score").over(Window.partitionBy())).alias("s"), F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("r"))
    one = lambda k: F.max(F.when(F.col("r") == k, F.col("s")))
    return n.agg(F.round(one(1) - one(2), 6).alias("gap"), F.round((F.max("s") - F.min("s")) / F.max("s"), 6).alias("spread"))


_COMPARE = f"with {', '.join(_FOUR)}, h as ({rrf_sql(['f', 'v', 'a', 'c'])}), x as (select doc_id, row_number() over (order by tier, score desc, doc_id) as ra from f), y as (select doc_id, row_number() over (order by score desc, doc_id) as rb from h)"


@R.add("rank_compare", f"{_COMPARE} select coalesce(x.doc_id, y.doc_id) as doc_id, coalesce(ra, 0) as ra, coalesce(rb, 0) as rb, coalesce(ra, 0) - coalesce(rb, 0) as change from x full join y on x.doc_id = y.doc_id")
def rank_compare(spark, sf):
    """Two ranked lists side by side; unranked is 0."""
    a = U.ranked(fts(spark, sf)).select("doc_id", (F.col("rank0") + 1).alias("ra"))
    b = U.ranked(U.rrf(four(spark, sf), LIMIT)).select("doc_id", (F.col("rank0") + 1).alias("rb"))
    za, zb = F.coalesce("ra", F.lit(0)), F.coalesce("rb", F.lit(0))
    return a.join(b, "doc_id", "full").select("doc_id", za.alias("ra"), zb.alias("rb"), (za - zb).alias("change"))


@R.add(
    "chunk_rerank",
    f"""with {', '.join(_FOUR)}, pool as ({rrf_sql(['f', 'v', 'a', 'c'])}), n as (select doc_id, score / max(score) over () as s from pool), b as (select r.doc_id, max({_COS}) as c from (select doc_id, unnest([0, 1, 2]) as q from documents) r join embeddings on vec_id = (r.doc_id * 3 + q) % (select count(*) from embeddings) group by 1)
    select doc_id, round(greatest(s, 0.8 * coalesce(c, 0)), 6) as score from n left join b using (doc_id) order by score desc, doc_id limit 10""",
)
def chunk_rerank(spark, sf):
    """Q02: the pool by the greater of its score and 0.8 x its best chunk's."""
    pool = U.rrf(four(spark, sf), LIMIT)
    n = pool.select("doc_id", (F.col("score") / F.max("score").over(Window.partitionBy())).alias("s"))
    rows = chunk_rows(spark, sf).join(F.broadcast(pool.select("doc_id")), "doc_id", "left_semi")
    b = V.similar(part_vectors(spark, sf, rows, 3), query_vector(spark, sf), "doc_id").groupBy("doc_id").agg(F.max("score").alias("c"))
    return V.top(n.join(b, "doc_id", "left").select("doc_id", F.round(F.greatest("s", 0.8 * F.coalesce("c", F.lit(0.0))), 6).alias("score")), 10)


_WORDS4 = [w for w in V.query_terms(QUERY) if len(w) > 4]


@R.add(
    "gap_signal",
    f"""with {fts_sql('f')}, h as (select * from f order by tier, score desc, doc_id limit 3), d as (select answers_questions as aq, lower(array_to_string(topics, ' ')) as tp, score from h join documents using (doc_id)),
    w as (select unnest([{", ".join(f"'{w}'" for w in _WORDS4)}]) as w), c as (select max(n) as best from (select (select count(*) from w where contains(lower(array_to_string(aq, ' ')), w)) as n from d)), t as (select count(*) as n from w where exists (select 1 from d where contains(tp, w)))
    select (select count(*) from d) = 0 or (best < greatest(2, round_even(0.33 * {len(_WORDS4)}, 0)) and (select (max(score) - min(score)) / max(score) from d) < 0.15 and t.n < {len(_WORDS4) / 2}) as gap from c, t""",
)
def gap_signal(spark, sf):
    """Q05: whether the three best hits cover the query too little."""
    hits = fts(spark, sf).orderBy("tier", F.desc("score"), "doc_id").limit(3)
    d = corpus(spark, sf).select("doc_id", F.lower(F.array_join("answers_questions", " ")).alias("aq"), F.lower(F.array_join("topics", " ")).alias("tp")).join(F.broadcast(hits), "doc_id")
    covered = reduce(lambda a, b: a + b, [F.col("aq").contains(w).cast("int") for w in _WORDS4])
    topic = [F.max(F.col("tp").contains(w).cast("int")).alias(f"t{i}") for i, w in enumerate(_WORDS4)]
    one = d.agg(F.count("*").alias("n"), F.max(covered).alias("best"), ((F.max("score") - F.min("score")) / F.max("score")).alias("spread"), *topic)
    need = F.greatest(F.lit(2), F.bround(F.lit(0.33 * len(_WORDS4)), 0))
    topics = reduce(lambda a, b: a + b, [F.coalesce(f"t{i}", F.lit(0)) for i in range(len(_WORDS4))])
    return one.select(((F.col("n") == 0) | ((F.col("best") < need) & (F.col("spread") < 0.15) & (topics < len(_WORDS4) / 2))).alias("gap"))


_WORDS3 = [w for w in V.query_terms(QUERY) if len(w) > 3]


@R.add(
    "confidence",
    f"""with {', '.join(_FOUR)}, h as ({rrf_sql(['f', 'v', 'a', 'c'])}), g as (select id, count(*) as degree from (select source_id as id from document_edges union all select target_id from document_edges) group by 1),
    d as (select score, lower(array_to_string(answers_questions, ' ')) as aq, topics, coalesce(degree, 0) as degree from h join documents using (doc_id) left join g on g.id = h.doc_id),
    o as (select list(score order by score desc) as s, max({" + ".join(f"contains(aq, '{w}')::int" for w in _WORDS3)}) / {len(_WORDS3)} as cover, least(avg(degree) / 50, 1.0) as density, len(list_distinct(flatten(list(topics)))) as spread from d),
    p as (select *, case when len(s) > 1 then (s[1] - s[2]) / s[1] else 1.0 end as gap from o)
    select round(gap, 6) as score_gap, round(cover, 6) as aq_coverage, round(density, 6) as edge_density, cast(spread as int) as topic_spread, case when gap > 0.3 and cover > 0.5 then 'answer' when spread > 5 then 'decompose' when density > 0.3 then 'expand' else 'search_again' end as action from p""",
)
def confidence(spark, sf):
    """Q06: score gap, question coverage, edge density and topic spread of the hits, and the action they suggest."""
    hits = U.rrf(four(spark, sf), LIMIT)
    d = corpus(spark, sf).select("doc_id", F.lower(F.array_join("answers_questions", " ")).alias("aq"), "topics").join(F.broadcast(hits), "doc_id").join(degrees(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    cover = reduce(lambda a, b: a + b, [F.col("aq").contains(w).cast("int") for w in _WORDS3]) / len(_WORDS3)
    top2 = F.sort_array(F.collect_list("score"), False)  # at most the limit's rows
    one = d.agg(top2.alias("s"), F.max(cover).alias("aq_coverage"), F.least(F.avg(F.coalesce("degree", F.lit(0))) / 50, F.lit(1.0)).alias("edge_density"), F.size(F.array_distinct(F.flatten(F.collect_list("topics")))).alias("topic_spread"))
    gap = F.when(F.size("s") > 1, (F.get("s", F.lit(0)) - F.get("s", F.lit(1))) / F.get("s", F.lit(0))).otherwise(F.lit(1.0))
    action = F.when((gap > 0.3) & (F.col("aq_coverage") > 0.5), "answer").when(F.col("topic_spread") > 5, "decompose").when(F.col("edge_density") > 0.3, "expand").otherwise("search_again")
    return one.select(F.round(gap, 6).alias("score_gap"), F.round("aq_coverage", 6).alias("aq_coverage"), F.round("edge_density", 6).alias("edge_density"), "topic_spread", action.alias("action"))


@R.add("gap_enqueue", "select q, count(*) as asked from (select distinct on (id) id, lower(trim(question)) as q, correct from query_log order by id, logged_at) where correct = false and q not in (select lower(trim(question)) from query_log where correct) group by 1")
def gap_enqueue(spark, sf):
    """Q10: questions never answered right, one entry whatever their spelling."""
    log = table(spark, sf, "query_log").select("id", F.lower(F.trim("question")).alias("q"), "correct", "logged_at")
    one = log.groupBy("id").agg(F.min_by("q", "logged_at").alias("q"), F.min_by("correct", "logged_at").alias("correct")).where("correct = false")
    return one.join(log.where("correct").select("q"), "q", "left_anti").groupBy("q").agg(F.count("*").alias("asked"))


@R.add("gap_unenriched", "select doc_id, hits >= 2 as covered from (select doc_id, " + " + ".join(f"case when contains(lower(text), '{w}') then 1 else 0 end" for w in V.query_terms(QUERY)) + " as hits from documents where len(answers_questions) = 0 and len(topics) = 0)")
def gap_unenriched(spark, sf):
    """Q07: half of the query's words in a document without questions and topics."""
    words = V.query_terms(QUERY)
    hits = reduce(lambda a, b: a + b, [F.when(F.lower("text").contains(w), 1).otherwise(0) for w in words])
    return corpus(spark, sf).where("size(answers_questions) = 0 and size(topics) = 0").select("doc_id", (hits >= len(words) / 2).alias("covered"))


@R.add("query_expand_corpus", f"select q || ' ' || string_agg(term, ' ' order by freq desc, term) as expanded from (select '{QUERY}' as q, term, freq from (select term, count(*) as freq from (select distinct doc_id, lower(term) as term from (select doc_id, unnest(keywords) as term from documents where len(list_filter(keywords, lambda x: contains('{QUERY}', lower(x)))) > 0)) where not contains('{QUERY}', term) group by 1 having count(*) >= 2 order by freq desc, term limit 5)) group by q")
def query_expand_corpus(spark, sf):
    """Up to five terms that stand beside the query's in the corpus."""
    inside = lambda x: F.lit(QUERY).contains(F.lower(x))
    rows = corpus(spark, sf).where(F.exists("keywords", inside)).select("doc_id", F.explode(F.array_distinct(F.transform("keywords", lambda x: F.lower(x)))).alias("term")).where(~F.lit(QUERY).contains(F.col("term")))
    best = rows.groupBy("term").agg(F.count("*").alias("freq")).where("freq >= 2").orderBy(F.desc("freq"), "term").limit(5)
    terms = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("m"), "term"))), lambda x: x["term"])
    return best.agg(F.concat(F.lit(QUERY + " "), F.array_join(terms, " ")).alias("expanded"))


_NO_ENTITY = ", ".join(f"'{w}'" for w in sorted(NO_ENTITY))


@R.add(
    "query_entities",
    f"""with q as (select distinct question from query_log where question is not null), w as (select question, unnest(regexp_extract_all(question, '[A-Z]{{2,5}}|[A-Za-z0-9]+(?:''[a-zA-Z]+)?')) as w from q)
    select lower(w) as term, count(distinct question) as questions from w where (regexp_matches(w, '^[A-Z0-9'']{{2,5}}$') and regexp_matches(w, '[A-Z]')) or (regexp_matches(w, '^[A-Z]..') and regexp_matches(w, '[a-z]')) or (length(w) >= 5 and lower(w) not in ({_NO_ENTITY})) group by 1""",
)
def query_entities(spark, sf):
    """In how many questions of the log each term stands that may name something."""
    q = table(spark, sf, "query_log").where("question is not null").select("question").distinct()
    return q.select("question", F.explode(F.array_distinct(F.transform(entity_terms(F.col("question")), lambda w: F.lower(w)))).alias("term")).groupBy("term").agg(F.count("*").alias("questions"))


@R.add("probe_match", "select topic, docs from (select topic, count(distinct doc_id) as docs from (select unnest(topics) as topic, doc_id from documents where status = 'ready') group by 1 having count(*) >= 5) where contains('who digs water archives and bees', topic) order by docs desc, topic limit 5")
def probe_match(spark, sf):
    """Clusters whose label the context mentions."""
    g = ready(spark, sf).select(F.explode("topics").alias("topic"), "doc_id").groupBy("topic").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 5")
    return g.where(F.lit("who digs water archives and bees").contains(F.col("topic"))).orderBy(F.desc("docs"), "topic").limit(5)


@R.add("index_terms", r"select term, count(*) as df, sum(tf) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents where status = 'ready') group by all) group by term")
def index_terms(spark, sf):
    """The inverted index's vocabulary: document and collection frequencies of every term."""
    return text_index(spark, sf).postings.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@R.add("minmax_normalise", f"with h as (select id, elapsed_ms from query_log where elapsed_ms is not null order by elapsed_ms desc, id limit 200) select id, round((elapsed_ms - min(elapsed_ms) over ()) / (max(elapsed_ms) over () - min(elapsed_ms) over ()), 6) as norm from h")
def minmax_normalise(spark, sf):
    """W05 over a bounded result."""
    h = table(spark, sf, "query_log").where("elapsed_ms is not null").orderBy(F.desc("elapsed_ms"), "id").limit(200).select("id", F.col("elapsed_ms").cast("double").alias("score"))
    return V.minmax(h).select("id", F.round("score", 6).alias("norm"))


_BEST = f"select r.doc_id, arg_max(q, struct_pack(s := {_COS}, q := -q)) as chunk_index, max({_COS}) as c from (select doc_id, unnest([0, 1, 2]) as q from documents) r join embeddings on vec_id = (r.doc_id * 3 + q) % (select count(*) from embeddings) group by r.doc_id"


@R.add("chunk_augment", f"with {', '.join(_FOUR)}, h as ({rrf_sql(['f', 'v', 'a', 'c'])}), b as ({_BEST}) select doc_id, round(score, 6) as score, chunk_index, round(c, 6) as chunk_score from h left join b using (doc_id)")
def chunk_augment(spark, sf):
    """Hits with their best chunk, in their own order; only the hits' chunks are scored."""
    hits = U.rrf(four(spark, sf), LIMIT)
    rows = chunk_rows(spark, sf).join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi")
    scored = V.similar(part_vectors(spark, sf, rows, 3), query_vector(spark, sf), "doc_id", "q").withColumnRenamed("score", "s")
    b = scored.groupBy("doc_id").agg(F.max(F.struct("s", (-F.col("q")).alias("m"))).alias("b"))
    return hits.join(b, "doc_id", "left").select("doc_id", F.round("score", 6).alias("score"), (-F.col("b.m")).alias("chunk_index"), F.round("b.s", 6).alias("chunk_score"))


@R.add("diverse_keywords")
def diverse_keywords(spark, sf):
    """Q04: up to three keywords of a document that don't share their terms (tested against Python)."""
    return ready(spark, sf).where("size(keywords) > 0").select("doc_id", diverse(F.col("keywords")).alias("kw"))


SUBQUERIES = ("reservoir gates", "pressure zones", "rain gauges")


def _sub_sql() -> str:
    parts = [fts_sql(f"f{i}", q) for i, q in enumerate(SUBQUERIES)]
    rows = " union all ".join(f"select doc_id, score from {norm_sql(f'f{i}')}" for i in range(len(SUBQUERIES)))
    return f"with {', '.join(parts)} select doc_id, round(max(score), 6) as relevance, count(*) as answers from ({rows}) group by doc_id having max(score) >= 0.4"


@R.add("research_quick", _sub_sql())
def research_quick(spark, sf):
    """Q13: a question's parts are searched, and each document counts by its best part, if that is relevant enough."""
    parts = [V.minmax(fts(spark, sf, q).select("doc_id", "score")) for q in SUBQUERIES]
    g = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.max("score").alias("best"), F.count("*").alias("answers"))
    return g.where("best >= 0.4").select("doc_id", F.round("best", 6).alias("relevance"), "answers")


def _deep_sql(enough: int = 10) -> str:
    parts = [fts_sql(f"f{i}", q) for i, q in enumerate(SUBQUERIES)]
    rows = [f"p{i} as (select * from {norm_sql(f'f{i}')} where score >= 0.4)" for i in range(len(SUBQUERIES))]
    so_far = lambda i: f"(select count(distinct doc_id) from ({' union all '.join(f'select doc_id from p{k}' for k in range(i))})) < {enough}"
    used = " union all ".join(f"select * from p{i}" + (" where " + " and ".join(so_far(k) for k in range(1, i + 1)) if i else "") for i in range(len(SUBQUERIES)))
    return f"with {', '.join(parts + rows)} select doc_id, round(max(score), 6) as score from ({used}) group by doc_id"


@R.add("research_deep", _deep_sql())
def research_deep(spark, sf, enough: int = 10, most_rounds: int = 3):
    """Q13 in rounds: the next part is searched until there are enough relevant documents. Only a count returns to the driver."""
    found = None
    for q in SUBQUERIES[:most_rounds]:
        own = V.minmax(fts(spark, sf, q).select("doc_id", "score")).where("score >= 0.4")
        found = own if found is None else found.union(own).groupBy("doc_id").agg(F.max("score").alias("score"))
        if found.count() >= enough:
            break
    return _out(found)


@R.add("browse", f"with {fts_sql('f')}, {aq_fts_sql('g')}, {aq_vec_sql('a')}, {vec_sql('v')}, h as ({rrf_sql(['g', 'a', 'v'])}) select '- ' || coalesce(title, '(untitled)') || ' [' || coalesce(source, 'unknown') || ']' as line from h join documents using (doc_id) where status = 'ready'")
def browse(spark, sf):
    """Q16: the question ranker's hits as lines of a list."""
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("(untitled)")), F.lit(" ["), F.coalesce("source", F.lit("unknown")), F.lit("]"))
    return ready(spark, sf).join(F.broadcast(rank_aq_rrf(spark, sf).select("doc_id")), "doc_id", "left_semi").select(line.alias("line"))


@R.add("probe_response", "with t as (select unnest(topics) as topic, doc_id, answers_questions as aq from documents where status = 'ready'), c as (select topic, count(distinct doc_id) as docs, count(distinct doc_id) * least(1.0, count(distinct doc_id) / 50.0) as weight from t group by topic having count(distinct doc_id) >= 5) select arg_max(topic, struct_pack(w := weight, t := topic)) as first_topic, count(*) as clusters, cast(sum(docs) as bigint) as docs from c where contains('who digs water archives and bees', topic)")
def probe_response(spark, sf):
    """Q12: the clusters that a context names and the one to ask first (most confidence x documents)."""
    g = ready(spark, sf).select(F.explode("topics").alias("topic"), "doc_id").groupBy("topic").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 5")
    hit = g.where(F.lit("who digs water archives and bees").contains(F.col("topic")))
    weight = F.col("docs") * F.least(F.lit(1.0), F.col("docs") / 50.0)
    return hit.agg(F.max_by("topic", F.struct(weight.alias("w"), "topic")).alias("first_topic"), F.count("*").alias("clusters"), F.sum("docs").alias("docs"))


QUERIES, SQL = R.queries, R.sql

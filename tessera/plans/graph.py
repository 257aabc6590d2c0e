"""Graph queries: edge builders, neighbours, intersections, bridges, traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.plans.registry import Registry
from tessera.sources.shared import kept
from tessera.sources.tables import corpus, table, vectors

R = Registry()
HUB, PINNED, FAR = 16, (16, 78, 552), 970
SEEDS = ("rain gauges", "water")


def edges(spark, sf):
    return table(spark, sf, "document_edges")


_BOTH = "(select source_id as src, target_id as dst, weight, rel_type from document_edges union all select target_id, source_id, weight, rel_type from document_edges)"


@R.add("neighbors", f"select dst, rel_type, weight from {_BOTH} where src = {HUB} order by weight desc nulls last, dst, rel_type limit 20")
def neighbors(spark, sf):
    return G.neighbors(edges(spark, sf), HUB)


@R.add("related", f"select src, count(*) as n, round(max(weight), 6) as best from {_BOTH} where src in ({', '.join(map(str, PINNED))}) group by src")
def related(spark, sf):
    """Edges of several documents, from the edge table."""
    return G.both_ways(edges(spark, sf)).where(F.col("src").isin(*PINNED)).groupBy("src").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("best"))


@R.add("intersect", f"select dst, count(distinct src) as overlap, round(avg(weight), 9) as avg_weight from {_BOTH} where src in ({', '.join(map(str, PINNED))}) and dst not in ({', '.join(map(str, PINNED))}) group by dst having count(distinct src) >= 1 order by overlap desc, avg_weight desc nulls last, dst limit 10")
def intersect(spark, sf):
    return G.intersect(edges(spark, sf), list(PINNED), 1).withColumn("avg_weight", F.round("avg_weight", 9))


@R.add(
    "intersect_directed",
    f"select target_id as dst, count(distinct source_id) as overlap from document_edges where source_id in ({', '.join(map(str, PINNED))}) and target_id not in ({', '.join(map(str, PINNED))}) group by 1 having count(distinct source_id) >= 1",
)
def intersect_directed(spark, sf):
    return G.intersect(edges(spark, sf), list(PINNED), 1, 1_000_000, directed=True).select("dst", "overlap")


@R.add(
    "bridge",
    f"""with recursive b as (select distinct src, dst from {_BOTH}), w as (select cast({HUB} as bigint) as dst, 0 as hop union select b.dst, w.hop + 1 from w join b on b.src = w.dst where w.hop < 5),
    f as (select dst, min(hop) as hop from w group by dst) select dst, hop from f where hop <= coalesce((select hop from f where dst = {FAR}), 5)""",
)
def bridge(spark, sf):
    """Hop counts up to the level of the target (paths are not unique)."""
    return G.bridge(edges(spark, sf), HUB, FAR).select("dst", "hop")


@R.add(
    "bridge_directed",
    f"""with recursive b as (select source_id as src, target_id as dst, max(coalesce(weight, 0)) as weight from document_edges group by all), w as (select cast({HUB} as bigint) as dst, 0 as hop union select b.dst, w.hop + 1 from w join b on b.src = w.dst where w.hop < 5),
    f as (select dst, min(hop) as hop from w group by dst), g as (select * from f where hop <= coalesce((select hop from f where dst = {FAR}), 5))
    select g.dst, g.hop, (select arg_max(b.src, struct_pack(w := b.weight, m := -b.src)) from b join g p on p.dst = b.src where b.dst = g.dst and p.hop = g.hop - 1) as parent from g""",
)
def bridge_directed(spark, sf):
    """G03 along the edges' direction, with the heaviest parent of each document."""
    return G.bridge(edges(spark, sf), HUB, FAR, directed=True)


_WALK = f"b as (select src, dst, max(coalesce(weight, 0)) as weight from {_BOTH} group by all)"


@R.add(
    "bridge_path",
    f"""with recursive {_WALK}, w as (select cast({HUB} as bigint) as dst, 0 as hop union select b.dst, w.hop + 1 from w join b on b.src = w.dst where w.hop < 5), f as (select dst, min(hop) as hop from w group by dst),
    g as (select f.dst, f.hop, (select arg_max(b.src, struct_pack(w := b.weight, m := -b.src)) from b join f p on p.dst = b.src where b.dst = f.dst and p.hop = f.hop - 1) as parent from f),
    r as (select hop, dst, parent from g where dst = {FAR} union all select g.hop, g.dst, g.parent from r join g on g.dst = r.parent) select hop as step, dst as doc_id from r""",
)
def bridge_path(spark, sf):
    """The documents on the way from one to the other."""
    return G.paths(G.bridge(edges(spark, sf), HUB, FAR), FAR)


_TERMS = "(select distinct doc_id, lower(t) as term from (select doc_id, unnest(list_concat(list_concat(keywords, entities), topics)) as t from documents) where length(t) >= 3)"
_KW = f"""with t as {_TERMS}, u as (select term from t group by term having count(*) between 2 and 500), k as (select t.* from t join u using (term)), n as (select doc_id, count(*) as n from k group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from k a join k b on a.term = b.term and a.doc_id < b.doc_id group by 1, 2),
    s as (select a, b, both_n / (na.n + nb.n - both_n) as weight from p join n na on na.doc_id = a join n nb on nb.doc_id = b where both_n / (na.n + nb.n - both_n) >= 0.05)
    select a, b, round(weight, 6) as weight from (select *, row_number() over (partition by a order by weight desc, b) as ra, row_number() over (partition by b order by weight desc, a) as rb from s) where ra <= 20 and rb <= 20"""


@R.add("edges_keyword", _KW)
def edges_keyword(spark, sf):
    return G.keyword_edges(corpus(spark, sf)).withColumn("weight", F.round("weight", 6))


@R.add("jaccard_self_join", f"select term, count(*) * (count(*) - 1) // 2 as pairs from {_TERMS} group by term having count(*) between 2 and 500")
def jaccard_self_join(spark, sf):
    """How many pairs each rare term contributes to the self-join (its cost, without making the pairs)."""
    t = corpus(spark, sf).select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("keywords", "entities", "topics"), lambda x: F.lower(x)))).alias("term")).where("length(term) >= 3")
    n = F.count("*")
    return t.groupBy("term").agg(n.alias("n")).where("n between 2 and 500").select("term", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))


_KNN = """with q as (select vec_id as src, embedding::double[] as a from embeddings where vec_id % 100 = 0), p as (select src, vec_id as dst, list_cosine_similarity(a, embedding::double[]) as cosine from q join embeddings on vec_id <> src),
    n as (select *, row_number() over (partition by src order by round(cosine, 9) desc, dst) as r from p where cosine >= 0.2)"""


@R.add("knn_join", f"{_KNN} select src, dst, round(cosine, 6) as cosine from n where r <= 10")
def knn_join(spark, sf):
    """Ten nearest of every hundredth vector among all."""
    v = vectors(spark, sf)
    return G.knn(v.where("doc_id % 100 = 0"), v, 10, 0.2).withColumn("cosine", F.round("cosine", 6))


@R.add("edges_vector", f"{_KNN} select least(src, dst) as source_id, greatest(src, dst) as target_id, round(max(least(cosine * 0.7, 1.0)), 6) as weight from n where r <= 10 group by 1, 2")
def edges_vector(spark, sf):
    v = vectors(spark, sf)
    return G.vector_edges(v.where("doc_id % 100 = 0"), v, 10, 0.2).withColumn("weight", F.round("weight", 6))


@R.add(
    "edges_incremental",
    f"""with t as {_TERMS}, u as (select term from t group by term having count(*) between 2 and 500), k as (select t.*, batch_no = 6 as is_new from t join u using (term) join documents using (doc_id)), n as (select doc_id, count(*) as n from k group by 1),
    p as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from k a join k b on a.term = b.term and a.doc_id < b.doc_id and (a.is_new or b.is_new) group by 1, 2)
    select a, b, round(both_n / (na.n + nb.n - both_n), 6) as weight from p join n na on na.doc_id = a join n nb on nb.doc_id = b where both_n / (na.n + nb.n - both_n) >= 0.05""",
)
def edges_incremental(spark, sf):
    """The edges of the last batch's documents, from the frequencies that the build before it left."""
    docs = corpus(spark, sf).select("doc_id", "batch_no", "keywords", "entities", "topics")
    state = kept(spark, f"{sf}/documents.parquet", "frequencies", lambda: G.frequencies(docs.where("coalesce(batch_no, 0) <> 6")))
    return G.incremental_edges(state, docs.where("batch_no = 6")).withColumn("weight", F.round("weight", 6))


def _jac(c: str) -> str:
    return f"case when len(list_distinct(list_concat({c}, s_{c}))) > 0 then len(list_distinct(list_intersect({c}, s_{c}))) / len(list_distinct(list_concat({c}, s_{c}))) else 0.0 end"


@R.add(
    "edges_typed",
    f"""with s as (select topics as s_topics, entities as s_entities, keywords as s_keywords from documents where doc_id = 2), p as (select doc_id, {_jac('topics')} as t, {_jac('entities')} as e, {_jac('keywords')} as k from documents, s where doc_id <> 2)
    select doc_id, case when t >= e and t >= k then 'same_topic' when k >= e then 'same_keyword' else 'same_entity' end as rel_type, round(greatest(t, e, k), 4) as weight from p where greatest(t, e, k) >= 0.05""",
)
def edges_typed(spark, sf):
    """One document against all; ties by the name of the type."""
    return G.typed_edges(corpus(spark, sf), 2)


_ALL_TERMS = "list_distinct(list_transform(list_concat(list_concat(topics, keywords), entities), lambda x: lower(x)))"
_HIT = f"len(list_filter({_ALL_TERMS}, lambda x: x in ({', '.join(repr(s) for s in SEEDS)})))"
_TRAVERSE = f"select * from (select doc_id, round(0.7 * {_HIT} / {len(SEEDS)} + 0.3 * {_HIT} / greatest(len({_ALL_TERMS}), 1), 4) as score from documents) where score > 0 order by score desc, doc_id limit 20"


@R.add("traverse_score", _TRAVERSE)
def traverse_score(spark, sf):
    return G.traverse_scores(corpus(spark, sf), list(SEEDS))


def _clusters_sql(factor: str) -> str:
    return f"""with a as ({_TRAVERSE}), t as (select doc_id, unnest({_ALL_TERMS}) as term from documents where doc_id in (select doc_id from a)), g as (select term, count(*) as df, list_sort(list(distinct doc_id))[1:2] as anchor from t where term not in ({', '.join(repr(s) for s in SEEDS)}) group by term),
    s as (select *, round(df / (select count(*) from a) * {factor}, 6) as score from g order by score desc, term limit 50) select array_to_string(anchor, ',') as anchor, count(*) as terms, round(max(score), 6) as best from s group by anchor"""


@R.add("next_clusters", _clusters_sql("1.0"))
def next_clusters(spark, sf):
    docs = corpus(spark, sf)
    return G.next_clusters(docs, list(SEEDS), G.traverse_scores(docs, list(SEEDS)))


@R.add("next_clusters_explore", _clusters_sql("(1 + 0.1 * df)"))
def next_clusters_explore(spark, sf):
    """G10 where exploring favours frequent terms."""
    docs = corpus(spark, sf)
    return G.next_clusters(docs, list(SEEDS), G.traverse_scores(docs, list(SEEDS)), explore=True)


@R.add("traversal_id", "select doc_id, left(md5(array_to_string(list_sort(keywords), '|')), 12) as traversal_id from documents where len(keywords) > 0")
def traversal_id(spark, sf):
    """The id of a set of seeds."""
    return corpus(spark, sf).where("size(keywords) > 0").select("doc_id", F.substring(F.md5(F.array_join(F.sort_array("keywords"), "|")), 1, 12).alias("traversal_id"))


@R.add("crawl_frontier", f"with recursive b as (select distinct src, dst from {_BOTH}), w as (select cast({HUB} as bigint) as dst, 0 as depth union select b.dst, w.depth + 1 from w join b on b.src = w.dst where w.depth < 2) select dst, min(depth) as depth from w group by dst order by depth, dst limit 100")
def crawl_frontier(spark, sf):
    """Breadth-first frontier of depth two, each page once, shallow first, up to a page limit."""
    return G.bridge(edges(spark, sf), HUB, -1, 2).select("dst", F.col("hop").alias("depth")).orderBy("depth", "dst").limit(100)


QUERIES, SQL = R.queries, R.sql

"""Scans, sinks, filters, joins, aggregates, windows, sorts and sets over the corpus tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunks as C
from tessera.operators import merge as M
from tessera.operators.graph import best_of_both
from tessera.plans.docproc import CHUNK_SQL
from tessera.plans.registry import Registry
from tessera.sources import files, sinks
from tessera.sources.shared import shared_dir
from tessera.sources.tables import DAY_US, HOUR_US, NOW_US, corpus, micros, ready, table

R = Registry()
SRC = "coalesce(nullif(source, ''), 'unknown')"


def source_name():
    return F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))


# Scans and sinks


@R.add("scan_ready", "select doc_id, title, source from documents where status = 'ready'")
def scan_ready(spark, sf):
    return ready(spark, sf).select("doc_id", "title", "source")


@R.add("scan_recent", "select doc_id, title from documents order by ingested_at desc, doc_id limit 50 offset 10")
def scan_recent(spark, sf):
    return corpus(spark, sf).orderBy(F.desc("ingested_at"), "doc_id").offset(10).limit(50).select("doc_id", "title")


@R.add("point_lookup", "select doc_id, url, title, status from documents where doc_id = 42")
def point_lookup(spark, sf):
    return corpus(spark, sf).where("doc_id = 42").select("doc_id", "url", "title", "status")


@R.add("chunk_scan", f"select * from ({CHUNK_SQL}) where doc_id = 7")
def chunk_scan(spark, sf):
    """The windows of one document, in order."""
    return C.windows(corpus(spark, sf).where("doc_id = 7"), 300, 120, 100).orderBy("chunk_index")


@R.add("format_dispatch", r"select doc_id, case when lower(url) like '%.pdf' then 'pdf' when regexp_matches(lower(url), '\.docx?$') then 'docx' when url is null then 'upload' else 'html' end as format from documents")
def format_dispatch(spark, sf):
    u = F.lower("url")
    return corpus(spark, sf).select("doc_id", F.when(u.endswith(".pdf"), "pdf").when(u.rlike(r"\.docx?$"), "docx").when(F.col("url").isNull(), "upload").otherwise("html").alias("format"))


@R.add("youtube_id", r"select doc_id, coalesce(nullif(regexp_extract(url, 'youtu\.be/([\w-]{11})', 1), ''), nullif(regexp_extract(url, 'youtube\.[a-z]+/watch\?v=([\w-]{11})', 1), ''), '') as video_id from documents where url is not null")
def youtube_id(spark, sf):
    return corpus(spark, sf).where("url is not null").select("doc_id", X.video_id(F.col("url")).alias("video_id"))


@R.add("remote_like", "select doc_id, title from documents where lower(title) like '%rain gauges%' or lower(summary) like '%rain gauges%' or list_contains(keywords, 'rain gauges') order by ingested_at desc, doc_id limit 25")
def remote_like(spark, sf):
    """The predicate a remote corpus is asked, newest first."""
    hit = F.lower("title").contains("rain gauges") | F.lower("summary").contains("rain gauges") | F.array_contains("keywords", "rain gauges")
    return corpus(spark, sf).where(hit).orderBy(F.desc("ingested_at"), "doc_id").limit(25).select("doc_id", "title")


@R.add("export_rows", "select doc_id, url, title, source, lang, status, topics, keywords, n_chars, epoch_us(ingested_at) as ingested_us, document_type from documents where status = 'ready'")
def export_rows(spark, sf):
    """The eleven exported fields."""
    return ready(spark, sf).select("doc_id", "url", "title", "source", "lang", "status", "topics", "keywords", "n_chars", micros("ingested_at").alias("ingested_us"), "document_type")


@R.add(
    "sink_upsert_doc",
    r"""with d as (select *, regexp_replace(lower(trim(url)), '[?#].*$', '') as k, epoch_us(published_at) as published_us from documents where url is not null),
    o as (select *, row_number() over (partition by k order by doc_id desc) as r from d)
    select k, max(title) filter (where r = 1) as title, max_by(summary, doc_id) filter (where trim(coalesce(summary, '')) <> '') as summary,
    case when max(case when status = 'ready' then 1 else 0 end) = 1 then 'ready' else max(status) filter (where r = 1) end as status, coalesce(min_by(published_us, doc_id) filter (where published_us is not null), -1) as published_us, count(*) as version from o group by k""",
)
def sink_upsert_doc(spark, sf):
    rows = corpus(spark, sf).where("url is not null").select(F.regexp_replace(F.lower(F.trim("url")), r"[?#].*$", "").alias("k"), "doc_id", "title", "summary", "status", micros("published_at").alias("published_us"))
    return M.upsert_documents(rows, "k", F.col("doc_id")).withColumn("published_us", F.coalesce("published_us", F.lit(-1).cast("long")))


@R.add("sink_upsert_edge", "select source_id, target_id, rel_type, max(weight) as weight from document_edges group by all")
def sink_upsert_edge(spark, sf):
    return M.upsert_edges(table(spark, sf, "document_edges"))


@R.add("sink_replace_children", "select doc_id, q from (select doc_id, unnest(answers_questions) as q from documents) where doc_id not in (select doc_id from documents where status = 'processing') union all select doc_id, coalesce(title, '') from documents where status = 'processing'")
def sink_replace_children(spark, sf):
    """Records that are processed again lose their old questions for a new one."""
    docs = corpus(spark, sf)
    new = docs.where("status = 'processing'").select("doc_id", F.coalesce("title", F.lit("")).alias("q"))
    return M.replace_children(docs.select("doc_id", F.explode("answers_questions").alias("q")), new, "doc_id")


# Round trips: written to the shared folder and read back


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@R.add("sink_bodies", "select doc_id, length(body_text) as chars from documents where body_text is not null")
def sink_bodies(spark, sf):
    """Bodies in folders by the hash of their id."""
    path = _folder(spark, "bodies")
    sinks.bodies(corpus(spark, sf), path, 16)
    return spark.read.schema("doc_id long, body_text string, shard string").parquet(path).select("doc_id", F.length("body_text").alias("chars"))


@R.add("sink_append_log", "select strftime(logged_at, '%Y-%m-%d') as day, count(*) as n, count(distinct id) as ids from query_log where logged_at is not null group by 1")
def sink_append_log(spark, sf):
    """Log rows in folders by day, appended in two parts: first the questions answered right, then the rest."""
    path, log = _folder(spark, "log"), table(spark, sf, "query_log").where("logged_at is not null").select("id", "logged_at", F.coalesce("correct", F.lit(False)).alias("good"))
    for part in (log.where("good"), log.where("not good")):
        sinks.append_log(part, path, "logged_at")
    rows = spark.read.schema("id long, logged_at timestamp, good boolean, day date").parquet(path)
    return rows.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@R.add("import_exported", "select doc_id, title, source, n_chars, len(topics) as topics from documents")
def import_exported(spark, sf):
    """Records exported as JSON lines and imported again."""
    path = _folder(spark, "export")
    sinks.export_lines(corpus(spark, sf), path)
    return files.import_lines(spark, path).select("doc_id", "title", "source", "n_chars", F.size("topics").alias("topics"))


@R.add("delete_cascade", "select source_id, target_id, rel_type, weight from document_edges where source_id not in (select doc_id from documents where status in ('failed', 'terminal')) and target_id not in (select doc_id from documents where status in ('failed', 'terminal'))")
def delete_cascade(spark, sf):
    gone = corpus(spark, sf).where("status in ('failed', 'terminal')").select("doc_id")
    return M.without(table(spark, sf, "document_edges").select("source_id", "target_id", "rel_type", "weight"), gone, "source_id", "target_id").select("source_id", "target_id", "rel_type", "weight")


# Filters and projections


@R.add("filter_quality", "select doc_id from documents where enrichment_quality_score is null or enrichment_quality_score >= 60")
def filter_quality(spark, sf):
    q = F.col("enrichment_quality_score")
    return corpus(spark, sf).where(q.isNull() | (q >= 60)).select("doc_id")


@R.add("filter_reading_level", "select doc_id from documents where document_type is null or document_type not in ('forum_post', 'other')")
def filter_reading_level(spark, sf):
    t = F.col("document_type")
    return corpus(spark, sf).where(t.isNull() | ~t.isin("forum_post", "other")).select("doc_id")


@R.add("filter_date_range", f"select doc_id from documents where epoch_us(ingested_at) >= {NOW_US - 180 * DAY_US} and epoch_us(ingested_at) <= {NOW_US - 30 * DAY_US}")
def filter_date_range(spark, sf):
    return corpus(spark, sf).where(micros("ingested_at").between(NOW_US - 180 * DAY_US, NOW_US - 30 * DAY_US)).select("doc_id")


@R.add("filter_published_range", f"select doc_id from documents where epoch_us(published_at) between {NOW_US - 365 * DAY_US} and {NOW_US}")
def filter_published_range(spark, sf):
    return corpus(spark, sf).where(micros("published_at").between(NOW_US - 365 * DAY_US, NOW_US)).select("doc_id")


@R.add("filter_source", "select doc_id from documents where lower(source) in ('harborline.example', 'kilnnotes.example')")
def filter_source(spark, sf):
    return corpus(spark, sf).where(F.lower("source").isin("harborline.example", "kilnnotes.example")).select("doc_id")


@R.add("filter_workspace", "select doc_id from documents d join (select distinct source from rss_feeds where corpus_id in ('main', 'trial')) f using (source) union select doc_id from documents where source in (select source from source_policies where source_type = 'public')")
def filter_workspace(spark, sf):
    """public sources or sources of the caller's corpora. The dimensions have a fixed size."""
    mine = table(spark, sf, "rss_feeds").where("corpus_id in ('main', 'trial')").select("source")
    public = table(spark, sf, "source_policies").where("source_type = 'public'").select("source")
    return corpus(spark, sf).join(F.broadcast(mine.union(public).distinct()), "source", "left_semi").select("doc_id")


@R.add("category_filter", "select doc_id from documents where source in (select source from source_policies where description like '%(news)' or description like '%(blog)')")
def category_filter(spark, sf):
    chosen = table(spark, sf, "source_policies").where("description like '%(news)' or description like '%(blog)'").select("source")
    return corpus(spark, sf).join(F.broadcast(chosen), "source", "left_semi").select("doc_id")


@R.add("find_by_topics", "select doc_id from documents where list_has_any(topics, ['retrieval', 'soils']) ")
def find_by_topics(spark, sf):
    return corpus(spark, sf).where(F.arrays_overlap("topics", F.array(F.lit("retrieval"), F.lit("soils")))).select("doc_id")


@R.add("find_by_keywords", "select doc_id from documents where list_has_any(keywords, ['query plans', 'rain gauges'])")
def find_by_keywords(spark, sf):
    return corpus(spark, sf).where(F.arrays_overlap("keywords", F.array(F.lit("query plans"), F.lit("rain gauges")))).select("doc_id")


@R.add("find_by_entities", "select doc_id from documents where len(list_filter(entities, lambda x: lower(x) like '%archive%')) > 0")
def find_by_entities(spark, sf):
    return corpus(spark, sf).where(F.exists("entities", lambda x: F.lower(x).contains("archive"))).select("doc_id")


@R.add(
    "list_my_documents",
    """select doc_id, status from (select * from documents order by ingested_at desc, doc_id limit 300) where status = 'ready' and contains(lower(concat_ws(' ', title, url, source, summary, author, array_to_string(topics, ' '))), 'archive') order by ingested_at desc, doc_id limit 100""",
)
def list_my_documents(spark, sf):
    text = F.lower(F.concat_ws(" ", "title", "url", "source", "summary", "author", F.array_join("topics", " ")))
    newest = corpus(spark, sf).orderBy(F.desc("ingested_at"), "doc_id").limit(300)
    return newest.where((F.col("status") == "ready") & text.contains("archive")).orderBy(F.desc("ingested_at"), "doc_id").limit(100).select("doc_id", "status")


@R.add(
    "doc_type_bucket",
    r"""select doc_id, case when u like '%youtube.%' or u like '%youtu.be%' then 'youtube' when s like '%podcast%' or s like '%radio%' or s like '%signal%' then 'podcast' when regexp_matches(u, '\.pdf($|[?#])') then 'pdf'
    when regexp_matches(u, '\.(docx?|xlsx?|pptx?|txt)($|[?#])') or s like '%upload%' then 'document' else 'website' end as bucket from (select doc_id, lower(coalesce(url, '')) as u, lower(coalesce(source, '')) as s from documents)""",
)
def doc_type_bucket(spark, sf):
    return corpus(spark, sf).select("doc_id", X.type_bucket(F.col("url"), F.col("source")).alias("bucket"))


_TOOL = "case when s like '%forum%' then 'forum' when s like '%upload%' then 'upload' when s like '%radio%' or s like '%signal%' then 'audio' else 'rss' end"


@R.add("ingest_tool_bucket", f"select doc_id, {_TOOL} as tool from (select doc_id, lower(coalesce(source, '')) as s from documents)")
def ingest_tool_bucket(spark, sf):
    return corpus(spark, sf).select("doc_id", X.tool_bucket(F.col("source")).alias("tool"))


_BLOCK = ("slowtram.example", "forum", "harborline.example.org")


_HOST = r"regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '')"


@R.add("source_blocklist", f"select doc_id from (select doc_id, lower(coalesce(source, '')) as s, {_HOST} as h from documents) where " + " or ".join(f"contains({c}, '{b}') or ({c} <> '' and contains('{b}', {c}))" for b in _BLOCK for c in "sh"))
def source_blocklist(spark, sf):
    """the source or the url's host (without www) contains a blocked name or is contained in one."""
    s, h, hit = F.lower(F.coalesce("source", F.lit(""))), F.regexp_replace(F.coalesce(X.url_host(F.col("url")), F.lit("")), r"^www\.", ""), F.lit(False)
    for b in _BLOCK:
        for c in (s, h):
            hit = hit | c.contains(b) | ((c != "") & F.lit(b).contains(c))
    return corpus(spark, sf).where(hit).select("doc_id")


@R.add("source_low_quality", "select doc_id from documents where ends_with(source, '.example') and (ends_with(source, 'notes.example') or ends_with('www.orbitdesk.example', source))")
def source_low_quality(spark, sf):
    s = F.col("source")
    return corpus(spark, sf).where(s.endswith(".example") & (s.endswith("notes.example") | F.lit("www.orbitdesk.example").endswith(s))).select("doc_id")


@R.add(
    "source_policy",
    f"""select doc_id, coalesce(p.source_type, case when lower(d.source) like '%forum%' then 'community' when lower(d.source) like '%upload%' then 'private' else 'public' end) as source_type, coalesce(p.rank_tier, 2) as rank_tier, coalesce(p.store_body, true) as store_body
    from documents d left join source_policies p on d.source = p.source""",
)
def source_policy(spark, sf):
    """registered policy, else hints of the name, else the default."""
    s = F.lower("source")
    hint = F.when(s.contains("forum"), "community").when(s.contains("upload"), "private").otherwise("public")
    joined = corpus(spark, sf).select("doc_id", "source").join(F.broadcast(table(spark, sf, "source_policies")), "source", "left")
    return joined.select("doc_id", F.coalesce("source_type", hint).alias("source_type"), F.coalesce("rank_tier", F.lit(2)).alias("rank_tier"), F.coalesce("store_body", F.lit(True)).alias("store_body"))


@R.add("corpus_access", "select doc_id from documents where source in (select source from rss_feeds where corpus_id = 'partner')")
def corpus_access(spark, sf):
    return corpus(spark, sf).join(F.broadcast(table(spark, sf, "rss_feeds").where("corpus_id = 'partner'").select("source").distinct()), "source", "left_semi").select("doc_id")


_WALLED = "(contains(lower(coalesce(text, '')), 'subscribe to') or contains(lower(coalesce(text, '')), 'sign in again'))"


@R.add(
    "pending_claimable",
    f"select doc_id from documents left join (select source as p, min(rank_tier) as tier from source_policies group by 1) on p = source where status = 'pending' and (not {_WALLED} or length(trim(coalesce(body_text, ''), ' ')) >= 500) order by coalesce(tier, 2), ingested_at, doc_id limit 50",
)
def pending_claimable(spark, sf):
    """what may be claimed, the best tier first, then the oldest: not behind a paywall, or with a body all the same."""
    t = F.lower(F.coalesce("text", F.lit("")))
    walled = t.contains("subscribe to") | t.contains("sign in again")
    tier = table(spark, sf, "source_policies").groupBy("source").agg(F.min("rank_tier").alias("tier"))
    docs = corpus(spark, sf).where((F.col("status") == "pending") & (~walled | (F.length(F.trim(F.coalesce("body_text", F.lit("")))) >= 500)))
    return docs.select("doc_id", "source", "ingested_at").join(F.broadcast(tier), "source", "left").orderBy(F.coalesce("tier", F.lit(2)), "ingested_at", "doc_id").limit(50).select("doc_id")


@R.add("feeds_due", f"select id from rss_feeds where enabled and (last_polled_at is null or epoch_us(last_polled_at) + poll_interval_minutes::bigint * 60000000 < {NOW_US})")
def feeds_due(spark, sf):
    due = F.col("last_polled_at").isNull() | (micros("last_polled_at") + F.col("poll_interval_minutes").cast("long") * F.lit(60_000_000) < NOW_US)
    return table(spark, sf, "rss_feeds").where(F.col("enabled") & due).select("id")


@R.add("projection_hide_aq", "select doc_id, title, summary, topics from documents where status = 'ready'")
def projection_hide_aq(spark, sf):
    """the public view has no answers_questions."""
    return ready(spark, sf).select("doc_id", "title", "summary", "topics")


_DEG = "(select id, count(*) as degree from (select source_id as id from document_edges union all select target_id from document_edges) group by id)"


def degrees(spark, sf):
    """Edges at each document, in and out."""
    e = table(spark, sf, "document_edges")
    return e.select(F.col("source_id").alias("id")).union(e.select("target_id")).groupBy("id").agg(F.count("*").alias("degree"))


@R.add("project_keywords_if_hub", f"select d.doc_id, case when coalesce(degree, 0) >= 3 then keywords else [] end as keywords from documents d left join {_DEG} g on d.doc_id = g.id")
def project_keywords_if_hub(spark, sf):
    g = degrees(spark, sf).withColumnRenamed("id", "doc_id")
    return corpus(spark, sf).join(g, "doc_id", "left").select("doc_id", F.when(F.coalesce("degree", F.lit(0)) >= 3, F.col("keywords")).otherwise(F.array().cast("array<string>")).alias("keywords"))


# Joins


@R.add("edge_doc_join", "select e.source_id as doc_id, d.doc_id as other, rel_type, weight from document_edges e join documents d on d.doc_id = e.target_id where d.status = 'ready' union all select e.target_id, d.doc_id, rel_type, weight from document_edges e join documents d on d.doc_id = e.source_id where d.status = 'ready'")
def edge_doc_join(spark, sf):
    e, d = table(spark, sf, "document_edges"), ready(spark, sf).select("doc_id")
    ends = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("other"), "rel_type", "weight").union(e.select("target_id", "source_id", "rel_type", "weight"))
    return ends.join(d.withColumnRenamed("doc_id", "other"), "other").select(F.col("a").alias("doc_id"), "other", "rel_type", "weight")


_HUB = f"""select topic, doc_id, degree from (select topic, doc_id, degree, row_number() over (partition by topic order by degree desc, doc_id) as r from
    (select unnest(topics) as topic, doc_id, coalesce(degree, 0) as degree from documents d left join {_DEG} g on d.doc_id = g.id where status = 'ready')) where r = 1"""


@R.add("lateral_hub", _HUB)
def lateral_hub(spark, sf):
    """The best connected document of each topic (max_by is combined map-side; no window over a hot topic)."""
    g = degrees(spark, sf).withColumnRenamed("id", "doc_id")
    rows = ready(spark, sf).select("doc_id", F.explode("topics").alias("topic")).join(g, "doc_id", "left").select("topic", "doc_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    best = rows.groupBy("topic").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("m"))).alias("b"))
    return best.select("topic", (-F.col("b.m")).alias("doc_id"), "b.degree")


@R.add("join_using", "select source, count(*) as docs, max(rank_tier) as rank_tier from documents join source_policies using (source) group by source")
def join_using(spark, sf):
    return corpus(spark, sf).join(F.broadcast(table(spark, sf, "source_policies")), on=["source"]).groupBy("source").agg(F.count("*").alias("docs"), F.max("rank_tier").alias("rank_tier"))


@R.add("error_doc_join", "select d.source, e.step, count(*) as errors from pipeline_errors e join documents d using (doc_id) where not e.resolved group by all")
def error_doc_join(spark, sf):
    return table(spark, sf, "pipeline_errors").where("not resolved").join(corpus(spark, sf).select("doc_id", "source"), "doc_id").groupBy("source", "step").agg(F.count("*").alias("errors"))


@R.add("not_in_anti", "select target_id, count(*) as n from document_edges where target_id not in (select doc_id from documents where status <> 'ready') group by 1")
def not_in_anti(spark, sf):
    other = corpus(spark, sf).where("status <> 'ready'").select(F.col("doc_id").alias("target_id"))
    return table(spark, sf, "document_edges").join(other, "target_id", "left_anti").groupBy("target_id").agg(F.count("*").alias("n"))


@R.add("in_subquery_semi", "select doc_id, status from documents where doc_id in (select doc_id from pipeline_errors where not resolved)")
def in_subquery_semi(spark, sf):
    return corpus(spark, sf).join(table(spark, sf, "pipeline_errors").where("not resolved").select("doc_id"), "doc_id", "left_semi").select("doc_id", "status")


@R.add("exists_semi", "select source_id, target_id, rel_type from document_edges e where exists (select 1 from documents d where d.doc_id = e.source_id and d.status = 'ready') and exists (select 1 from documents d where d.doc_id = e.target_id and d.status = 'ready')")
def exists_semi(spark, sf):
    d = ready(spark, sf).select("doc_id")
    e = table(spark, sf, "document_edges").select("source_id", "target_id", "rel_type")
    return e.join(d.withColumnRenamed("doc_id", "source_id"), "source_id", "left_semi").join(d.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "rel_type")


@R.add("scalar_cross", "select source, count(*) as docs, round(count(*) / (select count(*) from documents), 6) as share from documents group by source")
def scalar_cross(spark, sf):
    by = corpus(spark, sf).groupBy("source").agg(F.count("*").alias("docs"))
    return by.crossJoin(F.broadcast(corpus(spark, sf).agg(F.count("*").alias("n")))).select("source", "docs", F.round(F.col("docs") / F.col("n"), 6).alias("share"))  # one row


# Aggregates


@R.add("count_by_status", "select status, count(*) as docs from documents group by status")
def count_by_status(spark, sf):
    return corpus(spark, sf).groupBy("status").agg(F.count("*").alias("docs"))


@R.add("crawl_sessions", "select crawl_session, count(*) as docs, count(*) filter (where status = 'ready') as ready, count(*) filter (where status = 'failed') as failed, min(epoch_us(ingested_at)) as first_us, max(epoch_us(ingested_at)) as last_us from documents group by 1")
def crawl_sessions(spark, sf):
    t = micros("ingested_at")
    return corpus(spark, sf).groupBy("crawl_session").agg(
        F.count("*").alias("docs"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status") == "failed").alias("failed"), F.min(t).alias("first_us"), F.max(t).alias("last_us")
    )


@R.add("corpus_sources", f"select {SRC} as src, count(*) as docs, count(*) filter (where status = 'ready') as ready from documents group by 1 order by docs desc, src limit 200")
def corpus_sources(spark, sf):
    return corpus(spark, sf).groupBy(source_name().alias("src")).agg(F.count("*").alias("docs"), F.count_if(F.col("status") == "ready").alias("ready")).orderBy(F.desc("docs"), "src").limit(200)


_PROFILE = """count(*) as docs, count(*) filter (where enrichment_quality_score >= 80) as q80, count(*) filter (where enrichment_quality_score >= 50 and enrichment_quality_score < 80) as q50, count(*) filter (where enrichment_quality_score >= 20 and enrichment_quality_score < 50) as q20,
    round(avg(length(summary)), 4) as avg_summary, round(avg(len(answers_questions)), 4) as avg_aq, round(avg(n_chars), 4) as avg_chars"""


def _profile():
    q = F.col("enrichment_quality_score")
    return [
        F.count("*").alias("docs"), F.count_if(q >= 80).alias("q80"), F.count_if((q >= 50) & (q < 80)).alias("q50"), F.count_if((q >= 20) & (q < 50)).alias("q20"),
        F.round(F.avg(F.length("summary")), 4).alias("avg_summary"), F.round(F.avg(F.size("answers_questions")), 4).alias("avg_aq"), F.round(F.avg("n_chars"), 4).alias("avg_chars"),
    ]


@R.add("corpus_quality", f"select {_PROFILE} from documents")
def corpus_quality(spark, sf):
    return corpus(spark, sf).agg(*_profile())


@R.add("quality_by_source", f"select {SRC} as src, {_PROFILE} from documents where status = 'ready' group by 1 order by docs desc, src limit 50")
def quality_by_source(spark, sf):
    return ready(spark, sf).groupBy(source_name().alias("src")).agg(*_profile()).orderBy(F.desc("docs"), "src").limit(50)


@R.add("quality_extended", "select count(*) filter (where length(summary) >= 100) as good, count(*) filter (where length(summary) between 1 and 99) as stub, count(*) filter (where coalesce(summary, '') = '') as none, count(*) filter (where len(answers_questions) > 0) as with_aq, count(*) filter (where len(answers_questions) = 0) as empty_aq from documents")
def quality_extended(spark, sf):
    n, a = F.length("summary"), F.size("answers_questions")
    return corpus(spark, sf).agg(
        F.count_if(n >= 100).alias("good"), F.count_if(n.between(1, 99)).alias("stub"), F.count_if(F.coalesce("summary", F.lit("")) == "").alias("none"), F.count_if(a > 0).alias("with_aq"), F.count_if(a == 0).alias("empty_aq")
    )


@R.add(
    "chunk_stats",
    f"""with c as ({CHUNK_SQL}), per as (select doc_id, count(*) as n, avg(length(chunk)) as a from c group by 1)
    select count(*) as docs, cast(sum(n) as bigint) as chunks, round(sum(n * a) / sum(n), 4) as avg_chars, round(avg(n), 4) as avg_chunks from per""",
)
def chunk_stats(spark, sf):
    """Per document and over all chunks (chunk-weighted, as the averages are re-joined to chunks)."""
    c = C.windows(corpus(spark, sf), 300, 120, 100)
    per = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.length("chunk")).alias("a"))
    return per.agg(F.count("*").alias("docs"), F.sum("n").alias("chunks"), F.round(F.sum(F.col("n") * F.col("a")) / F.sum("n"), 4).alias("avg_chars"), F.round(F.avg("n"), 4).alias("avg_chunks"))


@R.add("chunk_status", "select count(*) filter (where n_chars = 0) as none, count(*) filter (where n_chars between 1 and 1999) as one, count(*) filter (where n_chars >= 2000) as several from documents")
def chunk_status(spark, sf):
    n = F.col("n_chars")
    return corpus(spark, sf).agg(F.count_if(n == 0).alias("none"), F.count_if(n.between(1, 1999)).alias("one"), F.count_if(n >= 2000).alias("several"))


@R.add("ingest_stats", f"with m as (select max(epoch_us(ingested_at)) as m from documents) select count(*) as docs, count(distinct source) as sources, count(*) filter (where epoch_us(ingested_at) > m - {DAY_US}) as last_day, count(*) filter (where epoch_us(ingested_at) > m - {7 * DAY_US}) as last_week from documents, m")
def ingest_stats(spark, sf):
    t = micros("ingested_at")
    newest = corpus(spark, sf).agg(F.max(t).alias("m"))
    return corpus(spark, sf).crossJoin(F.broadcast(newest)).agg(  # one row
        F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.count_if(t > F.col("m") - DAY_US).alias("last_day"), F.count_if(t > F.col("m") - 7 * DAY_US).alias("last_week")
    )


@R.add("ingest_tool_stats", f"select {_TOOL} as tool, count(*) as docs, count(*) filter (where status = 'failed') as failed, round(100.0 * count(*) filter (where status = 'failed') / count(*), 2) as fail_rate from (select *, lower(coalesce(source, '')) as s from documents) group by 1")
def ingest_tool_stats(spark, sf):
    failed = F.count_if(F.col("status") == "failed")
    return corpus(spark, sf).groupBy(X.tool_bucket(F.col("source")).alias("tool")).agg(F.count("*").alias("docs"), failed.alias("failed"), F.round(100.0 * failed / F.count("*"), 2).alias("fail_rate"))


@R.add("tool_error_breakdown", f"select {_TOOL} as tool, step, lower(error_type) as kind, count(*) as errors from (select e.*, lower(coalesce(source, '')) as s from pipeline_errors e join documents using (doc_id)) group by all")
def tool_error_breakdown(spark, sf):
    e = table(spark, sf, "pipeline_errors").join(corpus(spark, sf).select("doc_id", "source"), "doc_id")
    return e.groupBy(X.tool_bucket(F.col("source")).alias("tool"), "step", F.lower("error_type").alias("kind")).agg(F.count("*").alias("errors"))


@R.add("health_counts", f"select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'processing') as processing, count(*) filter (where status = 'ready' and vec_id is not null) as embedded, count(*) filter (where epoch_us(ingested_at) > {NOW_US - DAY_US}) as recent, count(*) filter (where epoch_us(ingested_at) > {NOW_US - 30 * 60_000_000}) as m30, count(*) filter (where epoch_us(ingested_at) > {NOW_US - 5 * 60_000_000}) as m5 from documents left join embeddings on vec_id = doc_id")
def health_counts(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    d, s = corpus(spark, sf).join(v, "doc_id", "left"), F.col("status")
    return d.agg(F.count_if(s == "pending").alias("pending"), F.count_if(s == "processing").alias("processing"), F.count_if((s == "ready") & F.col("has")).alias("embedded"), *[F.count_if(micros("ingested_at") > NOW_US - span).alias(n) for n, span in (("recent", DAY_US), ("m30", 30 * 60_000_000), ("m5", 5 * 60_000_000))])


@R.add("ingest_windows", f"select {SRC} as src, count(*) filter (where epoch_us(ingested_at) > {NOW_US - DAY_US // 24}) as h1, count(*) filter (where epoch_us(ingested_at) > {NOW_US - DAY_US}) as d1, count(*) filter (where epoch_us(ingested_at) > {NOW_US - 7 * DAY_US}) as d7 from documents group by 1 order by d7 desc, src limit 20")
def ingest_windows(spark, sf):
    t = micros("ingested_at")
    return corpus(spark, sf).groupBy(source_name().alias("src")).agg(F.count_if(t > NOW_US - DAY_US // 24).alias("h1"), F.count_if(t > NOW_US - DAY_US).alias("d1"), F.count_if(t > NOW_US - 7 * DAY_US).alias("d7")).orderBy(F.desc("d7"), "src").limit(20)


STEPS = ("fetch", "validate", "enrich", "embed", "chunk", "edges")


@R.add(
    "error_stats",
    "with s as (select unnest([" + ", ".join(f"'{s}'" for s in STEPS) + f"""]) as step), e as (select step, count(distinct doc_id) as failed from pipeline_errors where not resolved and epoch_us(created_at) > {NOW_US - 90 * DAY_US} group by step),
    n as (select count(*) as docs from documents where status = 'ready') select s.step, coalesce(failed, 0) as failed, round(100.0 * coalesce(failed, 0) / (docs + coalesce(failed, 0)), 4) as rate, 100.0 * coalesce(failed, 0) / (docs + coalesce(failed, 0)) > 5 as alarm from s left join e using (step), n""",
)
def error_stats(spark, sf):
    """Failed documents, rate and alarm (5 %) of each step."""
    steps = table(spark, sf, "pipeline_errors").sparkSession.createDataFrame([(s,) for s in STEPS], "step string")
    e = table(spark, sf, "pipeline_errors").where((~F.col("resolved")) & (micros("created_at") > NOW_US - 90 * DAY_US)).groupBy("step").agg(F.count_distinct("doc_id").alias("failed"))
    n = ready(spark, sf).agg(F.count("*").alias("docs"))
    failed = F.coalesce("failed", F.lit(0))
    rate = 100.0 * failed / (F.col("docs") + failed)
    return steps.join(e, "step", "left").crossJoin(F.broadcast(n)).select("step", failed.alias("failed"), F.round(rate, 4).alias("rate"), (rate > 5).alias("alarm"))  # one row


@R.add("service_ingest", f"select source, count(*) as docs from documents where source like 'k%' and epoch_us(ingested_at) > {NOW_US - 60 * DAY_US} group by 1")
def service_ingest(spark, sf):
    return corpus(spark, sf).where(F.col("source").like("k%") & (micros("ingested_at") > NOW_US - 60 * DAY_US)).groupBy("source").agg(F.count("*").alias("docs"))


@R.add("token_doc_freq", "select lower(t) as term, count(distinct doc_id) as df from (select doc_id, unnest(list_concat(list_concat(keywords, entities), topics)) as t from documents) where length(t) >= 3 group by 1")
def token_doc_freq(spark, sf):
    rows = corpus(spark, sf).select("doc_id", F.explode(F.array_distinct(F.transform(F.concat("keywords", "entities", "topics"), lambda x: F.lower(x)))).alias("term"))
    return rows.where(F.length("term") >= 3).groupBy("term").agg(F.count("*").alias("df"))


@R.add("edge_degree", f"select id, degree from {_DEG}")
def edge_degree(spark, sf):
    return degrees(spark, sf)


@R.add(
    "capability_clusters",
    f"""with t as (select unnest(topics) as topic, doc_id, coalesce(degree, 0) as degree, answers_questions as aq from documents d left join (select source_id as id, count(*) as degree from document_edges group by 1) g on d.doc_id = g.id where status = 'ready'),
    c as (select topic, count(distinct doc_id) as docs from t group by 1 having count(distinct doc_id) >= 5), h as (select topic, doc_id, row_number() over (partition by topic order by degree desc, doc_id) as r from t),
    q as (select topic, list(q order by q)[1:5] as samples from (select distinct topic, unnest(aq) as q from t) group by 1)
    select topic, docs, h.doc_id as hub, round(least(1.0, docs / 50.0), 6) as confidence, samples from c join h using (topic) left join q using (topic) where r = 1 order by docs desc, topic limit 200""",
)
def capability_clusters(spark, sf):
    """Topics with five documents or more; the samples are the first five questions, kept by a bounded aggregate."""
    g = table(spark, sf, "document_edges").groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("degree"))
    t = ready(spark, sf).select("doc_id", F.explode("topics").alias("topic"), "answers_questions").join(g, "doc_id", "left")
    key = F.struct(F.coalesce("degree", F.lit(0)), (-F.col("doc_id")).alias("m"))
    c = t.groupBy("topic").agg(F.count_distinct("doc_id").alias("docs"), F.max(key).alias("b")).where("docs >= 5")
    q = t.select("topic", F.explode("answers_questions").alias("q")).distinct()
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy("q"))).where("r <= 5").groupBy("topic").agg(F.sort_array(F.collect_list("q")).alias("samples"))
    out = c.join(q, "topic", "left").select("topic", "docs", (-F.col("b.m")).alias("hub"), F.round(F.least(F.lit(1.0), F.col("docs") / 50.0), 6).alias("confidence"), "samples")
    return out.orderBy(F.desc("docs"), "topic").limit(200)


@R.add(
    "gap_report",
    """select topic, count(distinct doc_id) as docs, round(avg(case when coalesce(summary, '') <> '' then 1.0 else 0.0 end), 6) as with_summary, case when count(distinct doc_id) < 10 then 'major' when avg(case when coalesce(summary, '') <> '' then 1.0 else 0.0 end) < 0.5 then 'major'
    when avg(case when coalesce(summary, '') <> '' then 1.0 else 0.0 end) < 0.8 or count(distinct doc_id) < 50 then 'moderate' else 'minor' end as severity from (select unnest(topics) as topic, doc_id, summary from documents) group by 1""",
)
def gap_report(spark, sf):
    some = F.avg(F.when(F.coalesce("summary", F.lit("")) != "", 1.0).otherwise(0.0))
    docs = F.count_distinct("doc_id")
    rows = corpus(spark, sf).select(F.explode("topics").alias("topic"), "doc_id", "summary").groupBy("topic").agg(docs.alias("docs"), some.alias("s"))
    s, n = F.col("s"), F.col("docs")
    return rows.select("topic", "docs", F.round("s", 6).alias("with_summary"), F.when((n < 10) | (s < 0.5), "major").when((s < 0.8) | (n < 50), "moderate").otherwise("minor").alias("severity"))


@R.add(
    "intersection_agg",
    """with p as (select target_id, source_id, sum(weight) as w, count(*) as n from document_edges where weight is not null group by all), g as (select target_id, count(*) as overlap, round(sum(w) / sum(n), 9) as avg_weight from p group by 1 having count(*) >= 3)
    select target_id, overlap, avg_weight, source_id from g join p using (target_id)""",
)
def intersection_agg(spark, sf):
    """One row for each source of a target that has three or more (a hub's sources aren't collected in one row)."""
    pair = table(spark, sf, "document_edges").where("weight is not null").groupBy("target_id", "source_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    g = pair.groupBy("target_id").agg(F.count("*").alias("overlap"), F.round(F.sum("w") / F.sum("n"), 9).alias("avg_weight")).where("overlap >= 3")
    return pair.join(g, "target_id").select("target_id", "overlap", "avg_weight", "source_id")


@R.add("alternate_term_freq", "select term, count(*) as freq from (select distinct doc_id, lower(term) as term from (select doc_id, unnest(keywords) as term from documents where list_contains(topics, 'retrieval'))) group by 1 having count(*) >= 2 order by freq desc, term limit 10")
def alternate_term_freq(spark, sf):
    rows = corpus(spark, sf).where(F.array_contains("topics", "retrieval")).select("doc_id", F.explode(F.array_distinct(F.transform("keywords", lambda x: F.lower(x)))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("freq")).where("freq >= 2").orderBy(F.desc("freq"), "term").limit(10)


@R.add("category_hints", "select coalesce(document_type, 'none') as category, count(*) as docs, round(count(*) / sum(count(*)) over (), 6) as share, count(*) / sum(count(*)) over () > 0.5 as suggest from documents where list_has_any(keywords, ['rain gauges', 'query plans', 'wax sheets']) group by 1")
def category_hints(spark, sf):
    hit = corpus(spark, sf).where(F.arrays_overlap("keywords", F.array(*[F.lit(k) for k in ("rain gauges", "query plans", "wax sheets")])))
    c = hit.groupBy(F.coalesce("document_type", F.lit("none")).alias("category")).agg(F.count("*").alias("docs"))
    whole = F.sum("docs").over(Window.partitionBy())  # one row per category: a handful
    return c.select("category", "docs", F.round(F.col("docs") / whole, 6).alias("share"), (F.col("docs") / whole > 0.5).alias("suggest"))


@R.add("coverage_signal", "select topic, count(*) as docs, case when count(*) >= 50 then 'deep' when count(*) >= 20 then 'moderate' else 'sparse' end as coverage from (select unnest(topics) as topic from documents where status = 'ready') group by 1")
def coverage_signal(spark, sf):
    g = ready(spark, sf).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("docs"))
    return g.select("topic", "docs", F.when(F.col("docs") >= 50, "deep").when(F.col("docs") >= 20, "moderate").otherwise("sparse").alias("coverage"))


@R.add("access_anomaly", f"with m as (select max(epoch_us(ts)) as m from query_log) select session_id, count(*) filter (where epoch_us(ts) > m - {30 * DAY_US}) as last, count(*) // 24 as usual from query_log, m where session_id is not null group by 1 having count(*) filter (where epoch_us(ts) > m - {30 * DAY_US}) > 3 * greatest(count(*) // 24, 1)")
def access_anomaly(spark, sf):
    t = micros("ts")
    log = table(spark, sf, "query_log").where("session_id is not null")
    newest = table(spark, sf, "query_log").agg(F.max(t).alias("m"))
    g = log.crossJoin(F.broadcast(newest)).groupBy("session_id").agg(F.count_if(t > F.col("m") - 30 * DAY_US).alias("last"), F.floor(F.count("*") / 24).alias("usual"))  # one row
    return g.where(F.col("last") > 3 * F.greatest("usual", F.lit(1)))


@R.add("daily_usage", f"select session_id, epoch_us(ts) // {DAY_US} as day, count(distinct id) as queries from query_log where session_id is not null group by all")
def daily_usage(spark, sf):
    """Queries per session and day; rows delivered twice count once."""
    return table(spark, sf, "query_log").where("session_id is not null").groupBy("session_id", F.floor(micros("ts") / DAY_US).alias("day")).agg(F.count_distinct("id").alias("queries"))


@R.add("facts_by_question", "with f as (select distinct lower(trim(question)) as q, source || ':' || id as fact from query_log where model = 'reader-large' and correct and question is not null) select q, fact, count(*) over (partition by q) as facts from f")
def facts_by_question(spark, sf):
    """A question's facts, a row for each, with their number (a question asked by all isn't collected in one row)."""
    rows = table(spark, sf, "query_log").where("model = 'reader-large' and correct and question is not null").select(F.lower(F.trim("question")).alias("q"), F.concat("source", F.lit(":"), "id").alias("fact")).distinct()
    return rows.join(rows.groupBy("q").agg(F.count("*").alias("facts")), "q")


@R.add("doc_type_distinct", "select distinct document_type from documents where document_type is not null")
def doc_type_distinct(spark, sf):
    return corpus(spark, sf).where("document_type is not null").select("document_type").distinct()


@R.add("queue_depth", "select (select count(*) from documents where status = 'pending') as pending, (select count(*) from documents where status = 'ready' and doc_id not in (select vec_id from embeddings)) as not_embedded")
def queue_depth(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    a = corpus(spark, sf).where("status = 'pending'").agg(F.count("*").alias("pending"))
    return a.crossJoin(ready(spark, sf).join(v, "doc_id", "left_anti").agg(F.count("*").alias("not_embedded")))  # one row each


@R.add("usage_cost", "select coalesce(model, 'unknown') as model_name, count(*) as queries, sum(input_tokens)::bigint as tokens_in, sum(output_tokens)::bigint as tokens_out, cast(round(sum(cost_usd), 6) as double) as usd from (select distinct on (id) * from query_log order by id, logged_at) group by 1")
def usage_cost(spark, sf):
    """Over distinct rows (the log delivers some twice)."""
    one = table(spark, sf, "query_log").groupBy("id").agg(*[F.min_by(c, "logged_at").alias(c) for c in ("model", "input_tokens", "output_tokens", "cost_usd")])
    return one.groupBy(F.coalesce("model", F.lit("unknown")).alias("model_name")).agg(
        F.count("*").alias("queries"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.round(F.sum("cost_usd"), 6).cast("double").alias("usd")
    )


# Windows, sorts and sets


@R.add("topk_per_side", "with e as (select source_id, target_id, max(weight) as weight from document_edges where weight is not null group by all) select source_id, target_id, weight from (select *, row_number() over (partition by source_id order by weight desc, target_id) as a, row_number() over (partition by target_id order by weight desc, source_id) as b from e) where a <= 2 and b <= 2")
def topk_per_side(spark, sf):
    e = table(spark, sf, "document_edges").where("weight is not null").groupBy("source_id", "target_id").agg(F.max("weight").alias("weight"))
    return best_of_both(e, "source_id", "target_id", 2)


@R.add("topk_global", "select source_id, target_id, rel_type, weight from document_edges order by weight desc nulls last, source_id, target_id, rel_type limit 40")
def topk_global(spark, sf):
    return table(spark, sf, "document_edges").orderBy(F.desc_nulls_last("weight"), "source_id", "target_id", "rel_type").limit(40).select("source_id", "target_id", "rel_type", "weight")


@R.add("distinct_on_best", "select source, arg_max(doc_id, struct_pack(a := enrichment_quality_score, b := -doc_id)) as doc_id, max(enrichment_quality_score) as score from documents where enrichment_quality_score is not null and source <> '' group by 1")
def distinct_on_best(spark, sf):
    rows = corpus(spark, sf).where("enrichment_quality_score is not null and source <> ''")
    b = rows.groupBy("source").agg(F.max(F.struct("enrichment_quality_score", (-F.col("doc_id")).alias("m"))).alias("b"))
    return b.select("source", (-F.col("b.m")).alias("doc_id"), F.col("b.enrichment_quality_score").alias("score"))


@R.add("max_normalise", "select id, round(coalesce(elapsed_ms, 0) / max(elapsed_ms) over (), 4) as norm from (select * from query_log order by elapsed_ms desc, id limit 100)")
def max_normalise(spark, sf):
    top = table(spark, sf, "query_log").orderBy(F.desc_nulls_last("elapsed_ms"), "id").limit(100)
    return top.select("id", F.round(F.coalesce("elapsed_ms", F.lit(0)) / F.max("elapsed_ms").over(Window.partitionBy()), 4).alias("norm"))  # over 100 rows


@R.add("multi_key_sort", "select target_id, count(*) as n, round(avg(weight), 9) as w from document_edges group by 1 order by n desc, w desc nulls last, target_id limit 30")
def multi_key_sort(spark, sf):
    g = table(spark, sf, "document_edges").groupBy("target_id").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 9).alias("w"))
    return g.orderBy(F.desc("n"), F.desc_nulls_last("w"), "target_id").limit(30)


@R.add("coalesce_sort", "select doc_id from documents order by coalesce(published_at, ingested_at) desc, doc_id limit 30")
def coalesce_sort(spark, sf):
    return corpus(spark, sf).orderBy(F.desc(F.coalesce("published_at", "ingested_at")), "doc_id").limit(30).select("doc_id")


@R.add("explore_interleave", "select doc_id, r from (select doc_id, row_number() over (order by enrichment_quality_score desc, doc_id) as r from (select * from documents where enrichment_quality_score is not null order by enrichment_quality_score desc, doc_id limit 100)) where r <= 50 or r % 2 = 1")
def explore_interleave(spark, sf):
    """The upper half and every second of the rest, of the 100 best."""
    top = corpus(spark, sf).where("enrichment_quality_score is not null").orderBy(F.desc("enrichment_quality_score"), "doc_id").limit(100)
    r = F.row_number().over(Window.orderBy(F.desc("enrichment_quality_score"), "doc_id"))  # over 100 rows
    return top.select("doc_id", r.alias("r")).where("r <= 50 or r % 2 = 1")


@R.add("union_all_edges", "select source_id as a, target_id as b from document_edges union all select target_id, source_id from document_edges")
def union_all_edges(spark, sf):
    e = table(spark, sf, "document_edges")
    return e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(e.select("target_id", "source_id"))


@R.add("distinct_sources", "select distinct source from documents")
def distinct_sources(spark, sf):
    return corpus(spark, sf).select("source").distinct()


@R.add("ordered_dedupe", "select d, min(pos) as pos from (select id, unnest(docs_returned) as d, generate_subscripts(docs_returned, 1) as pos from query_log) group by 1")
def ordered_dedupe(spark, sf):
    """Of repeats the first place counts."""
    return table(spark, sf, "query_log").select(F.posexplode("docs_returned").alias("p", "d")).groupBy("d").agg((F.min("p") + 1).cast("long").alias("pos"))


@R.add("set_algebra", "select doc_id, list_sort(list_distinct(list_intersect(keywords, ['rain gauges', 'query plans']))) as both_in, len(list_distinct(list_concat(topics, keywords))) as either, len(list_filter(list_distinct(keywords), lambda x: not list_contains(topics, x))) as only_kw from documents")
def set_algebra(spark, sf):
    q = F.array(F.lit("rain gauges"), F.lit("query plans"))
    return corpus(spark, sf).select("doc_id", F.sort_array(F.array_intersect("keywords", q)).alias("both_in"), F.size(F.array_union("topics", "keywords")).alias("either"), F.size(F.array_except("keywords", "topics")).alias("only_kw"))


# Logs


@R.add("query_log_recent", "select id from (select distinct on (id) id, ts, session_id from query_log order by id, logged_at) where session_id is not null order by ts desc, id limit 50")
def query_log_recent(spark, sf):
    one = table(spark, sf, "query_log").where("session_id is not null").groupBy("id").agg(F.min("ts").alias("ts"))
    return one.orderBy(F.desc("ts"), "id").limit(50).select("id")


@R.add("rate_limit", "select session_id, epoch_us(ts) // 60000000 as minute, count(*) as n from query_log where session_id is not null group by all having count(*) >= 2")
def rate_limit(spark, sf):
    g = table(spark, sf, "query_log").where("session_id is not null").groupBy("session_id", F.floor(micros("ts") / 60_000_000).alias("minute")).agg(F.count("*").alias("n"))
    return g.where("n >= 2")


@R.add("rolling_health", f"with w as (select unnest([1, 6, 24]) as hours), m as (select max(epoch_us(created_at)) as m from pipeline_errors) select hours, count(*) filter (where epoch_us(created_at) > m - hours * {HOUR_US}) as errors from w, m, pipeline_errors group by 1")
def rolling_health(spark, sf):
    t = micros("created_at")
    e = table(spark, sf, "pipeline_errors").crossJoin(F.broadcast(table(spark, sf, "pipeline_errors").agg(F.max(t).alias("m"))))  # one row
    age = F.col("m") - t
    one = e.agg(*[F.count_if(age < h * HOUR_US).alias(str(h)) for h in (1, 6, 24)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(str(h)).alias("errors")) for h in (1, 6, 24)])).alias("x")).select("x.hours", "x.errors")


@R.add("reap_stuck", f"select doc_id, case when status = 'processing' and epoch_us(ingested_at) < {NOW_US - DAY_US} then 'pending' else status end as status_new from documents")
def reap_stuck(spark, sf):
    stuck = (F.col("status") == "processing") & (micros("ingested_at") < NOW_US - DAY_US)
    return corpus(spark, sf).select("doc_id", F.when(stuck, "pending").otherwise(F.col("status")).alias("status_new"))


@R.add("uploads_with_error", "select d.doc_id, arg_max(e.step, e.created_at) as step from documents d left join pipeline_errors e on e.doc_id = d.doc_id and not e.resolved where d.status = 'failed' group by 1")
def uploads_with_error(spark, sf):
    e = table(spark, sf, "pipeline_errors").where("not resolved").select("doc_id", "step", "created_at")
    return corpus(spark, sf).where("status = 'failed'").select("doc_id").join(e, "doc_id", "left").groupBy("doc_id").agg(F.max_by("step", "created_at").alias("step"))


@R.add("recent_enriched", "select doc_id, len(answers_questions) as aq, doc_id in (select vec_id from embeddings) as has_vector, left(summary, 120) as preview from documents where enrichment_quality_score is not null order by ingested_at desc, doc_id limit 5")
def recent_enriched(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has"))
    top = corpus(spark, sf).where("enrichment_quality_score is not null").orderBy(F.desc("ingested_at"), "doc_id").limit(5)
    return top.join(v, "doc_id", "left").select("doc_id", F.size("answers_questions").alias("aq"), F.coalesce("has", F.lit(False)).alias("has_vector"), F.substring("summary", 1, 120).alias("preview"))


@R.add("inspect_document", f"select d.doc_id, title, status, n_chars, coalesce(len(embedding), 0) as dims, coalesce(degree, 0) as edges from documents d left join embeddings on vec_id = doc_id left join {_DEG} g on g.id = d.doc_id")
def inspect_document(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dims"))
    d = corpus(spark, sf).join(v, "doc_id", "left").join(degrees(spark, sf).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return d.select("doc_id", "title", "status", "n_chars", F.coalesce("dims", F.lit(0)).alias("dims"), F.coalesce("degree", F.lit(0)).alias("edges"))


QUERIES, SQL = R.queries, R.sql

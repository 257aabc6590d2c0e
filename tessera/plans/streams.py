"""Streaming-shaped queries: each drains a stream and is compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.docproc import CHUNK_SQL
from tessera.plans.registry import Registry
from tessera.sources.tables import HOUR_US
from tessera.streaming import streams as S

R = Registry()


@R.add("stream_tumbling", f"select epoch_us(ts) // {HOUR_US} * {HOUR_US} as start_us, event_type, count(*) as n from events group by all")
def stream_tumbling(spark, sf):
    return S.drained(S.tumbling(S.events(spark, sf)), "update", keys=("start_us", "event_type"))


@R.add("stream_sliding", f"select s * {HOUR_US // 2} as start_us, count(*) as n, count(*) filter (where event_type = 'error') as errors from (select event_type, unnest([epoch_us(ts) // {HOUR_US // 2}, epoch_us(ts) // {HOUR_US // 2} - 1]) as s from events) group by s")
def stream_sliding(spark, sf):
    return S.drained(S.sliding(S.events(spark, sf)), "update", keys=("start_us",))


@R.add(
    "stream_sessions",
    f"""select user_id, min(t) as start_us, count(*) as n from (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as s from (select user_id, event_id, epoch_us(ts) as t,
    case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= {HOUR_US // 2} then 1 else 0 end as new from events)) group by user_id, s""",
)
def stream_sessions(spark, sf):
    return S.drained(S.sessions(S.events(spark, sf)), "complete")


@R.add("stream_first_deliveries", "select distinct id from query_log")
def stream_first_deliveries(spark, sf):
    return S.drained(S.first_deliveries(S.stream(spark, sf, "query_log").select("id", "logged_at"))).select("id")


@R.add("claim_pending", "select doc_id, 'processing' as status_new from documents where status = 'pending'")
def claim_pending(spark, sf):
    return S.drained(S.claims(S.stream(spark, sf, "documents").select("doc_id", "status")))


@R.add("stream_latest_state", "select source, arg_max(status, epoch_us(ingested_at)) as status from documents group by source")
def stream_latest_state(spark, sf):
    """The latest state of each source from its stream of records."""
    rows = S.stream(spark, sf, "documents").select("source", "status", F.unix_micros("ingested_at").alias("order_us"))
    return S.drained(S.upserted(rows, "source", ["status"]), "update", keys=("source",))


@R.add("chunk_worker", f"select * from ({CHUNK_SQL}) where doc_id in (select doc_id from documents where status = 'ready')")
def chunk_worker(spark, sf):
    """Ready documents as a stream, cut into windows."""
    from tessera.operators import chunks as C

    return S.drained(C.windows(S.stream(spark, sf, "documents").where("status = 'ready'").select("doc_id", "title", "text"), 300, 120, 100))


@R.add("cluster_refresh", "select topic, count(*) as docs from (select unnest(topics) as topic from documents where status = 'ready') group by topic")
def cluster_refresh(spark, sf):
    """A triggered rebuild of the topic table from what the stream has brought."""
    rows = S.stream(spark, sf, "documents").where("status = 'ready'").select(F.explode("topics").alias("topic"))
    return S.drained(rows.groupBy("topic").agg(F.count("*").alias("docs")), "update", keys=("topic",))


QUERIES, SQL = R.queries, R.sql

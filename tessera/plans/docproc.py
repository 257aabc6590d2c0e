"""Document-processing queries: URLs, gates, flags, scores, chunks, classes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunks as C
from tessera.plans.registry import Registry
from tessera.sources.tables import DAY_US, NOW_US, corpus, micros, ready, table

R = Registry()

_URL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(https?://)www\.', '\1'), '([?&])utm_[^&#]*', '\1', 'g'), '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+#', '#', 'g'), '[?&]+$', ''), '/+$', '')"


@R.add("normalize_url", f"select doc_id, {_URL} as url_norm from documents where url is not null")
def normalize_url(spark, sf):
    return corpus(spark, sf).where("url is not null").select("doc_id", X.normalize_url(F.col("url")).alias("url_norm"))


@R.add(
    "doc_uuid",
    f"""select doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[((strpos('0123456789abcdef', h[17]) - 1) & 3) + 1] || h[18:20] || '-' || h[21:32] as uuid
    from (select doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({_URL})) as h from documents where url is not null)""",
)
def doc_uuid(spark, sf):
    """Deterministic ids; checked against uuid5 in the tests too."""
    return corpus(spark, sf).where("url is not null").select("doc_id", X.doc_uuid(X.normalize_url(F.col("url"))).alias("uuid"))


@R.add("url_host", "select doc_id, regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#:]+)', 1) as host from documents where url is not null")
def url_host(spark, sf):
    return corpus(spark, sf).where("url is not null").select("doc_id", X.url_host(F.col("url")).alias("host"))


@R.add(
    "extract_links",
    r"""with l as (select distinct doc_id, regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#:]+)', 1) as own, regexp_replace(unnest(regexp_extract_all(text, 'https?://[^\s<>)\]]+')), '#.*$', '') as link from documents where text is not null)
    select distinct doc_id, link, coalesce(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1) = own, false) as same_host from l""",
)
def extract_links(spark, sf):
    """Absolute links of a text without fragments and repeats, and whether they stay on the document's host."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"https?://[^\s<>)\]]+"), F.lit(0)), lambda x: F.regexp_replace(x, "#.*$", "")))
    rows = corpus(spark, sf).where("text is not null").select("doc_id", X.url_host(F.col("url")).alias("own"), F.explode(found).alias("link"))
    return rows.select("doc_id", "link", F.coalesce(X.url_host(F.col("link")) == F.col("own"), F.lit(False)).alias("same_host"))


@R.add("title_or_first_line", r"select doc_id, left(coalesce(nullif(trim(title), ''), trim(string_split(coalesce(text, ''), chr(10))[1])), 120) as title120 from documents")
def title_or_first_line(spark, sf):
    """The title, else the first line, at most 120 characters."""
    first = F.trim(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)))
    return corpus(spark, sf).select("doc_id", F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), first), 1, 120).alias("title120"))


_PAY = "case when t like '%javascript%' and length(t) < 400 then 'metered' when t like '%subscribe to%' or t like '%sign in again%' then 'soft' when length(trim(t)) < 200 then 'hard' else 'none' end"


def _paywall():
    t = F.lower(F.coalesce("text", F.lit("")))
    return F.when(t.contains("javascript") & (F.length(t) < 400), "metered").when(t.contains("subscribe to") | t.contains("sign in again"), "soft").when(F.length(F.trim(t)) < 200, "hard").otherwise("none")


@R.add("paywall_web", f"select doc_id, {_PAY} as paywall from (select doc_id, lower(coalesce(text, '')) as t from documents)")
def paywall_web(spark, sf):
    return corpus(spark, sf).select("doc_id", _paywall().alias("paywall"))


@R.add(
    "paywall_rss",
    r"""select doc_id, case when words < 150 and s < 50 then 'hard' when regexp_matches(lower(coalesce(text, '')), 'members only|continue reading|subscribe|abonnez|suscríbete') then 'soft' else 'none' end as paywall
    from (select *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> '')) as words, length(coalesce(summary, '')) as s from documents)""",
)
def paywall_rss(spark, sf):
    words, s = F.size(X.words_of(F.coalesce("text", F.lit("")))), F.length(F.coalesce("summary", F.lit("")))
    kind = F.when((words < 150) & (s < 50), "hard").when(F.lower(F.coalesce("text", F.lit(""))).rlike("members only|continue reading|subscribe|abonnez|suscríbete"), "soft").otherwise("none")
    return corpus(spark, sf).select("doc_id", kind.alias("paywall"))


@R.add(
    "paywall_class",
    f"""select doc_id, case when paywall = 'none' then 'normal' when n = 0 then 'terminal_no_body' when n < 500 then 'terminal_stub' else 'enrich_normal' end as class
    from (select doc_id, {_PAY} as paywall, length(regexp_replace(b, '^\\s+|\\s+$', '', 'g')) as n from (select doc_id, lower(coalesce(text, '')) as t, coalesce(body_text, '') as b from documents))""",
)
def paywall_class(spark, sf):
    return corpus(spark, sf).select("doc_id", X.paywall_class(_paywall(), F.col("body_text")).alias("class"))


@R.add(
    "published_url",
    r"""select doc_id, case when y <> '' and y <= '2030' then y || '-' || m || '-' || case when d = '' then '01' else d end end as published from (
    select doc_id, regexp_extract(url, '/(20[0-3]\d)/(0[1-9]|1[0-2])(?:/|$)', 1) as y, regexp_extract(url, '/(20[0-3]\d)/(0[1-9]|1[0-2])(?:/|$)', 2) as m, regexp_extract(url, '/20[0-3]\d/(?:0[1-9]|1[0-2])/([0-2]\d|3[01])(?:/|$)', 1) as d
    from documents where url is not null)""",
)
def published_url(spark, sf):
    return corpus(spark, sf).where("url is not null").select("doc_id", X.published_in_url(F.col("url")).alias("published"))


_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = f"list_filter(regexp_split_to_array(b, '{_WS}+'), lambda x: x <> '')"
_LINES = "list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_GATE = f"""case when length(b) < 200 then 'too_short' when length(b) > 5000000 then 'too_long' when len({_WORDS}) < 40 then 'too_few_words'
    when {" or ".join(f"contains(lower(left(b, 200)), '{p}')" for p in X.BOILERPLATE)} then 'boilerplate'
    when length(regexp_replace(b, '[^\\p{{L}}]', '', 'g')) / length(b) < 0.5 then 'not_alphabetic' when length(regexp_replace(b, '[\\p{{L}}\\p{{N}}\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', '', 'g')) / length(b) > 0.35 then 'noisy'
    when len({_LINES}) >= 10 and 1 - len(list_distinct({_LINES})) / len({_LINES}) > 0.6 then 'repetitive'
    when length(t) < 3 then 'no_title' when {" or ".join(f"regexp_matches(lower(t), '{p}')" for p in X.GENERIC_TITLES)} then 'generic_title' else 'ok' end"""


@R.add("content_gate", f"select doc_id, {_GATE} as gate from (select doc_id, trim(coalesce(body_text, '')) as b, trim(coalesce(title, '')) as t from documents)")
def content_gate(spark, sf):
    return corpus(spark, sf).select("doc_id", X.content_gate(F.col("body_text"), F.col("title")).alias("gate"))


_FLAGS = f"""list_filter([case when length(s) < 50 then 'summary_short' end, case when length(s) > 5000 then 'summary_long' end, case when length(s) >= 150 and starts_with(coalesce(body_text, ''), left(s, 150)) then 'body_bleed' end,
    case when len(q) < 2 then 'few_questions' end, case when len(q) > 20 then 'many_questions' end, case when len(list_filter(q, lambda x: length(x) < 15)) > 0 then 'short_question' end,
    case when len(list_filter(q, lambda x: regexp_matches(lower(x), '{"|".join(X.GENERIC_QUESTIONS)}'))) > 0 then 'generic_question' end,
    case when len(list_distinct(list_transform(q, lambda x: lower(x)))) < len(q) then 'duplicate_question' end], lambda x: x is not null)"""


@R.add("enrich_flags", f"select doc_id, unnest({_FLAGS}) as flag from (select doc_id, coalesce(summary, '') as s, body_text, answers_questions as q from documents)")
def enrich_flags(spark, sf):
    return corpus(spark, sf).select("doc_id", F.explode(X.enrich_flags(F.col("summary"), F.col("body_text"), F.col("answers_questions"))).alias("flag"))


def _case(expr: str, *pairs: tuple[int, int]) -> str:
    return "(case " + " ".join(f"when {expr} >= {a} then {b}" for a, b in pairs) + " else 0 end)"


_QUALITY = "least(100, " + " + ".join([
    _case("length(coalesce(body_text, ''))", (3000, 35), (1500, 28), (800, 20), (300, 10)), _case("len(keywords)", (8, 20), (5, 15), (3, 10), (1, 5)), _case("len(entities)", (5, 20), (3, 15), (1, 8)),
    _case("len(answers_questions)", (5, 15), (3, 12), (1, 6)), _case("length(coalesce(summary, ''))", (200, 10), (100, 7), (40, 4)),
]) + ")"


@R.add("quality_score", f"select doc_id, cast({_QUALITY} as int) as score from documents")
def quality_score(spark, sf):
    return corpus(spark, sf).select("doc_id", X.quality_score(F.col("body_text"), F.col("keywords"), F.col("entities"), F.col("answers_questions"), F.col("summary")).cast("int").alias("score"))


CHUNK_SQL = f"""with w as (select doc_id, coalesce(title, '') as title, text as b, {_WORDS} as w from (select doc_id, title, text, text as b from documents where text is not null)),
    k as (select *, len(w) as n from w where len(w) > 0),
    c as (select doc_id, title, b, w, n, unnest(range(case when n < 300 then 1 else cast(ceil(n / 100.0) as int) end)) as chunk_index, case when n < 300 then 1 else cast(ceil(n / 100.0) as int) end as chunks from k)
    select doc_id, cast(chunk_index as int) as chunk_index, case when chunks = 1 and n < 300 then b else title || ' (' || (chunk_index + 1) || '/' || chunks || ')' || chr(10) || array_to_string(w[chunk_index * 100 + 1 : chunk_index * 100 + 120], ' ') end as chunk from c"""


@R.add("chunk_windows", CHUNK_SQL)
def chunk_windows(spark, sf):
    """D12, at a tenth of the default sizes so that the corpus has documents of several windows."""
    return C.windows(corpus(spark, sf), whole=300, size=120, step=100)


@R.add(
    "embed_text",
    """select doc_id, concat_ws(chr(10), 'Title: ' || coalesce(title, ''), 'Summary: ' || coalesce(summary, ''), case when len(answers_questions) > 0 then 'Questions: ' || array_to_string(answers_questions[1:6], ' ') end) as embed_text from documents""",
)
def embed_text(spark, sf):
    q = F.col("answers_questions")
    parts = [F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("Summary: "), F.coalesce("summary", F.lit(""))), F.when(F.size(q) > 0, F.concat(F.lit("Questions: "), F.array_join(F.slice(q, 1, 6), " ")))]
    return corpus(spark, sf).select("doc_id", F.concat_ws("\n", *parts).alias("embed_text"))


@R.add("tokenize", r"select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(title), '[\s\-_/.,]+'), lambda x: length(x) > 2)) as term from documents where title is not null")
def tokenize(spark, sf):
    """The distinct terms of each title."""
    return corpus(spark, sf).where("title is not null").select("doc_id", F.explode(X.term_set(F.col("title"))).alias("term"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@R.add(
    "kw_freq",
    rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]{{3,}}')) as term from documents), c as (select doc_id, term, count(*) as n from t where term not in ({_STOP}) group by all)
    select doc_id, term, n, cast(r as int) as r from (select *, row_number() over (partition by doc_id order by n desc, term) as r from c) where r <= 15""",
)
def kw_freq(spark, sf):
    """The 15 most frequent terms of each document."""
    return C.frequent_terms(corpus(spark, sf), 15)


@R.add(
    "topics_frequent",
    rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}]{{3,}}')) as term from documents), c as (select doc_id, term, count(*) as n from t where term not in ({_STOP}) and length(term) >= 5 group by all)
    select doc_id, term as topic from (select *, row_number() over (partition by doc_id order by n desc, term) as r from c) where r <= 8""",
)
def topics_frequent(spark, sf):
    """D16 without a language model: the eight most frequent longer terms."""
    return C.frequent_terms(corpus(spark, sf), 8, 5).select("doc_id", F.col("term").alias("topic"))


@R.add(
    "entities_spans",
    r"""with e as (select doc_id, lower(unnest(regexp_extract_all(text, '[\p{Lu}][\p{L}]+(?: [\p{Lu}][\p{L}]+)+'))) as entity from documents where text is not null), c as (select doc_id, entity, count(*) as n from e group by all)
    select doc_id, entity, n from (select *, row_number() over (partition by doc_id order by n desc, entity) as r from c) where r <= 20""",
)
def entities_spans(spark, sf):
    """D17 without a language model: the twenty most frequent spans of capitalised words of each document."""
    span = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{Lu}][\p{L}]+(?: [\p{Lu}][\p{L}]+)+"), F.lit(0)))
    counts = corpus(spark, sf).where("text is not null").select("doc_id", span.alias("e")).groupBy("doc_id", F.lower("e").alias("entity")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "entity"))
    return counts.withColumn("r", rank).where("r <= 20").select("doc_id", "entity", "n")


def _in(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@R.add(
    "sentiment_lexicon",
    rf"""select doc_id, case when p + n > 0 then round((p - n) / (p + n), 4) else 0.0 end as sentiment_score from (select doc_id, len(list_filter(t, lambda x: list_contains({_in(X.POSITIVE)}, x))) as p, len(list_filter(t, lambda x: list_contains({_in(X.NEGATIVE)}, x))) as n
    from (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from documents where text is not null))""",
)
def sentiment_lexicon(spark, sf):
    return corpus(spark, sf).where("text is not null").select("doc_id", X.sentiment(F.col("text")).cast("double").alias("sentiment_score"))


@R.add("summary_extract")
def summary_extract(spark, sf):
    """Leading sentences (tested against Python; the split needs a look-behind that the SQL engine lacks)."""
    return corpus(spark, sf).where("text is not null").select("doc_id", X.lead_summary(F.col("text")).alias("lead"))


@R.add(
    "apply_result",
    """select doc_id, coalesce(nullif(trim(summary), ''), left(text, 100)) as summary_new, case when len(keywords) > 0 then keywords[1:10] else topics end as keywords_new, case when enrichment_quality_score is not null then greatest(0, least(100, enrichment_quality_score)) else -1 end as score_new from documents""",
)
def apply_result(spark, sf):
    """What is not empty wins, field by field, with caps."""
    kw = F.when(F.size("keywords") > 0, F.slice("keywords", 1, 10)).otherwise(F.col("topics"))
    score = F.when(F.col("enrichment_quality_score").isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.col("enrichment_quality_score").cast("int")))).otherwise(F.lit(-1))
    return corpus(spark, sf).select("doc_id", F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.substring("text", 1, 100)).alias("summary_new"), kw.alias("keywords_new"), score.alias("score_new"))


@R.add("route_backend", "select doc_id, case when n_chars < 800 then 'small' when n_chars > 4000 then 'large' when document_type in ('academic_paper', 'documentation') then 'careful' else 'default' end as backend from documents")
def route_backend(spark, sf):
    """The first rule that matches."""
    rules = [("small", F.col("n_chars") < 800), ("large", F.col("n_chars") > 4000), ("careful", F.col("document_type").isin("academic_paper", "documentation"))]
    return corpus(spark, sf).select("doc_id", C.first_rule(rules, "default").alias("backend"))


@R.add("language_gate", "select doc_id, case when lang = 'en' then status when lang is null then status else 'terminal' end as status_new from documents")
def language_gate(spark, sf):
    """D23 on the given language; unknown languages pass."""
    return corpus(spark, sf).select("doc_id", F.when(F.col("lang").isNull() | (F.col("lang") == "en"), F.col("status")).otherwise("terminal").alias("status_new"))


_COUNTS = ", ".join(f"struct_pack(n := len(list_filter(t, lambda x: x in ({', '.join(repr(w) for w in own)}))), l := '{name}')" for name, own in X.LANGUAGE_WORDS.items())


@R.add(
    "language_detect",
    rf"""with d as (select doc_id, lang, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from documents where text is not null), b as (select doc_id, lang, list_max([{_COUNTS}]) as b from d)
    select doc_id, case when b.n > 0 then b.l end as detected, coalesce(case when b.n > 0 then b.l end <> 'en', false) as terminal from b""",
)
def language_detect(spark, sf):
    """The language of each text by its frequent words; what isn't English ends there."""
    d = corpus(spark, sf).where("text is not null").select("doc_id", X.language(F.col("text")).alias("detected"))
    return d.select("doc_id", "detected", F.coalesce(F.col("detected") != "en", F.lit(False)).alias("terminal"))


@R.add("pii_scan", "select doc_id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in X.PII.items()) + "], lambda x: x is not null)) as kind from documents where text is not null")
def pii_scan(spark, sf):
    return corpus(spark, sf).where("text is not null").select("doc_id", F.explode(X.pii_kinds(F.col("text"))).alias("kind"))


@R.add("retention", f"select doc_id, case when status = 'ready' and epoch_us(ingested_at) < {NOW_US - 90 * DAY_US} then 'expired' else status end as status_new from documents")
def retention(spark, sf):
    old = (F.col("status") == "ready") & (micros("ingested_at") < NOW_US - 90 * DAY_US)
    return corpus(spark, sf).select("doc_id", F.when(old, "expired").otherwise(F.col("status")).alias("status_new"))


_ERR = "case when m like '%validation%' then 'validation' when m like '%429%' or m like '%rate limit%' then 'rate_limit' when m like '%timeout%' or m like '%timed out%' then 'timeout' when m like '%parse%' or m like '%json%' then 'parse' else 'unknown' end"


@R.add("error_classify", f"select id, {_ERR} as class, lower(error_type) as given from (select *, lower(coalesce(message, '')) as m from pipeline_errors)")
def error_classify(spark, sf):
    return table(spark, sf, "pipeline_errors").select("id", X.error_class(F.col("message")).alias("class"), F.lower("error_type").alias("given"))


@R.add(
    "validate_steps",
    """select doc_id, summary is not null and length(trim(summary)) between 20 and 5000 as ok_summary, len(topics) between 1 and 8 as ok_topics, len(entities) <= 10 as ok_entities, len(answers_questions) between 1 and 20 as ok_questions from documents""",
)
def validate_steps(spark, sf):
    """A check column for each step's output."""
    n = lambda c, a, b: F.size(c).between(a, b)
    return corpus(spark, sf).select(
        "doc_id", (F.col("summary").isNotNull() & F.length(F.trim("summary")).between(20, 5000)).alias("ok_summary"), n("topics", 1, 8).alias("ok_topics"), (F.size("entities") <= 10).alias("ok_entities"),
        n("answers_questions", 1, 20).alias("ok_questions"),
    )


@R.add("js_page_detect", "select doc_id from documents where length(coalesce(body_text, '')) < 200 and (lower(body_text) like '%javascript%' or lower(body_text) like '%noscript%' or lower(body_text) like '%scripts%')")
def js_page_detect(spark, sf):
    b = F.lower("body_text")
    return corpus(spark, sf).where((F.length(F.coalesce("body_text", F.lit(""))) < 200) & (b.contains("javascript") | b.contains("noscript") | b.contains("scripts"))).select("doc_id")


@R.add(
    "duration_parse",
    r"""with t as (select doc_id, unnest(regexp_extract_all(text, '(?m)^\[(\d\d:\d\d:\d\d)\]', 1)) as stamp from documents where document_type = 'audio_transcript')
    select doc_id, max(cast(split_part(stamp, ':', 1) as bigint) * 3600 + cast(split_part(stamp, ':', 2) as bigint) * 60 + cast(split_part(stamp, ':', 3) as bigint)) as seconds from t group by doc_id""",
)
def duration_parse(spark, sf):
    """The last stamp of a transcript in seconds."""
    stamps = F.regexp_extract_all("text", F.lit(r"(?m)^\[(\d\d:\d\d:\d\d)\]"), F.lit(1))
    rows = corpus(spark, sf).where("document_type = 'audio_transcript'").select("doc_id", F.explode(stamps).alias("stamp"))
    return rows.groupBy("doc_id").agg(F.max(X.duration_seconds(F.col("stamp"))).alias("seconds"))


@R.add("content_hash", "select sha256(text) as hash, count(*) as copies, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) > 1")
def content_hash(spark, sf):
    rows = corpus(spark, sf).where("text is not null").select(F.sha2("text", 256).alias("hash"), "doc_id")
    return rows.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@R.add("prompt_cache_key", "select sha256(question) as hash, coalesce(model, '') as model_name, min(id) as id from query_log group by all")
def prompt_cache_key(spark, sf):
    """One entry per prompt hash and model, the earliest row's."""
    return table(spark, sf, "query_log").groupBy(F.sha2("question", 256).alias("hash"), F.coalesce("model", F.lit("")).alias("model_name")).agg(F.min("id").alias("id"))


@R.add("redact_fields", r"select id, regexp_replace(regexp_replace(message, '[0-9a-f]{8,}', '***', 'g'), '\d{3,}', '***', 'g') as message_safe from pipeline_errors")
def redact_fields(spark, sf):
    """Long ids and numbers of log messages masked."""
    return table(spark, sf, "pipeline_errors").select("id", F.regexp_replace(F.regexp_replace("message", "[0-9a-f]{8,}", "***"), r"\d{3,}", "***").alias("message_safe"))


@R.add("json_repair")
def json_repair(spark, sf):
    """Broken objects of the records' fields, repaired; the breakage is a rule of doc_id."""
    broken = C.broken_json(ready(spark, sf))
    return C.repair_json(broken)


QUERIES, SQL = R.queries, R.sql

"""Problem 3: lines that come back in many records of one source.

Copies of a document are collapsed first: one row for each distinct body of a source (the same body but for white
space, digits and case) with its records and publication dates, so that an article published again a hundred times is
one cluster whose lines are spread once. Each line of a source then carries its records, its clusters, the span of its
dates and how many of its clusters were published on other days than the first. TESTDATA.md fixes the cases of
``p3_found`` by records (a line in >= ``least`` records and >= ``share`` of the source's records). ``p3_boilerplate``
decides by the method's own counts: clusters and dates take the records' part, so a line that came back only because
its article was published again is none.

Plan: a scan and a shuffle of line-key arrays by body (never of text), a map-side combine and a shuffle of 128-bit line
keys, a scan for the places. The flagged keys of a source are at most (mean distinct lines per record) / ``share``;
they are broadcast only if their counted number is within ``BROADCAST_ROWS``, else joined by shuffle.

Defined cases: null or blank source or null body -> no row. Empty body -> counts as a record, has no line. Repeated
rows count as records each. A line twice in one record counts once, both places are cases. Lines without a letter
are never cases. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, documents, stored

BROADCAST_ROWS = 1_000_000


def line_keys(body, source):
    """Array of the lines' keys (two 64-bit hashes of source and normalised line), null for lines without a letter."""
    plain = F.lower(F.regexp_replace(body, rf"[[{WHITE}\p{{Nd}}]&&[^\n]]+", ""))
    return F.transform(
        F.split(plain, "\n"),
        lambda x: F.when(x.rlike(r"\p{L}"), F.struct(F.xxhash64(source, x).alias("h"), F.xxhash64(x, F.lit(3), source).alias("g"))),
    )


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("body_text").isNotNull() & (F.trim("source") != ""))


def clusters(df: DataFrame) -> DataFrame:
    """source_key, body, keys, n_records, first_date, last_date of every distinct body of a source.

    A body is known by its lines' keys in order; those of copies are equal, so any of them stands for all.
    """
    each = usable(df).select(F.xxhash64("source").alias("source_key"), line_keys(F.col("body_text"), F.col("source")).alias("lines"), F.to_date("published_at").alias("day"))
    body = F.struct(F.xxhash64("lines").alias("h"), F.xxhash64(F.lit(5), "lines").alias("g"))
    each = each.select("source_key", body.alias("body"), F.array_compact(F.array_distinct("lines")).alias("keys"), "day")
    return each.groupBy("source_key", "body").agg(F.first("keys").alias("keys"), F.count("*").alias("n"), F.min("day").alias("d0"), F.max("day").alias("d1"))


def line_counts(df: DataFrame) -> DataFrame:
    """h, g, source_key, n_records, n_bodies, first_date, last_date for every line key."""
    each = clusters(df).select("source_key", "n", "d0", "d1", F.explode("keys").alias("k"))
    return each.groupBy("k.h", "k.g").agg(
        F.sum("n").alias("n_records"), F.count("*").alias("n_bodies"), F.min("source_key").alias("source_key"), F.min("d0").alias("first_date"), F.max("d1").alias("last_date")
    )


def repeated_lines(df: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """The keys of the lines that come back in their source by its records, with their counts."""
    totals = usable(df).groupBy(F.xxhash64("source").alias("source_key")).agg(F.count("*").alias("n_source"))
    often = line_counts(df).where(F.col("n_records") >= least)
    return often.join(totals, "source_key").where(F.col("n_records") / F.col("n_source") >= share)  # a division, as 70 * 0.1 is more than 7


def boilerplate_lines(df: DataFrame, least: int = 5, share: float = 0.1) -> DataFrame:
    """The keys of the lines in enough distinct bodies of their source that weren't all published on one day (dates that are null don't tell)."""
    totals = usable(df).groupBy(F.xxhash64("source").alias("source_key")).agg(F.count_distinct(F.xxhash64(line_keys(F.col("body_text"), F.col("source")))).alias("n_source"))
    often = line_counts(df).where((F.col("n_bodies") >= least) & ~F.coalesce(F.col("first_date") == F.col("last_date"), F.lit(False)))
    return often.join(totals, "source_key").where(F.col("n_bodies") / F.col("n_source") >= share)


def repeated_places(spark: SparkSession, df: DataFrame, flagged: DataFrame) -> DataFrame:
    """doc_id, line_no of every place of a flagged line."""
    flagged = stored(spark, flagged.select("h", "g"), "p3-lines")
    if flagged.count() <= BROADCAST_ROWS:
        flagged = F.broadcast(flagged)
    places = usable(df).select("doc_id", F.posexplode(line_keys(F.col("body_text"), F.col("source"))).alias("line_no", "k")).where("k is not null")
    return places.select("doc_id", "line_no", "k.h", "k.g").join(flagged, ["h", "g"]).select("doc_id", "line_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: doc_id, line_no of the lines repeated across their source."""
    df = documents(spark, sf_dir, "doc_id", "source", "body_text", "published_at")
    return repeated_places(spark, df, repeated_lines(df))


def without_lines(df: DataFrame, places: DataFrame, out: str = "main_text") -> DataFrame:
    """doc_id and ``body_text`` without the lines of ``places`` (doc_id, line_no)."""
    drop = places.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_drop"))
    lines = F.filter(F.split("body_text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("_drop", i), F.lit(False)))
    return df.join(drop, F.col("doc_id") == F.col("_id"), "left").select("doc_id", F.array_join(lines, "\n").alias(out))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3: every body without its source's repeated lines."""
    df = documents(spark, sf_dir, "doc_id", "source", "body_text", "published_at")
    return without_lines(df.select("doc_id", "body_text"), repeated_places(spark, df, repeated_lines(df)))


def p3_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3 by the method's own counts: doc_id, line_no of the lines in many distinct bodies of their source, published on different days."""
    df = documents(spark, sf_dir, "doc_id", "source", "body_text", "published_at")
    return repeated_places(spark, df, boilerplate_lines(df))


#: DuckDB's pattern has no Unicode white space: the same characters, listed.
_DIGIT_OR_WHITE = r"[\p{Nd}\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_SQL = rf"""
with d as (select doc_id, source, string_split(body_text, chr(10)) as a from documents where body_text is not null and trim(source) <> ''),
l as (select doc_id, source, unnest(range(len(a))) as line_no, unnest(a) as line from d),
n as (select doc_id, source, line_no, lower(regexp_replace(line, '{_DIGIT_OR_WHITE}', '', 'g')) as line from l),
k as (select source, line, count(distinct doc_id) as c from n where regexp_matches(line, '\p{{L}}') group by all),
t as (select source, count(*) as total from d group by source)
select n.doc_id, cast(n.line_no as int) as line_no from n join k using (source, line) join t using (source) where c >= 5 and c / total >= 0.1
"""

_SQL_CLUSTERS = rf"""
with d as (select doc_id, source, published_at, string_split(body_text, chr(10)) as a from documents where body_text is not null and trim(source) <> ''),
l as (select doc_id, source, published_at, unnest(range(len(a))) as line_no, unnest(a) as line from d),
n as (select doc_id, source, published_at, line_no, lower(regexp_replace(line, '{_DIGIT_OR_WHITE}', '', 'g')) as line from l),
m as (select *, regexp_matches(line, '\p{{L}}') as told from n),
b as (select doc_id, any_value(source) as source, any_value(cast(published_at as date)) as day, md5(coalesce(string_agg(line, chr(10) order by line_no) filter (where told), '')) as body from m group by doc_id),
k as (select m.source, m.line, count(distinct b.body) as c, min(b.day) as d0, max(b.day) as d1 from m join b using (doc_id) where told group by all),
t as (select source, count(distinct body) as total from b group by source)
select m.doc_id, cast(m.line_no as int) as line_no from m join k using (source, line) join t using (source) where told and c >= 5 and c / total >= 0.1 and not coalesce(d0 = d1, false)
"""

ORACLE = {"p3_found": _SQL, "p3_boilerplate": _SQL_CLUSTERS}

"""Functions and operators against values worked out by hand or by Python."""

import io
import json
import random
import re
import uuid
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import query as Q
from tessera.functions import text as X
from tessera.operators import chunks, fusion, graph, merge, retrieval
from tessera.sources import files, sinks
from tessera.streaming import streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_uuid_is_version_five(spark):
    urls = ["https://a.example/x", "https://b.example/ü?q=1"]
    got = [r.u for r in spark.createDataFrame([(u,) for u in urls], "url string").select(X.doc_uuid(F.col("url")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, u)) for u in urls]


def test_url_forms(spark):
    rows = {"https://www.wired.example/a/?utm_source=x": "https://wired.example/a", "https://a.example/?utm_a=1&p=2&utm_b=3": "https://a.example/?p=2", " https://a.example/x#y ": "https://a.example/x#y"}
    for url, want in rows.items():
        assert one(spark, X.normalize_url(F.col("u")), u=url) == want


def test_lead_summary(spark):
    text = "One is here. Two follows! Three?"
    assert one(spark, X.lead_summary(F.col("t"), 26), t=text) == "One is here. Two follows!"
    assert one(spark, X.lead_summary(F.col("t"), 5), t=text) == "One i"
    assert one(spark, X.lead_summary(F.col("t")), t="") == ""


@pytest.mark.parametrize("text,want", [("90", 90), ("01:30", 90), ("1:02:03", 3723), ("x", None), ("1:2:3:4", None)])
def test_duration(spark, text, want):
    assert one(spark, X.duration_seconds(F.col("t")), t=text) == want


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/watch?a=b&v=abcdefghij_", "abcdefghij_"), ("https://youtu.be/abcdefghij-", "abcdefghij-"), ("https://youtube.com/shorts/abcdefghijk", "abcdefghijk"), ("https://x.example/", "")])
def test_video_id(spark, url, want):
    assert one(spark, X.video_id(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,want", [("https://a.example/2024/05/09/x", "2024-05-09"), ("https://a.example/2024/05/x", "2024-05-01"), ("https://a.example/2035/05/x", None), ("https://a.example/x", None)])
def test_published_in_url(spark, url, want):
    assert one(spark, X.published_in_url(F.col("u")), u=url) == want


def test_gate_order(spark):
    good = "The quick meter reading was taken again and written down by the crew. " * 6
    cases = [("short", "t", "too_short"), ("a" * 300, "Title", "too_few_words"), ("Accept all. " + good, "Title", "boilerplate"), (good, "", "no_title"), (good, "Untitled", "generic_title"), (good, "Meters", "ok"), (None, None, "too_short")]
    df = spark.createDataFrame([(b, t) for b, t, _ in cases], "b string, t string")
    assert [r.g for r in df.select(X.content_gate(F.col("b"), F.col("t")).alias("g")).collect()] == [w for *_, w in cases]


def test_expand_and_freshness(spark):
    assert Q.expand("install guide") == "install guide tutorial walkthrough how-to installation setup"
    assert Q.expand("bees") == "bees"
    asked = ["pw", " PD ", "2025-01-01 to 2025-02-01", "2025-01-01-2025-02-01", "soon", None, "2025-13-01to2025-14-01", "2025-02-01to2025-01-01"]
    df = Q.freshness_ranges(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, a string"), "a", date(2025, 1, 8)).orderBy("i")
    jan, feb, none = date(2025, 1, 1), date(2025, 2, 1), (None, None, False)
    assert [tuple(r)[2:] for r in df.collect()] == [(jan, date(2025, 1, 8), False), (date(2025, 1, 7), date(2025, 1, 8), False), (jan, feb, False), (jan, feb, False), none, none, none, (None, None, True)]


def test_entity_terms_and_lookup(spark):
    df = spark.createDataFrame([("What did NASA report about Mars rovers today, at 3M's X1 site",), (None,)], "q string")
    assert [r.t for r in df.select(Q.entity_terms(F.col("q")).alias("t")).collect()] == [["What", "NASA", "Mars", "rovers", "X1"], None]
    assert [Q.lookup_source(False, None), Q.lookup_source(True, 3), Q.lookup_source(True, 0), Q.lookup_source(True, 3, corpus_only=True), Q.lookup_source(False, 2, force_web=True)] == ["corpus", "web", "miss", "miss", "web"]


def test_diverse_keywords(spark):
    df = spark.createDataFrame([(["machine learning", "learning machine", "deep sea", "sea deep water", "bees"],)], "k array<string>")
    assert df.select(Q.diverse(F.col("k")).alias("d")).first().d == ["machine learning", "deep sea", "bees"]


def test_mmr_prefers_the_distinct_document():
    pool = [(1, 0.9), (3, 0.85), (2, 0.5)]
    vectors = {1: [1.0, 0.0], 3: [0.0, 1.0], 2: [1.0, 0.01]}
    assert [d for d, _ in fusion.mmr(pool, vectors, 2)] == [1, 3]
    assert fusion.mmr([(1, 0.5), (2, 0.4)], {}, 2) == [(1, 0.5), (2, 0.4)]
    assert [d for d, _ in fusion.mmr([(9, 0.99), *pool], vectors, 4)][-1] == 9


def test_rrf_and_blend(spark):
    f = spark.createDataFrame([(1, 0.9), (2, 0.4)], "doc_id long, score double")
    v = spark.createDataFrame([(2, 0.8), (3, 0.5)], "doc_id long, score double")
    got = {r.doc_id: r.score for r in fusion.rrf([f, v], 10).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}, abs=1e-8)
    got = {r.doc_id: r.score for r in fusion.blend([(f, 0.3), (v, 0.7)], 10).collect()}
    assert got == pytest.approx({1: 0.3, 2: 0.7, 3: 0.0}, abs=1e-8)
    same = spark.createDataFrame([(1, 0.5), (2, 0.5)], "doc_id long, score double")
    assert {r.score for r in retrieval.minmax(same).collect()} == {1.0}


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(retrieval.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_bridge_on_a_chain_a_diamond_and_apart(spark):
    rows = [(1, 2, 0.5), (2, 3, 0.5), (1, 4, 0.9), (4, 3, 0.9), (3, 5, 0.1), (8, 9, 1.0)]
    e = spark.createDataFrame([(*r, "t") for r in rows], "source_id long, target_id long, weight double, rel_type string")
    got = {r.dst: (r.hop, r.parent) for r in graph.bridge(e, 1, 5).collect()}
    assert got == {1: (0, None), 2: (1, 1), 4: (1, 1), 3: (2, 4), 5: (3, 3)}
    assert 9 not in {r.dst for r in graph.bridge(e, 1, 9).collect()}


def test_knn_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    got = {(r.src, r.dst) for r in graph.knn(df.where("doc_id % 10 = 0"), df, 5, -1.0, block=40).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(i, int(j)) for i in range(0, 150, 10) for j in np.argsort(-s[i])[:5]}


def test_upsert_rules(spark):
    rows = [("u", 1, "A", "old", "ready", 5), ("u", 2, "B", "", "pending", 7), ("w", 3, None, None, "pending", None), ("w", 4, "C", None, "failed", None)]
    df = spark.createDataFrame(rows, "k string, doc_id long, title string, summary string, status string, published_us long")
    got = {r.k: (r.title, r.summary, r.status, r.published_us, r.version) for r in merge.upsert_documents(df, "k", F.col("doc_id")).collect()}
    assert got == {"u": ("B", "old", "ready", 5, 2), "w": ("C", None, "failed", None, 2)}


@pytest.mark.parametrize("text,want", [('{"a": [1, 2,],}', {"a": [1, 2]}), ('```json\n{"a": "x"}\n```', {"a": "x"}), ('{"a": {"b": [1', {"a": {"b": [1]}}), ('say {"a": "x', {"a": "x"}), ("nothing", None)])
def test_json_repair(text, want):
    got = chunks.repaired(text)
    assert (json.loads(got) if got else None) == want


def test_windows_edges(spark):
    rows = [(1, "T", "a b c"), (2, None, " ".join(map(str, range(25)))), (3, "E", ""), (4, "N", None)]
    got = {(r.doc_id, r.chunk_index): r.chunk for r in chunks.windows(spark.createDataFrame(rows, "doc_id long, title string, text string"), 20, 12, 10).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (2, 2)}
    assert got[1, 0] == "a b c" and got[2, 2] == " (3/3)\n20 21 22 23 24" and len(got[2, 0].split("\n")[1].split()) == 12


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", data)
    return b.getvalue()


def test_office_files(spark, tmp_path):
    w = "xmlns:w='w'"
    (tmp_path / "a.docx").write_bytes(zipped(word__document=f"<w:d {w}><w:p><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p></w:d>"))
    (tmp_path / "b.xlsx").write_bytes(zipped(**{"xl__sharedStrings": "<s><si><t>x</t></si></s>", "xl__worksheets__sheet1": "<w><row><c t='s'><v>0</v></c><c><v>2</v></c></row></w>"}))
    (tmp_path / "c.pptx").write_bytes(zipped(**{"ppt__slides__slide1": "<s xmlns:a='a'><a:p><a:t>One</a:t></a:p></s>", "ppt__slides__slide2": "<s xmlns:a='a'><a:p><a:t>Two</a:t></a:p></s>"}))
    (tmp_path / "d.pdf").write_bytes(b"%PDF\n1 0 obj\n<< /Title (My \\(file\\)) >>\nstream\nBT (Hello) Tj ET\nendstream\n")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[-1]: (r.title, r.text, r.error) for r in files.office(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("Head", "Intro\nHead", None) and got["b.xlsx"][1] == "x\t2" and got["c.pptx"][1] == "[Slide 1]\nOne\n\n[Slide 2]\nTwo"
    assert got["d.pdf"] == ("My (file)", "Hello", None) and got["e.docx"] == (None, None, "BadZipFile")


def test_feed_and_podcast(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link> https://a.example/1 </link><description>d</description></item><item><title>B</title><link>https://a.example/2</link><enclosure url='https://a.example/x.mp3' type='audio/mpeg'/><duration>01:10</duration></item></channel></rss>")
    got = [(r.title, r.url, r.audio, r.seconds) for r in files.feed(spark, str(tmp_path / "f.xml")).orderBy("title").collect()]
    assert got == [("A", "https://a.example/1", None, None), ("B", "https://a.example/2", "https://a.example/x.mp3", 70)]


def test_pages_and_links(spark):
    html = "<title>T &amp; U</title><script>x</script><article><p>One  <b>two</b></p></article><a href='/y'>y</a><a href='z.html#q'>z</a><a href='https://o.example/'>o</a><a href='mailto:x@y.example'>m</a><meta property='article:published_time' content=\"2024-03-02T00:00\">"
    df = spark.createDataFrame([("https://a.example/d/x", 200, html), ("https://a.example/2023/04/05/p", 403, ""), ("https://a.example/q", 500, "")], "url string, status int, html string")
    got = {r.url: (r.paywall, r.title, r.published, r.text) for r in files.web_pages(df).collect()}
    assert got == {"https://a.example/d/x": ("none", "T &amp; U", "2024-03-02", "One two"), "https://a.example/2023/04/05/p": ("hard", "", "2023-04-05", "")}
    assert {r.link for r in files.page_links(df).collect()} == {"https://a.example/y", "https://a.example/d/z.html"}
    assert len(files.page_links(df, same_site=False).collect()) == 3


def test_imports_exports_and_logs(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"doc_id": 1, "title": "a"}\nbroken\n{"doc_id": 2, "title": "b"}\n')
    assert sorted(r.doc_id for r in files.import_lines(spark, str(tmp_path / "l.jsonl")).where("doc_id is not null").collect()) == [1, 2]
    (tmp_path / "a.json").write_text('[{"doc_id": 1},\n {"doc_id": 3}]')
    assert files.import_array(spark, str(tmp_path / "a.json")).count() == 2
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sinks.export_lines(docs, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == docs.count()
    sinks.bodies(docs, str(tmp_path / "b"), 4)
    assert spark.read.parquet(str(tmp_path / "b")).count() == docs.where("body_text is not null").count()
    log = spark.read.parquet("/root/testdata/sf0.001/query_log.parquet").limit(10)
    for _ in range(2):
        sinks.append_log(log, str(tmp_path / "log"), "ts")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 20
    sinks.replace_buckets(docs.select("doc_id", "title"), str(tmp_path / "c"), buckets=4)
    part = docs.select("doc_id", F.lit("new").alias("title")).where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    sinks.replace_buckets(part, str(tmp_path / "c"), buckets=4)
    after = spark.read.parquet(str(tmp_path / "c"))
    assert after.count() == docs.count() and after.where("title = 'new'").count() == part.count()


def test_peers_and_hits(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"doc_id": 1, "title": "a", "score": 0.5}, {"doc_id": 2, "title": "b", "score": 0.1}]))
    (tmp_path / "q.json").write_text(json.dumps([{"doc_id": 1, "title": "A", "score": 0.9}]))
    got = {r.doc_id: (r.title, r.score) for r in files.peers(spark, [str(tmp_path / "p.json"), str(tmp_path / "q.json")]).collect()}
    assert got == {1: ("A", 0.9), 2: ("b", 0.1)}
    raw = spark.createDataFrame([('{"results": [{"url": "u", "title": "t", "description": "d"}]}',), ('[{"link": "v", "snippet": "s"}]',)], "raw string")
    assert {(r.url, r.snippet) for r in files.search_hits(raw, "stub").collect()} == {("u", "d"), ("v", "s")}


def test_watched_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "b.log").write_text("no")
    out = streams.drained(files.watched_folder(spark, str(tmp_path / "in")).select("value"))
    assert [r.value for r in out.collect()] == ["one\ntwo"]


def test_first_deliveries_keep_one(spark):
    out = streams.drained(streams.first_deliveries(streams.stream(spark, "/root/testdata/sf0.001", "query_log").select("id", "logged_at")))
    log = spark.read.parquet("/root/testdata/sf0.001/query_log.parquet")
    assert out.count() == log.select("id").distinct().count() < log.count()


def test_summary_matches_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    for r in docs.select("text", X.lead_summary(F.col("text")).alias("lead")).limit(40).collect():
        want = ""
        for s in re.split(r"(?<=[.!?])\s+", r.text.strip(" ")):
            if len(want) + len(s) + (1 if want else 0) > 500:
                break
            want = f"{want} {s}" if want else s
        assert r.lead == (want or r.text.strip(" ")[:500])


def test_html_to_markdown(spark):
    html = "<h2>Head</h2><p>One <b>two</b> <a href='u'>x</a></p><ul><li>a</li><li>b</li></ul><script>no</script>"
    assert one(spark, files.html_markdown(F.col("h")), h=html) == "## Head\nOne **two** [x](u)\n\n- a\n- b"


def test_scanned_and_blocked_neighbours_agree(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(6)]) for i in range(120)] + [(200, [0.0] * 6)]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    q = v.where("doc_id % 10 = 0")
    few = {(r.src, r.dst, round(r.cosine, 9)) for r in graph.knn(q, v, 5, 0.1).collect()}
    many = {(r.src, r.dst, round(r.cosine, 9)) for r in graph.knn(q, v, 5, 0.1, block=16, most=1).collect()}
    assert few == many and few
    assert graph.knn(q.limit(0), v).count() == 0 and graph.knn(q, v.limit(0)).count() == 0


def test_similarity_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "doc_id long, vector array<double>")
    assert {r.doc_id: r.score for r in retrieval.similar(v, [6.0, 8.0], "doc_id").collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None}


def test_index_falls_back_to_any_term(spark):
    docs = spark.createDataFrame([(1, "kiln shelves and gates"), (2, "kiln kiln kiln"), (3, None), (4, "gates of the quay"), (5, "")], "doc_id long, text string")
    index = retrieval.build_index(docs, F.col("text"))
    assert index.n == 5 and index.avgdl == pytest.approx((4 + 3 + 0 + 4 + 0) / 5)
    hits = {r.doc_id: r.tier for r in retrieval.fts(index, "kiln gates", 10).collect()}
    assert hits == {1: 0, 2: 1, 4: 1}
    assert retrieval.fts(index, "zzz", 10).count() == 0


def test_a_hub_keeps_its_best_edges(spark):
    rows = [(1, i, float(i % 50)) for i in range(2, 300)] + [(i, i + 1, 60.0) for i in range(2, 40)]
    got = {(r.a, r.b) for r in graph.best_of_both(spark.createDataFrame(rows, "a long, b long, weight double"), "a", "b", 2).collect()}
    rank = lambda k, o: {e for n in {r[k] for r in rows} for e in sorted([r for r in rows if r[k] == n], key=lambda r: (-r[2], r[o]))[:2]}
    assert got == {r[:2] for r in rank(0, 1) & rank(1, 0)}


def test_late_rows_in_several_files(spark, tmp_path):
    """A file at a time: rows later than the watermark are dropped, a window that gets rows in two batches has their sum."""
    day = 86_400_000_000
    times = [[0, 1, 2 * day], [2, 3 * day], [5 * day, 5 * day + 1], [10, 5 * day + 2]]  # 10 comes when the watermark is past it
    for i, own in enumerate(times):
        spark.createDataFrame([(t, "click") for t in own], "us long, event_type string").selectExpr("timestamp_micros(us) ts", "event_type").coalesce(1).write.parquet(f"{tmp_path}/{i}.parquet")
    src = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    got = {(r.start_us, r.n) for r in streams.drained(streams.tumbling(src), "update", keys=("start_us", "event_type")).collect()}
    assert (5 * day, 3) in got and (2 * day, 1) in got and (0, 4) not in got

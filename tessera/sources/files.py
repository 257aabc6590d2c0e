"""Readers of outside formats: all give DataFrames, one task per file or block, no network.

Office documents are zip files of XML, read with the standard library in Arrow batches over Spark's ``binaryFile``
source; feeds use Spark's XML source; web pages are a table of (url, status, html).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.text import duration_seconds, published_in_url

MOST_PAGES, MOST_SHEETS, MOST_ROWS = 101, 10, 501


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _runs(node: ElementTree.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == name)


def docx_text(data: bytes) -> tuple[str, str]:
    """Title (the first heading, else the first line) and paragraphs of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    title, lines = "", []
    for p in (x for x in root.iter() if _local(x.tag) == "p"):
        text = _runs(p).strip()
        if text:
            style = next((v for s in p.iter() if _local(s.tag) == "pStyle" for k, v in s.attrib.items() if _local(k) == "val"), "")
            if not title and style.lower().startswith(("heading", "title")):
                title = text
            lines.append(text)
    return title or (lines[0][:120] if lines else ""), "\n".join(lines)


def xlsx_text(data: bytes) -> tuple[str, str]:
    """Tab-joined rows of at most ten sheets of at most 501 rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_runs(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1]).group()))
        out = []
        for name in sheets[:MOST_SHEETS]:
            for n, row in enumerate(x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
                if n >= MOST_ROWS:
                    break
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), None)
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else _runs(c) if c.get("t") == "inlineStr" else v or "")
                if any(cells):
                    out.append("\t".join(cells))
    return (out[0][:120] if out else ""), "\n".join(out)


def pptx_text(data: bytes) -> tuple[str, str]:
    """Text of each slide behind ``[Slide n]``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1]).group()))
        out = []
        for i, name in enumerate(slides, 1):
            root = ElementTree.fromstring(z.read(name))
            lines = [_runs(p).strip() for p in root.iter() if _local(p.tag) == "p"]
            out.append(f"[Slide {i}]\n" + "\n".join(x for x in lines if x))
    first = out[0].split("\n")[1] if out and "\n" in out[0] else ""
    return first[:120], "\n\n".join(out)


def pdf_text(data: bytes) -> tuple[str, str]:
    """Text of simple PDF files: literal strings of text operators in plain or deflated streams, page by page."""
    import zlib

    pages = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        raw = m.group(1)
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        lines = []
        for block in re.findall(rb"BT(.*?)ET", raw, re.S):
            strings = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", block, re.S)
            lines.append("".join(_pdf_string(a) if a else "".join(map(_pdf_string, re.findall(rb"\(((?:[^()\\]|\\.)*)\)", b))) for a, b in strings))
        pages.append("\n".join(lines))
        if len(pages) >= MOST_PAGES:
            break
    text = "\n\n".join(pages)
    title = re.search(rb"/Title\s*\(((?:[^()\\]|\\.)*)\)", data)
    return (_pdf_string(title.group(1)) if title else text.split("\n", 1)[0])[:120], text


def _pdf_string(s: bytes) -> str:
    return re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1")


EXTRACTORS: dict[str, Callable[[bytes], tuple[str, str]]] = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text, "pdf": pdf_text}


def office(spark: SparkSession, path: str) -> DataFrame:
    """path, format, title, text, error of the office files under ``path``. A broken file gives its error, not a failed job."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.withColumn("format", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).where(F.col("format").isin(*EXTRACTORS))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, kind, data in zip(p.path, p.format, p.content):
                try:
                    rows.append((path, kind, *EXTRACTORS[kind](bytes(data)), None))
                except Exception as e:  # whatever a broken file raises
                    rows.append((path, kind, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "format", "title", "text", "error"])

    return files.select("path", "format", "content").mapInPandas(run, "path string, format string, title string, text string, error string")


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """title, url, summary, published, audio, seconds of a feed's items (``tag`` is entry for Atom)."""
    schema = "title string, link string, description string, summary string, pubDate string, updated string, enclosure struct<_url: string, _type: string>, duration string"
    items = spark.read.format("xml").schema(schema).option("rowTag", tag).option("ignoreNamespace", True).load(path)
    return items.select(
        "title", F.trim("link").alias("url"), F.coalesce("description", "summary").alias("summary"), F.coalesce("pubDate", "updated").alias("published"),
        F.when(F.col("enclosure._type").startswith("audio"), F.col("enclosure._url")).alias("audio"), duration_seconds(F.col("duration")).alias("seconds"),
    )


_TAGS = r"(?is)<(script|style|noscript)\b.*?</\1>"


def web_pages(pages: DataFrame) -> DataFrame:
    """url, status, title, published, text of fetched pages (url, status, html).

    403 gives a stub with a hard paywall, other errors are skipped. Text is the article's or the paragraphs', tags dropped.
    """
    ok = pages.where((F.col("status") < 400) | (F.col("status") == 403))
    html = F.regexp_replace("html", _TAGS, " ")
    body = F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)
    paragraphs = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), "\n")
    text = F.regexp_replace(F.when(body != "", body).otherwise(paragraphs), r"<[^>]+>", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit("")), F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    meta = F.coalesce(*[
        F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
        for p in (r'(?is)<meta[^>]+(?:article:published_time|datePublished)[^>]+content="(\d{4}-\d\d-\d\d)', r'(?is)"datePublished"\s*:\s*"(\d{4}-\d\d-\d\d)', r'(?is)<time[^>]+datetime="(\d{4}-\d\d-\d\d)')
    ])
    closed = F.col("status") == 403
    clean = F.trim(F.regexp_replace(text, r"[ \t]+", " "))
    return ok.select(
        "url", F.when(closed, "hard").otherwise("none").alias("paywall"), F.when(closed, F.lit("")).otherwise(title).alias("title"), F.coalesce(meta, published_in_url(F.col("url"))).alias("published"), F.when(closed, F.lit("")).otherwise(clean).alias("text")
    )


def html_markdown(html: Column) -> Column:
    """Markdown of simple HTML: headings, list items, links, emphasis, paragraphs; other tags dropped."""
    t = F.regexp_replace(html, _TAGS, " ")
    for level in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{level}[^>]*>\s*(.*?)\s*</h{level}>", "\n" + "#" * level + " $1\n")
    for pattern, to in (
        (r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "\n- $1"), (r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", "[$2]($1)"), (r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**"), (r"(?is)<(?:i|em)>(.*?)</(?:i|em)>", "*$1*"),
        (r"(?i)<br\s*/?>|</p>|</div>|</tr>", "\n"), (r"<[^>]+>", ""), (r"[ \t]+", " "), (r"\s*\n\s*\n\s*", "\n\n"),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def page_links(pages: DataFrame, same_site: bool = True) -> DataFrame:
    """url, link: absolute links without fragments, each once per page."""
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    href = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*href=["']([^"'#]+)"""), F.lit(1)))
    rows = pages.select("url", host.alias("h"), href.alias("r"))
    link = F.when(F.col("r").rlike("^https?://"), F.col("r")).when(F.col("r").startswith("//"), F.concat(F.lit("https:"), "r")).when(F.col("r").startswith("/"), F.concat("h", "r"))
    link = link.otherwise(F.concat(F.regexp_replace("url", r"[^/]*$", ""), "r"))
    out = rows.where(~F.col("r").rlike("(?i)^(mailto|javascript|tel|data):")).select("url", "h", link.alias("link"))
    return (out.where(F.startswith("link", F.col("h"))) if same_site else out).select("url", "link").distinct()


def import_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; lines that can't be read are dropped."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def import_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array over several lines."""
    return spark.read.option("multiLine", True).json(path)


def watched_folder(spark: SparkSession, path: str) -> DataFrame:
    """Text files dropped into a folder, as a stream of (value, path)."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(path).withColumn("path", F.input_file_name())


def search_hits(answers: DataFrame, provider: str) -> DataFrame:
    """url, title, snippet, provider from a provider's JSON answers (column ``raw``)."""
    hit = "struct<url: string, link: string, title: string, snippet: string, description: string, text: string>"
    rows = answers.select(F.explode(F.coalesce(F.from_json(F.get_json_object("raw", "$.results"), f"array<{hit}>"), F.from_json("raw", f"array<{hit}>"))).alias("h"))
    return rows.select(F.coalesce("h.url", "h.link").alias("url"), "h.title", F.coalesce("h.snippet", "h.description", "h.text").alias("snippet"), F.lit(provider).alias("provider")).where("url is not null")


def remote_documents(spark: SparkSession, jdbc_url: str, relation: str, query: str, **options: str) -> DataFrame:
    """Documents of another store whose title, summary or keywords hold the query: the predicate is pushed down."""
    like = "%" + query.replace("'", "''").replace("%", r"\%") + "%"
    where = f"lower(title) like lower('{like}') or lower(summary) like lower('{like}')"
    return spark.read.format("jdbc").option("url", jdbc_url).option("dbtable", f"(select * from {relation} where {where}) q").options(**options).load().orderBy(F.desc("ingested_at"))


class PeerPart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PeerSource(DataSource):
    """Answers of peers as rows: one partition per answer file (``paths``, separated by commas; JSON lists of documents)."""

    @classmethod
    def name(cls) -> str:
        return "peer"

    def schema(self) -> str:
        return "doc_id long, title string, url string, score double"

    def reader(self, schema) -> DataSourceReader:
        return PeerReader(self.options)


class PeerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [PeerPart(p) for p in self.paths] or [PeerPart("")]

    def read(self, partition: PeerPart) -> Iterator[tuple]:
        import json

        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            for d in json.load(f):
                yield d.get("doc_id"), d.get("title"), d.get("url"), float(d.get("score") or 0)


def peers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of all peers, each once with its best score."""
    spark.dataSource.register(PeerSource)
    rows = spark.read.format("peer").option("paths", ",".join(paths)).load()
    return rows.groupBy("doc_id").agg(F.max_by("title", "score").alias("title"), F.max_by("url", "score").alias("url"), F.max("score").alias("score"))

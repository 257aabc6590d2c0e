"""Problem 1: template residue, filler, error messages and script notices instead of content.

Character n-gram models (hashed 4-grams of lower-cased UTF-8, digits read as 0) for filler, notices, residue and
natural text give each position log-likelihood ratios against natural text. Filler and notices are localised line by
line and by windows inside lines (a byte counts if the window around it does); a value is a case if they cover most
bytes of what isn't a page part (the model of problem 5 tells page parts). Residue is localised by short windows wherever they stand, and the windows' lines are
checked exactly for a placeholder or an editing note (``PLACE``), since one is enough; what is quoted as code or
speech is talk about such things and counts as text.

The three rare classes are fitted on the hand-labelled lines of ``labels.py``, natural text on all bodies.

Plan: one pass that counts 4-grams (each task sends its sums, at most 2 MB) and one row-wise map with vectorised scores; no
shuffle of texts.

Defined cases: null, empty, blank -> no case. Very long values are scored whole. Repeated rows are treated alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import labels
from tessera.llm.common import documents
from tessera.llm.pagebody import Pages
from tessera.llm.pagebody import fitted as fitted_pages

CLASSES = ("filler", "notice", "residue")
BITS = 18
#: Records whose counts the labelled natural lines are weighed against.
WEIGHT = 3000
#: Bytes of the windows that localise residue, with their thresholds.
WINDOWS = ((8, 1.0), (24, 4.0))
#: Bytes on each side of a byte in the windows that localise filler and notices inside lines, and the least mean of a line or window.
HALF, LEAST = 32, 0.35
#: Characters of values that are scored together.
PART = 100_000
#: Bytes of other text that a filler or notice may have beside it without covering more.
OWN = 100
CODE = np.arange(256, dtype=np.uint32)
CODE[48:58] = 48

#: An unfilled field or an editing note.
PLACE = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|<%[^%\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\[\[[^\[\]\n]{1,60}\]\]|<<\s*[\w .-]{2,40}>>|@@\w[\w .-]{1,40}@@|%%\w[\w .-]{1,40}%%"
    r"|%[A-Za-z][A-Za-z_.]{2,40}%|__[A-Za-z][A-Za-z_]{1,40}?__|\$[A-Za-z][A-Za-z_. ]{1,40}\$|&lt;/?[A-Za-z_. ]{2,40}&gt;|\{\s*(?:\d|[A-Za-z_.]{2,40})\s*\}|<[A-Z][A-Z_ ]{2,40}>"
    r"|\[(?:[A-ZÀ-Þ]{2,}[A-ZÀ-Þ_.]*)(?:[ _'’-][A-ZÀ-Þ_]+){0,6}\]|\[[Yy]our [^\]\n]{2,30}\]|\[(?:[Cc]ompany|[Nn]ame|[Cc]ity|[Dd]ate|[Tt]itle|[Ii]hr [^\]\n]{2,30}|[Vv]otre [^\]\n]{2,30}|[Ss]u [^\]\n]{2,30})\]"
    r"|\*\|[A-Za-z_:. ]{2,40}\|\*|##[A-Za-z_.]{2,40}##|\{![A-Za-z_.$ ]{2,60}\}|\{\$[A-Za-z_.]{2,60}\}|<\?=?[^?\n]{1,60}\?>|\[%[^%\n]{1,60}%\]|\{#[^#\n{}]{1,60}#\}|\|\|[A-Z_]{2,40}\|\||~~[A-Z_]{2,40}~~"
    r"|\[(?:TB[ACD]|tb[acd]|[Pp]hone(?: number)?|[Ee]-?mail(?: address)?|[Ff]irst name|[Ll]ast name|[Ff]ull name|[Aa]ddress|[Jj]ob title|[Vv]orname|[Nn]achname|[Tt]elefon(?:nummer)?|[Pp]rénom|[Nn]om|[Tt]éléphone|[Nn]ombre|[Aa]pellidos?|[Tt]eléfono)\]"
    r"|\[object object\]|\bundefined\b|\bNaN\b|\bTO ?DO\b(?=\s*[:\])-])|\bFIXME\b|\bT[KB][DC]?\b|\bXXX\b|\bÀ COMPLÉTER\b|\bPENDIENTE\b"
)
_FIELD_LOW = re.compile(r"\{\{|\{%|<%|[$#]\{|\[\[|<<\s*\w|@@\w|%%\w|&lt;\w|\[object object\]|\[insert|\[hier |\[insér|\[insertar|\btodo\s?:|\(\w+ tk\)|\badd a short description\b|hier eine kurze beschreibung ein|ajoutez ici une courte description|añada aquí una breve descripción", re.I)
#: A lower-case text with a match of ``_FIELD_LOW`` has one of these.
_FIELD_PARTS = ("{{", "{%", "<%", "${", "#{", "[[", "<<", "@@", "%%", "&lt;", "[object object]", "[ins", "[hier ", "todo", " tk)", "short description", "kurze beschreibung", "courte description", "breve descripción")
#: Whatever matches either has a character or word of these.
_SOME = re.compile(r"[{}<\[%$#@_*|~&]|undefined|NaN|TO ?DO|FIXME|T[KB]|XXX|COMPLÉTER|PENDIENTE|tk\)|todo\s?:|short description|kurze beschreibung|courte description|breve descripción", re.I)
_QUOTED = re.compile(r"`[^`\n]*`|[“„«‘][^”“»’\n]{0,120}[”“»’]|<\|[^|\n]*\|>|\"[^\"\n]{0,120}\"|\[\d\d:\d\d(?::\d\d)?\]|\[(?:\.{3}|…|at|dot|\+\d+ \w+)\]", re.I)

#: Words of sentences that explain placeholders rather than leave one.
_TALK = re.compile(
    r"\b(?:style ?sheets?|style guide|stilvorlage|feuille de style|hoja de estilo|libro de estilo|configuration|shell|environment variable|variables?|syntax|placeholders?|manual|macro|template engine|konfiguration|umgebungsvariable|platzhalter (?:wie|steht|wird)|handbuch|syntaxe?"
    r"|gabarit|fichier de configuration|manuel|configuración|sintaxis|el manual|intérprete)\b",
    re.I,
)


def grams(data: bytes) -> np.ndarray:
    """The hash of the 4-gram at each byte."""
    b = CODE[np.frombuffer(data + b"\n\n\n", dtype=np.uint8)]
    n = len(data)
    h = b[:n] * np.uint32(0x9E3779B1)
    h ^= b[1 : n + 1] * np.uint32(0x85EBCA6B)
    h ^= b[2 : n + 2] * np.uint32(0xC2B2AE35)
    h += b[3 : n + 3] * np.uint32(0x27D4EB2F)
    h ^= h >> np.uint32(15)
    return h & np.uint32((1 << BITS) - 1)


def counted(texts: list[str]) -> np.ndarray:
    data = "\n".join(texts).lower().encode("utf-8", "replace")
    return np.bincount(grams(data), minlength=1 << BITS).astype(np.float64)


def prose_counts(bodies: list[str | None]) -> np.ndarray:
    """The 4-grams of long lines that hold no field, none across two lines: the counts of all bodies are the sum of each one's."""
    lines = []
    for low in (b.lower() for b in bodies if b):
        field, ipsum = any(x in low for x in _FIELD_PARTS), "ipsum" in low
        lines += [x for x in map(str.strip, low.split("\n")) if len(x) > 80 and not (field and _FIELD_LOW.search(x)) and not (ipsum and "ipsum" in x)]
    data = "\n".join(lines).encode("utf-8", "replace")
    other = np.frombuffer(data + b"\n\n\n", dtype=np.uint8) != 10
    n = len(data)
    return np.bincount(grams(data)[other[:n] & other[1 : n + 1] & other[2 : n + 2]], minlength=1 << BITS).astype(np.float64)


def counted_prose(df: DataFrame) -> tuple[np.ndarray, int]:
    """``prose_counts`` of all bodies of ``df``, and their number of rows: each task sends one array of counts (map-side sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS), 0
        for batch in batches:
            rows += batch.num_rows
            for at in range(0, batch.num_rows, 256):
                total += prose_counts(batch.column(0).slice(at, 256).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[rows, total[at]].astype(np.int64))], names=["gram", "n"])

    out = np.zeros(1 << BITS)
    sums = df.select("body_text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    gram, n = sums.column("gram").to_numpy(), sums.column("n").to_numpy()
    out[gram[gram >= 0]] = n[gram >= 0]
    return out, int(n[gram < 0].sum())


def fit(prose: np.ndarray, records: int) -> np.ndarray:
    """Log-likelihood ratios (classes x grams) against natural text, whose counts ``prose`` of ``records`` records weigh at
    most as those of ``WEIGHT`` records beside the labelled lines."""
    other = labels.lines(labels.PAGE_PARTS) + labels.lines(labels.TEASER_HEADS) + labels.lines(labels.ARTICLE_LINES)
    natural = prose * min(1.0, WEIGHT / max(records, 1)) + counted(other * 60) + counted(labels.lines(labels.ABOUT) * 40)
    out = np.zeros((len(CLASSES), 1 << BITS), dtype=np.float32)
    for k, block in enumerate((labels.FILLER, labels.NOTICES, labels.RESIDUE)):
        own = counted(labels.lines(block) + ([f" {x} " for x in labels.fields()] if k == 2 else []))
        known = (own > 0) | (natural > 0)
        ratio = np.log((own / own.sum() + 2e-6) / (natural / natural.sum() + 2e-6))
        out[k] = np.where(known, np.clip(ratio, -4, 4), -0.3)
    return out


class Detector:
    """Judges values with fitted models."""

    def __init__(self, ratios: np.ndarray, models=None):
        self.ratios, self.models, self.pages = ratios, models, None

    def ready(self, pages: Pages | None = None):
        self.pages = pages or Pages(*self.models)
        return self.cases

    def line_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all lines of all texts: score sums and bytes covered by windows (2 x lines each), lines with a residue window, bytes, first line of each text."""
        low = [t.lower() for t in texts]
        first = np.cumsum([0] + [t.count("\n") + 1 for t in low])
        data = ("\n".join(low)).encode("utf-8", "replace")
        h = grams(data).astype(np.intp)
        ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
        starts = np.concatenate([[0], ends + 1])
        sizes = np.concatenate([ends, [len(data)]]) - starts
        at = np.minimum(starts, max(0, len(data) - 1))
        sums, cover, found = np.zeros((2, len(starts))), np.zeros((2, len(starts)), dtype=np.int64), np.zeros(len(starts), dtype=bool)
        whole = starts + np.maximum(sizes - 2, 0)  # where the 4-grams of a line end
        last = np.repeat(whole, sizes + 1)[: len(h)]  # no window goes beyond its line
        here = np.arange(len(h))
        begin = np.repeat(starts, sizes + 1)[: len(h)]
        left, right = np.maximum(here - HALF, begin), np.maximum(np.minimum(here + HALF, last), np.maximum(here - HALF, begin))
        least_sum = LEAST * np.maximum(right - left, HALF)
        for k in range(3):
            s = self.ratios[k].take(h) if len(h) else np.zeros(1, np.float32)
            c = np.concatenate([[0.0], np.cumsum(s, dtype=np.float64)])
            if k < 2:
                sums[k] = c[np.minimum(whole, len(c) - 1)] - c[np.minimum(starts, len(c) - 1)]
                if len(h):
                    inside = np.concatenate([[0], np.cumsum(c[right] - c[left] > least_sum)])
                    cover[k] = inside[starts + sizes] - inside[starts]
                continue
            for wide, least in WINDOWS:
                w = c[np.maximum(np.minimum(here + wide, last), here)] - c[:-1] if len(h) else np.zeros(1)
                found |= (np.maximum.reduceat(w, at) > least) & (sizes > 0)
        return sums, cover, found, sizes, first

    def cases(self, texts: list[str | None]) -> list[bool]:
        return [bool(k) for k in self.kinds(texts)]

    def kinds(self, texts: list[str | None]) -> list[str]:
        """For each value the kind of case, or nothing. Few values at a time, so that their arrays stay in the processor's cache."""
        out: list[str] = []
        part: list[str | None] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > PART:
                out += self._kinds(part)
                part, size = [], 0
        return out + self._kinds(part) if part else out

    def _kinds(self, texts: list[str | None]) -> list[str]:
        own = [t if t and t.strip() else "" for t in texts]
        sums, cover, window, sizes, first = self.line_scores(own)
        per = sums / np.maximum(sizes, 1)
        bad = ((per[0] > LEAST) | (per[1] > LEAST)) & (sizes > 3)
        inner = np.where(bad, sizes, cover.max(0))
        out = []
        for i, t in enumerate(own):
            a, b = first[i], first[i + 1]
            kind = ""
            if t and window[a:b].any():
                lines = t.split("\n")
                for no in np.flatnonzero(window[a:b]):
                    if not _SOME.search(lines[no]):
                        continue
                    bare = _QUOTED.sub(" ", lines[no])
                    if _TALK.search(bare):
                        bare = " ".join(x for x in re.split(r"(?<=[.!?])\s+", bare) if not _TALK.search(x))
                    if PLACE.search(bare) or _FIELD_LOW.search(bare):
                        kind = "residue"
                        break
            if t and not kind and inner[a:b].any():
                keep = self.pages.kept(t, None)
                wrong = bad[a:b]
                size = sizes[a:b]
                rest = sum(int(n) for n, k, w in zip(size, keep, wrong) if k and not w)
                amount = int(size[wrong].sum())
                if amount > rest - min(rest // 2, OWN):  # a few words of a message are its own
                    kind = "notice" if (per[1][a:b] * wrong).sum() >= (per[0][a:b] * wrong).sum() else "filler"
                elif int(inner[a:b].sum()) > sum(int(n) for n, k in zip(size - inner[a:b], keep) if k):
                    kind = "notice" if cover[1][a:b].sum() >= cover[0][a:b].sum() else "filler"
            out.append(kind)
        return out


def fitted(df: DataFrame, own_pages: bool = False) -> Detector:
    """A detector whose natural text is all records; ``own_pages`` fits the page model with it."""
    return Detector(fit(*counted_prose(df)), fitted_pages(df) if own_pages else None)


def judged(df: DataFrame, detector: Detector, fields: tuple[str, ...] = ("body_text", "summary")) -> DataFrame:
    """doc_id, field, kind of every case."""
    shared = df.sparkSession.sparkContext.broadcast(detector)
    kind_of = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.ready()
        for batch in batches:
            ids, names, kinds = [], [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for n, field in enumerate(fields, 1):
                    for doc, kind in zip(part.column(0).to_pylist(), own.kinds(part.column(n).to_pylist())):
                        if kind:
                            ids.append(doc)
                            names.append(field)
                            kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(names, pa.string()), pa.array(kinds, pa.string())], names=["doc_id", "field", "kind"])

    return df.select("doc_id", *fields).mapInArrow(run, f"doc_id {kind_of}, field string, kind string")


def p1_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: doc_id, field, kind of case."""
    df = documents(spark, sf_dir, "doc_id", "title", "body_text", "summary")
    return judged(df, fitted(df, own_pages=True))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1: doc_id, field of every value that is a case (distinct by the map unless rows are repeated)."""
    return p1_windows(spark, sf_dir).select("doc_id", "field").distinct()

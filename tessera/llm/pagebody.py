"""Problem 5: the article's own lines out of a page's text.

Two small models score lines by their words (labels: hand-labelled lines of ``labels.py``, and lines that a bounded
sample of records labels by itself: long prose, single short lines between prose, titles). The article model gives
words that are typical of articles positive and words of page parts negative weights; the title model knows the
titles of articles, which stand in lists of other articles. The text has lost its tags, so line breaks take their
part: a page is a sequence of line scores, and a penalised maximum-scoring subsequence search (one linear scan: the
best set of contiguous regions, each region paying a fixed cost) keeps what belongs together, so that a doubtful line
inside an article stays and one inside a menu goes.

Plan: a bounded sample and a row-wise map; no shuffle. Memory per task: one Arrow batch and a bounded memo of line
scores.

Defined cases: null and empty bodies have no lines; blank lines are never cases; a page without any article line has
all its lines reported; very long lines are scored whole. Repeated rows are treated alike. ``p5_found`` leaves out
records whose body is a case of problem 1, which the same pass over the body decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import labels, linear
from tessera.llm.common import documents, sample

SAMPLE = 3000
MEMO = 100_000
#: Characters of lines that are long: they are scored as article lines only, and anew wherever they stand.
LONG = 160

_PUNCTUATION = ".,;:!?…\"“”«»'()[]*"
_NUMBER = re.compile(r"\d+")
_BULLET = re.compile(r"^(?:[*–•▪·]|\d{1,2}[.)])\s+")
_SPLIT = re.compile(r"\s[—|–]\s|:\s")
_STEPS = re.compile(r"\s[»›>/|·]\s|\s\s·\s\s")
_STEP = re.compile(r"[»›>/|·]")
_NAME = re.compile(r"(?<=[\w,] )[A-ZÀ-Þ][a-zà-ÿ’-]+(?: [A-ZÀ-Þ][a-zà-ÿ’-]+)?")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_END = re.compile(r"[.!?…][\"”»')\]]*$")
#: Bytes that are no Latin letter.
_OTHER = bytes(x for x in range(256) if not _LATIN.match(chr(x)))


class Memo(dict):
    """What a function gives for a token, computed when first met (bounded, short tokens only)."""

    def __init__(self, of: Callable[[str], Any]):
        self.of = of

    def __missing__(self, token: str) -> Any:
        value = self.of(token)
        if len(token) < 40 and len(self) < MEMO:
            self[token] = value
        return value


def words_of(line: str) -> list[str]:
    return _NUMBER.sub("0", line.lower().replace("_", " ")).split()


#: The words of a token, bare; a lower-case token's words as ``plain`` has them.
_BARE = Memo(lambda token: [x.strip(_PUNCTUATION) for x in words_of(token)])
_PLAIN = Memo(lambda token: " ".join(re.sub(r"\W+", " ", token).split()))


def form_of(line: str) -> tuple[tuple, list[str]]:
    """Outer form of a line, which many lines share, and features of the words at its ends."""
    if line.count(" ") > 32 and "  " not in line:  # more than 30 tokens, which count as 30
        n, tokens = 30, line.split(None, 3)[:3] + line.rsplit(None, 2)[-2:]
    else:
        raw = line.split()
        n, tokens = len(raw), raw[:3] + raw[-2:]
    ends = [x for token in tokens for x in _BARE[token]]
    first, last = ends[: min(3, n)], ends[-min(2, n) :]
    end = "a" if line[-1:].isalnum() else "." if _END.search(line[-12:]) else line[-1:]
    steps = len(_STEPS.findall(line[:200])) if _STEP.search(line, 0, 200) else 0
    stops = line.count(". ") + line.count("! ") + line.count("? ")
    start = line[0] if not line[0].isalnum() else "U" if line[0].isupper() else "l" if line[0].islower() else "0"
    return (min(n, 30) // 2, min(n, 24) // 4, end, start, min(3, steps), min(4, stops)), ["2" + " ".join(first[:2]), "3" + " ".join(first), "l2" + " ".join(last), "1" + (first[0] if first else "") + end]


def shape_features(shape: tuple) -> list[str]:
    n, n4, end, start, steps, stops = shape
    return [f"n{n}", "e" + end, f"ne{n4}{end}", "s" + start, f"p{steps}", "bias", f"st{stops}"]


def form_features(line: str) -> list[str]:
    """Outer form of a line and its words at the ends."""
    shape, ends = form_of(line)
    features = shape_features(shape)
    return features[:5] + ends + features[5:]


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The tokens between white space of many texts: each as its number among the different ones, where every text's begin
    (and the last one's end), and the different ones. An empty token may stand for white space at an end."""
    split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    tokens = split.values.dictionary_encode()
    return tokens.indices.to_numpy(), split.offsets.to_numpy(), tokens.dictionary.to_pylist()


def line_features(line: str) -> list[int]:
    """The form and all words of a line."""
    return linear.hashed(form_features(line)) + linear.hashed(["w" + x for w in words_of(line) if len(w) < 40 and (x := w.strip(_PUNCTUATION)) and len(x) < 25])


def word_features(line: str) -> list[int]:
    """Only the words; long strings without a space are no words."""
    return linear.hashed(["w" + x for w in words_of(line) if len(w) < 25 and (x := w.strip(_PUNCTUATION)) and x != "0"])


def plain(line: str) -> str:
    return " ".join(filter(None, map(_PLAIN.__getitem__, line.lower().split())))


def fit(records: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Article and title models from the labelled lines and from (title, body_text) of sampled records."""
    pages, heads, articles = (labels.lines(x) for x in (labels.PAGE_PARTS, labels.TEASER_HEADS, labels.ARTICLE_LINES + labels.ABOUT))
    bodies = [[x.strip() for x in b.split("\n")] for _, b in records if b]
    often = Counter(re.sub(r"\d+", "0", plain(x)) for b in bodies for x in set(b))
    long = lambda x: len(x) >= 110 and _END.search(x) is not None and not _BULLET.match(x)
    once = lambda x: often[re.sub(r"\d+", "0", plain(x))] < 3
    prose = [x for b in bodies for x in b if long(x) and once(x)][:12_000]
    heading = [b[i] for b in bodies for i in range(1, len(b) - 1) if 3 < len(b[i]) < 90 and long(b[i - 1]) and long(b[i + 1]) and once(b[i])][:4_000]
    titles = sorted({t.strip() for t, _ in records if t and len(t.split()) > 2})[:4_000]
    cased = lambda xs: [v for x in xs for v in (x, x.upper(), x.lower())]
    names = sorted({m for x in prose[:3000] for m in _NAME.findall(x)})
    rng = np.random.default_rng(5)
    renamed = lambda x: _NAME.sub(lambda _: names[rng.integers(len(names))], x) if names else x
    pages = pages + [renamed(x) for x in pages if _NAME.search(x) for _ in range(8)]  # other names in the same lines
    articles = articles + [renamed(x) for x in articles if _NAME.search(x) for _ in range(4)]
    bulleted = [f"{b} {t}" for i, t in enumerate(titles) for b in [("*", "–", f"{i % 9 + 1}.")[i % 3]]]
    rows = [(x, 0) for x in cased(pages) * 3 + cased(heads) * 3] + [(x, 1) for x in cased(articles) * 3 + prose + heading] + [(x, 0) for x in bulleted[:1500]]
    article = linear.fit([line_features(x) for x, _ in rows], np.array([y for _, y in rows]), epochs=5)
    rows = [(x, 1) for x in titles + [t.upper() for t in titles[::10]]] + [(x, 0) for x in cased(pages + heads + articles) * 2 + prose[:4000] + heading]
    title = linear.fit([line_features(x) for x, _ in rows], np.array([y for _, y in rows]), epochs=5)
    return article, title


class WordWeights(dict):
    """Weights of words as they stand in a text, computed when first met (bounded)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        w = _NUMBER.sub("0", token.lower().replace("_", " ")).strip(_PUNCTUATION)
        value = self.weights.item(linear.index("w" + w)) if w and len(w) < 25 else 0.0
        if len(self) < 2 * MEMO:
            self[token] = value
        return value


class FormWeights(dict):
    """Weights of features, and sums of those of outer forms, computed when first met (bounded)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, feature: str | tuple) -> float:
        value = sum(map(self.__getitem__, shape_features(feature))) if isinstance(feature, tuple) else self.weights.item(linear.index(feature))
        if len(self) < 2 * MEMO:
            self[feature] = value
        return value


class Known(dict):
    """How much a token tells of a line, as far as it is a word: the size of its weight, computed when first met (bounded)."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, token: str) -> float:
        value = max((abs(self.weights.item(i)) for i in word_features(token)), default=-1.0)
        if len(self) < 2 * MEMO:
            self[token] = value
        return value


class Pages:
    """Scores lines and finds the article."""

    def __init__(self, article: np.ndarray, title: np.ndarray, switch: float = 1.2):
        self.article, self.title, self.switch = article, title, switch
        self.heads = {plain(x) for x in labels.lines(labels.TEASER_HEADS)}
        self.memo: dict[str, tuple[float, float, str]] = {}
        self.article_form, self.title_form = FormWeights(article), FormWeights(title)
        self.article_words, self.title_words = WordWeights(article), WordWeights(title)
        self.known = Known(article)
        self.sums: dict[str, float] = {}

    def ahead(self, bodies: list[str | None]) -> None:
        """Sums up the weights of the words of the long lines of the bodies that come next, each different word looked up once."""
        lines = list({x for b in bodies if b for x in map(str.strip, b.split("\n")) if len(x) >= LONG})
        at, first, words = tokens_of(lines)
        weights = np.fromiter(map(self.article_words.__getitem__, words), np.float64, len(words))
        self.sums = dict(zip(lines, np.add.reduceat(weights[at], first[:-1]).tolist())) if lines else {}

    @staticmethod
    def total(forms: tuple[tuple, list[str]], tokens: list[str], form: FormWeights, words: WordWeights, of_words: float | None = None) -> float:
        """The sum of the weights of ``line_features``, looked up (``of_words``: that of the words, where it is known)."""
        return form[forms[0]] + sum(map(form.__getitem__, forms[1])) + (sum(map(words.__getitem__, tokens)) if of_words is None else of_words)

    def scores(self, line: str) -> tuple[float, float, str]:
        """Log odds of an article's line and of a title (also behind a bullet or before a blurb); a short line's words."""
        known = self.memo.get(line)
        if known is None:
            forms, of_words = form_of(line), self.sums.get(line) if len(line) >= LONG else None
            tokens = line.split() if of_words is None else []
            a = self.total(forms, tokens, self.article_form, self.article_words, of_words)
            t = -9.0
            if len(line) < 320:
                bare = _BULLET.sub("", line)
                if bare and len(bare) < LONG:
                    own = (forms, tokens) if bare == line else (form_of(bare), bare.split())
                    t = self.total(*own, self.title_form, self.title_words)
                cut = _SPLIT.search(bare) if ":" in bare or "—" in bare or "|" in bare or "–" in bare else None
                if cut and 8 < cut.start() < 160:
                    head = bare[: cut.start()]
                    t = max(t, self.total(form_of(head), head.split(), self.title_form, self.title_words))
            if abs(a) > 1 and len(line) < LONG and self.unknown(line, tokens):
                a = max(-1.0, min(1.0, a))  # words the model doesn't know: the lines around decide
            known = (max(-5.0, min(5.0, a)), t, plain(line) if len(line) < 200 else "")
            if len(line) < LONG:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[line] = known
        return known

    def unknown(self, line: str, tokens: list[str]) -> bool:
        """Whether the model has no weight for any word, or the line is hardly in a script that it knows."""
        size = len(line) - line.count(" ")
        if len(line.encode("latin-1", "ignore").translate(None, _OTHER)) * 2 < size and len(_LATIN.findall(line)) * 2 < size:  # the first are most of the letters
            return "©" not in line and len(_STEPS.findall(line)) < 3
        return all(self.known[x] < 0.05 for x in tokens)

    def kept(self, body: str, own_title: str | None) -> list[bool | None]:
        """For each line whether it belongs to the article; None for blank lines."""
        lines = [x.strip() for x in body.split("\n")]
        own = plain(own_title) if own_title else ""
        value: list[float] = []
        teaser = False
        prose_seen = False
        for i, line in enumerate(lines):
            if not line:
                value.append(0.0)
                continue
            a, t, low = self.scores(line)
            if low in self.heads:
                teaser, a = True, -5.0
            elif own and low == own:
                a = 4.0
            elif t > 0:
                bullet = _BULLET.match(line) is not None
                if teaser or bullet:
                    a = min(a, -3.0)
                elif not prose_seen and (not own or len(own.split()) < 3) and len(_STEPS.findall(line)) < 2:
                    a = 0.5  # perhaps the headline of a page without a telling title
                else:
                    a = min(a, -1.6)
            elif teaser and len(line) < 100 and not _END.search(line):
                a -= 1.0
            else:
                teaser = False
            if a > 1 and len(line) > 110:
                prose_seen, teaser = True, False
            value.append(a)
        return [None if not x else k for x, k in zip(lines, regions(value, self.switch))]


def regions(value: list[float], cost: float) -> list[bool]:
    """The maximum-scoring set of regions, each paying ``cost`` at every end inside the page: one scan forward, one back."""
    inside, outside = -cost, 0.0
    steps: list[tuple[bool, bool]] = []
    for v in value:
        enter, leave = outside - cost > inside, inside - cost > outside
        inside, outside = max(inside, outside - cost) + v, max(outside, inside - cost)
        steps.append((enter, leave))
    at = inside > outside
    out = []
    for enter, leave in reversed(steps):
        out.append(at)
        at = (not enter) if at else leave
    return out[::-1]


def fitted(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The models from at most ``SAMPLE`` records."""
    rows = sample(df.select("doc_id", "title", "body_text"), SAMPLE).collect()
    return fit([(r.title, r.body_text) for r in rows])


def page_lines(df: DataFrame, models, residue=None) -> DataFrame:
    """doc_id, line_no of the lines outside the article. ``residue``: a fitted detector whose cases take no part."""
    shared = df.sparkSession.sparkContext.broadcast((models, residue))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, skip = shared.value
        pages = Pages(*models)
        test = skip.ready(pages) if skip is not None else None
        for batch in batches:
            ids, numbers = [], []
            for at in range(0, batch.num_rows, 256):  # bounded Python strings, whatever Spark's batch size
                part = batch.slice(at, 256)
                bodies = part.column(1).to_pylist()
                cases = test(bodies) if test else [False] * len(bodies)
                for doc, body, title, case in zip(part.column(0).to_pylist(), bodies, part.column(2).to_pylist(), cases):
                    if body and not case:
                        out = [no for no, k in enumerate(pages.kept(body, title)) if k is False]
                        ids += [doc] * len(out)
                        numbers += out
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int32())], names=["doc_id", "line_no"])

    return df.select("doc_id", "body_text", "title").mapInArrow(run, f"doc_id {kind}, line_no int")


def main_bodies(df: DataFrame, models, out: str = "main_text") -> DataFrame:
    """doc_id and the article's lines of every body (null stays null)."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = Pages(*shared.value)
        for batch in batches:
            texts = []
            for body, title in zip(batch.column(1), batch.column(2)):
                body = body.as_py()
                if body:
                    keep = pages.kept(body, title.as_py())
                    body = "\n".join(x for x, k in zip(body.split("\n"), keep) if k is not False)
                texts.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", out])

    return df.select("doc_id", "body_text", "title").mapInArrow(run, f"doc_id {kind}, {out} string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: doc_id, line_no of the lines that aren't the article's."""
    from tessera.llm.residue import fitted as fitted_residue

    df = documents(spark, sf_dir, "doc_id", "title", "body_text")
    return page_lines(df, fitted(df), fitted_residue(df))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 5: every body without its page parts."""
    df = documents(spark, sf_dir, "doc_id", "title", "body_text")
    return main_bodies(df, fitted(df))

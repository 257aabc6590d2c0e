"""Problem 4: values cut off by field limits or in transfer.

1. Lengths. For every source, field and unit (characters, UTF-8 bytes) the values are counted by length, then window
   functions over the counted lengths (never over records) give the discrete hazard of each length: values of that
   length among those at least as long. A limit shows as a length, or a short run of lengths where cuts fall on word
   ends or before a mark, whose hazard is above that of the lengths around it. The binomial tail (the values that end
   among those at risk, at the neighbours' hazard) is bounded by Chernoff's inequality, and Benjamini and Hochberg's
   rule controls false discoveries within source, field and unit. Every length that passes counts; what the hazards
   around it don't explain of its values (``excess``) is the prior that one of them was cut there.
2. Endings. A logistic model tells complete line ends from cut ones. It teaches itself: lines inside bodies are
   complete, whatever they are (prose, titles, lists, signatures, page parts), and the same lines cut at random
   places are not. It is fitted on the lines of at most ``SAMPLE`` records and applied to every value's last line.
3. A value is a case if ending and length together make a cut likely: the prior odds come from the length (the
   excess at a significant length, a small base rate elsewhere, high where a mark of omission ends the value). A
   finished sentence is a case only at a single length that nearly no value would have by itself.

Plan: one scan for lengths and last lines, which alone go to Python; counts are map-side combined. The significant
lengths are joined to the values by source, field and length.

Defined cases: null, empty and blank values are none. A null source is a source of its own. Repeated rows count
each. Very long values are judged by their whole last line. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import labels, linear
from tessera.llm.common import documents, is_blank, sample, stored

SAMPLE = 3000
FIELDS = ("body_text", "summary")
#: Fixed value: white space.
SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Marks of omission, and what a transfer broken off inside a tag, an entity or a character leaves at the end.
MARK = re.compile(
    r"\s*(?:…|\.{3,}|\[(?:…|\.{3})\]|\(…\)|\(\.{3}\)|(?:…|\.{3})?\s*\[\+\d+ \w+\]|(?:…|\.{3})?\s*[\(\[](?:read |see )?(?:more|mehr|weiter|weiterlesen|suite|lire la suite|más|leer más|seguir leyendo)[\)\]]"
    r"|�+|</?[a-z][^<>\n]{0,14}|&[a-z#0-9]{0,6})\s*$",
    re.I,
)
_DONE = re.compile(r"[.!?][\"”»)']*$")
_STOP = re.compile(r"[.!?…:;][\"”»')\]]*\s")


def values(df: DataFrame) -> DataFrame:
    """doc_id, source, field, value of every value that isn't blank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("v")
    return df.select("doc_id", "source", pairs).select("doc_id", "source", "v.field", "v.value").where(~is_blank(F.col("value")))


def length_tests(lengths: DataFrame, near: int = 40, gap: int = 3) -> DataFrame:
    """source, field, unit, length, n_marked, run, n, at_risk, hazard, expected, log_p, excess for runs of 1 and 12 lengths.

    ``hazard`` is the higher of the hazards ``gap`` to ``near`` lengths before and after the run, ``expected`` what it
    explains of the ``n`` values that end in the run.

    ``lengths``: source, field, chars, bytes, marked (ends with a mark of omission), digest of each value. Values that
    differ in digits only count once (messages of one form have one length without any limit).
    """
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("u")
    key = ["source", "field", "unit"]
    once = lengths.groupBy("source", "field", "chars", "bytes", "marked", "digest").agg(F.lit(1).alias("one"))
    count = once.select("source", "field", "marked", units).groupBy("source", "field", "u.unit", "u.length").agg(F.count("*").alias("n"), F.count_if("marked").alias("n_marked"))
    own = Window.partitionBy(*key).orderBy("length")
    length = F.col("length")

    def ended(a: int, b: int) -> Column:
        """Values whose lengths are by ``a`` to ``b`` above this one."""
        return F.coalesce(F.sum("n").over(own.rangeBetween(a, b)), F.lit(0))

    def exposed(a: int, b: int) -> Column:
        """The same lengths' values at risk, added up over these lengths: each value counts once for every length it reaches."""
        before = F.greatest(length + a - 1, F.lit(0))
        reached = F.coalesce(F.sum(F.col("n") * length).over(own.rangeBetween(a, b)), F.lit(0)) - ended(a, b) * before
        return reached + (F.greatest(length + b, F.lit(0)) - before) * F.coalesce(F.sum("n").over(own.rangeBetween(b + 1, Window.unboundedFollowing)), F.lit(0))

    def test(run: int) -> Column:
        """A run of lengths that ends here, and the hazard on both sides of it."""
        sides = ((-near - run + 1, -gap - run + 1), (gap, near))
        hazard = F.greatest(*[(ended(a, b) + 1) / (exposed(a, b) + b - a + 1) for a, b in sides])  # the higher of both, as hazards may rise
        return F.struct(F.lit(run).alias("run"), ended(1 - run, 0).alias("n"), exposed(1 - run, 0).alias("at_risk"), hazard.alias("hazard"))

    tests = count.select(*key, "length", "n_marked", F.array(test(1), test(12)).alias("tests")).select(*key, "length", "n_marked", F.explode("tests").alias("t"))
    each = tests.select(*key, "length", "n_marked", "t.*").withColumn("expected", F.col("at_risk") * F.col("hazard"))
    n, risk, h = F.col("n"), F.col("at_risk"), F.least(F.col("hazard"), F.lit(1 - 1e-9))
    left = F.when(risk > n, (risk - n) * F.log((risk - n) / risk / (1 - h))).otherwise(F.lit(0.0))
    return each.withColumn("log_p", F.when(n > risk * h, -(n * F.log(n / risk / h) + left)).otherwise(F.lit(0.0))).withColumn("excess", F.greatest(F.lit(0.0), (n - F.col("expected")) / n))


def significant(tests: DataFrame, fdr: float = 0.01) -> DataFrame:
    """The lengths that stand out, by Benjamini and Hochberg's rule within source, field and unit."""
    own = Window.partitionBy("source", "field", "unit").orderBy("log_p", "length", "run")
    whole = Window.partitionBy("source", "field", "unit")
    ranked = tests.withColumn("k", F.row_number().over(own)).withColumn("m", F.count("*").over(whole))
    passed = F.col("log_p") <= F.log(F.col("k") / F.col("m") * F.lit(fdr))
    most = F.max(F.when(passed, F.col("k")).otherwise(0)).over(whole)
    return ranked.withColumn("most", most).where(F.col("k") <= F.col("most")).drop("k", "m", "most")


class Endings:
    """What the sample knows: whole lines and words met at least twice, beginnings of such words, and the model's weights."""

    def __init__(self, lines: list[str]):
        flat = [" ".join(re.sub(r"\d+", "0", x.lower()).split()) for x in lines]
        words = Counter(w for x in flat for w in set(re.findall(r"[^\W\d_]+", x)))
        self.lines = {x for x, n in Counter(flat).items() if n > 1}
        self.words = {w for w, n in words.items() if n > 1}
        self.starts = {w[:i] for w in self.words for i in range(1, len(w))}
        self.weights = np.zeros(linear.MASK + 2, dtype=np.float32)

    def features(self, line: str) -> list[int]:
        flat = " ".join(re.sub(r"\d+", "0", line.lower()).split())
        last = re.findall(r"[^\W\d_]+$", flat)
        state = "none" if not last else "known" if last[0] in self.words else "start" if last[0] in self.starts else "new"
        both = "both" if last and last[0] in self.words and last[0] in self.starts else "one"
        inside = "in" if _STOP.search(line) else "one"
        seen = "L1" if flat in self.lines else "L0"
        return end_features(line) + linear.hashed(["v" + state, "v" + state + inside, "v" + state + both + inside, seen, seen + state, seen + inside + ("." if _DONE.search(line) else "")])

    def odds(self, lines: list[str]) -> np.ndarray:
        return linear.score(self.weights, [self.features(x) if x else [] for x in lines]).astype(float)


def end_features(line: str) -> list[int]:
    """Hashed features of how a line ends (and what line it is)."""
    low = " ".join(line.lower().split())
    words = low.split(" ")
    last, prev = words[-1], words[-2] if len(words) > 1 else ""
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", line.split()[-1] if line.split() else ""))
    shape = re.sub(r"(.)\1+", r"\1+", shape)
    stops = list(_STOP.finditer(line))
    since = len(line[stops[-1].end() :].split()) if stops else len(words)
    end = "stop" if low[-1:] in ".!?" or low[-2:] in ('."', ".”", ".»", ".)", "?”", "?»") else "word" if low[-1:].isalpha() else "digit" if low[-1:].isdigit() else low[-1:]
    inside = "in" if stops else "one"
    size = min(12, len(low) // 15)
    plain = re.sub(r"\d+", "0", low)
    return linear.hashed([
        "=" + plain, "w" + re.sub(r"\d", "0", last), "p" + re.sub(r"\d", "0", prev + " " + last), "s" + shape, "e" + end, "ei" + end + inside, f"es{end}{inside}{min(since, 12)}",
        f"el{end}{size}", "f" + end + re.sub(r"\d", "0", words[0]), "b" + end + line[:1] if not line[:1].isalnum() else "b", "t3" + plain[-3:], "t4" + plain[-4:], "t6" + plain[-6:],
        "fb" + re.sub(r"\d", "0", " ".join(words[:2])) + end, f"n{end}{min(len(words), 15)}", "c" + end + ("U" if line.isupper() else "T" if line.istitle() else "l"), "pw" + re.sub(r"\d", "0", prev) + end, "bias",
    ])


def fit_endings(bodies: list[str], seed: int = 4, most: int = 30_000) -> Endings:
    """The model of cut endings, from complete lines and from the same lines cut at random.

    Complete are the inner lines of bodies, last lines that several bodies share, and the labelled lines.
    """
    rng = np.random.default_rng(seed)
    rows, truth = [], []
    lines = [x.strip() for b in bodies for x in b.split("\n")[:-1] if x.strip()]
    if len(lines) > most:
        lines = [lines[i] for i in rng.permutation(len(lines))[:most]]
    ends = Counter(b.rstrip().rsplit("\n", 1)[-1].strip() for b in bodies if b and b.strip())
    known = [x for block in (labels.PAGE_PARTS, labels.NOTICES, labels.FILLER, labels.RESIDUE) for x in labels.lines(block)]
    lines += [x for x, n in ends.items() if n > 1 for _ in range(min(n, 5))] + [v for x in known for v in (x, x, x.upper())]
    model = Endings(lines)
    for line in lines:
        rows.append(model.features(line))
        truth.append(0)
        if len(line) > 12:
            at = int(rng.integers(8, len(line)))
            cut = line[:at]
            if rng.random() < 0.25 and " " in cut[6:]:
                cut = cut[: cut.rindex(" ")]
            cut = cut.rstrip()
            if cut and not (cut[-1] in ".!?" and line[at : at + 1] in ("", " ")):
                rows.append(model.features(cut))
                truth.append(1)
    model.weights = linear.fit(rows, np.array(truth))
    return model


def judged(df: DataFrame, model: Endings, base: float = 0.015, marked: float = 0.9) -> DataFrame:
    """``df`` (with tail, excess, sharp) -> doc_id, source, field, cut, mark, odds."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for part in parts:
            texts = [t.rstrip().rsplit("\n", 1)[-1].strip() for t in part["tail"]]
            bare = [MARK.sub("", t) if MARK.search(t) else t for t in texts]
            marks = np.array([b != t for b, t in zip(bare, texts)], dtype=bool)
            odds = model.odds(bare)
            prior = part.excess.clip(0.0, 0.99).fillna(0.0).to_numpy()
            prior = np.where(marks, np.maximum(prior, marked), np.maximum(prior, base))
            odds = odds + np.log(prior / (1 - prior))
            sharp = part.sharp.fillna(0.0).to_numpy()
            done = np.array([bool(_DONE.search(b)) for b in bare], dtype=bool) & ~marks  # a finished sentence: only an exact limit tells
            odds = np.where(done, np.where(sharp >= 0.95, 1.0, -9.0), odds)
            yield pd.DataFrame({"doc_id": part.doc_id, "source": part.source, "field": part.field, "cut": odds > 0, "mark": marks, "odds": odds})

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "source", "field", "tail", "excess", "sharp").mapInPandas(run, f"doc_id {kind}, source string, field string, cut boolean, mark boolean, odds double")


def cut_values(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Every value that isn't blank with doc_id, source, field, cut, mark, odds."""
    tails = values(df).select(
        "doc_id", "source", "field", F.length("value").cast("long").alias("chars"), F.octet_length("value").cast("long").alias("bytes"), F.substring_index(F.rtrim("value", F.lit(SPACE)), "\n", -1).alias("tail"),
        F.xxhash64(F.regexp_replace("value", r"[0-9a-f]*\d[0-9a-f]*", "0")).alias("digest"),
    )
    tails = stored(spark, tails.withColumn("marked", F.col("tail").rlike(r"(…|\.\.\.|[\])])$")), "p4-tails")
    limits = significant(length_tests(tails)).select("source", "field", "unit", "run", "n", "n_marked", F.explode(F.sequence(F.col("length") - F.col("run") + 1, F.col("length"))).alias("length"), "excess")
    limits = limits.groupBy("source", "field", "unit", "length").agg(F.max("excess").alias("excess"), F.max(F.when((F.col("run") == 1) & (F.col("n_marked") * 2 < F.col("n")), F.col("excess"))).alias("sharp"))
    limits = stored(spark, limits, "p4-limits")
    for unit in ("chars", "bytes"):
        own = limits.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("length").alias("l"), F.col("excess").alias(f"x_{unit}"), F.col("sharp").alias(f"s_{unit}"))
        tails = tails.join(own, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col(unit) == F.col("l")), "left").drop("s", "f", "l")
    tails = tails.withColumn("excess", F.greatest("x_chars", "x_bytes")).withColumn("sharp", F.greatest("s_chars", "s_bytes"))
    bodies = [r.body_text for r in sample(df.where("body_text is not null").select("doc_id", "body_text"), SAMPLE).collect()]
    return judged(tails, fit_endings(bodies))


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "source", *FIELDS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: doc_id, field of every cut value."""
    return cut_values(spark, _table(spark, sf_dir)).where("cut").select("doc_id", "field").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 4: source, field, values, cut, share."""
    found = cut_values(spark, _table(spark, sf_dir))
    return found.groupBy("source", "field").agg(F.count("*").alias("values"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))

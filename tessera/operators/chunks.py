"""Operators on texts: windows, frequent terms, routing, JSON repair."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, words_of


def windows(docs: DataFrame, whole: int = 3000, size: int = 1200, step: int = 1000, text: str = "text") -> DataFrame:
    """doc_id, chunk_index, chunk. Texts under ``whole`` words are one chunk as they are, others overlapping windows with a header line."""
    words = docs.where(F.col(text).isNotNull()).select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.col(text).alias("_t"), words_of(F.col(text)).alias("_w"))
    words = words.withColumn("_n", F.size("_w")).where("_n > 0")
    count = F.when(F.col("_n") < whole, F.lit(1)).otherwise(F.ceil(F.col("_n") / step).cast("int"))
    head = lambda i: F.concat(F.col("title"), F.lit(" ("), i + 1, F.lit("/"), F.col("_c"), F.lit(")\n"))
    part = lambda i: F.concat(head(i), F.array_join(F.slice("_w", i * step + 1, F.lit(size)), " "))
    # windows are cut inside the row, so that its words aren't copied for each of them
    parts = F.when(F.col("_n") < whole, F.array("_t")).otherwise(F.transform(F.sequence(F.lit(0), F.col("_c") - 1), part))
    return words.withColumn("_c", count).select("doc_id", F.posexplode(parts).alias("chunk_index", "chunk"))


def frequent_terms(docs: DataFrame, most: int, least_length: int = 3) -> DataFrame:
    """doc_id, term, n, r: the most frequent terms of each document. Partial counts are combined before the shuffle."""
    term = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("term")
    counts = docs.select("doc_id", term).where(~F.col("term").isin(*STOP_WORDS) & (F.length("term") >= least_length)).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "term"))
    return counts.withColumn("r", rank).where(F.col("r") <= most)


def first_rule(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        out = out.when(test, name)
    return out.otherwise(default)


def broken_json(docs: DataFrame) -> DataFrame:
    """doc_id, raw: objects of a record's fields, every third with a trailing comma and every fifth cut at the end."""
    raw = F.to_json(F.struct(F.col("doc_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), "topics"))
    comma = F.concat(F.expr("left(raw, length(raw) - 1)"), F.lit(",}"))
    return docs.select("doc_id", raw.alias("raw")).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, comma).when(F.col("doc_id") % 5 == 0, F.expr("left(raw, length(raw) - 2)")).otherwise(F.col("raw")).alias("raw")
    )


def repaired(text: str | None) -> str | None:
    """A parsable form of a model's JSON: fences, control characters and trailing commas dropped, open brackets closed; None if hopeless."""
    if text is None:
        return None
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text).strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", t, re.S)
    t = fenced.group(1).strip() if fenced else t
    if "{" in t:
        t = t[t.index("{") :]
    stack, inside, skip = [], False, False
    for c in t:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif c == '"':
            inside = not inside
        elif not inside and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not inside and c in "}]" and stack:
            stack.pop()
    closed = t + ('"' if inside else "") + "".join(reversed(stack))
    for candidate in (t, closed):
        candidate = re.sub(r",\s*([}\]])", r"\1", candidate)
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
        except ValueError:
            continue
    return None


def repair_json(df: DataFrame) -> DataFrame:
    """doc_id, fixed. Valid objects stay in the JVM; only the rest goes to Python."""
    good = F.try_parse_json("raw").isNotNull()
    fine = df.where(good).select("doc_id", F.col("raw").alias("fixed"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p.doc_id, "fixed": [repaired(x) for x in p.raw]})

    return fine.union(df.where(~good).select("doc_id", "raw").mapInPandas(run, "doc_id long, fixed string"))

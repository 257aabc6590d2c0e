"""Problem 6: encode every text with a public byte-pair vocabulary.

Method: a backtracking encoder. An Aho-Corasick automaton over the vocabulary finds every token that occurs in a
piece; from each position the longest is tried first and kept only if it is *compatible* with the token before it,
that is if merging the two tokens' bytes gives just these two tokens back. A sequence whose neighbours are all
compatible is the exact merge result, and a position that failed once can never be part of it, so each is
tried once. The compatibility table is filled as pairs are met (bounded; refilled after overflow). Decoding slices one byte string by an offset table.

The text is first cut into pieces by the vocabulary's split pattern. Each task keeps the ids of pieces it has met
(bounded; refilled after overflow), which changes speed only.

Defined cases: null, empty -> empty list. White space only, other scripts, broken surrogates: encoded as UTF-8 bytes
(unpaired surrogates as U+FFFD, as they can't be stored in Parquet anyway). Special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents, tokenizer_path

#: Fixed value: the split pattern of the rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pairs that the compatibility table holds at most (some 100 MB); it is filled again when full.
FITS = 1_000_000


class BytePairEncoder:
    """Exact byte-pair encoding of strings with the ranks of a ``.tiktoken`` file."""

    def __init__(self, path: str, memo: int = 150_000):
        import ahocorasick

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        size = max(self.rank.values()) + 1
        self.token = [""] * size
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.token[r] = t
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.token]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = "".join(self.token).encode("latin-1")
        self.fits: dict[int, bool] = {}  # bounded like the memo
        self.memo: dict[str, list[int]] = {}
        self.most = memo
        self.size = size
        self.split = regex.compile(SPLIT)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens ``a b`` ends in exactly these two tokens."""
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            left = self.length[a]
            parts = list(self.token[a] + self.token[b])
            rank = self.rank
            while len(parts) > 1:
                pairs = [(rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
                best, i = min(pairs)
                if best == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if len(self.fits) >= FITS:
                self.fits.clear()
            known = self.fits[key] = len(parts) == 2 and len(parts[0]) == left
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        s = text.encode("utf-8", "replace").decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        starts: list[list[int]] = [[] for _ in s]
        for end, t in self.automaton.iter(s):
            starts[end + 1 - self.length[t]].append(t)  # the longest comes last
        out: list[int] = []
        tried: list[int] = []
        dead = [False] * (len(s) + 1)
        at, k = 0, len(starts[0]) - 1
        while at < len(s):
            while k >= 0:
                t = starts[at][k]
                if not dead[at + self.length[t]] and (not out or self.compatible(out[-1], t)):
                    break
                k -= 1
            if k >= 0:
                out.append(t)
                tried.append(k)
                at += self.length[t]
                k = len(starts[at]) - 1 if at < len(s) else 0
            else:
                dead[at] = True
                at -= self.length[out.pop()]
                k = tried.pop() - 1
        return out

    def _pieces(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for p in self.split.findall(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= self.most:
                    memo.clear()
                ids = memo[p] = self.piece(p)
            out.extend(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text. Words between single spaces are looked up whole; other white space goes through the pattern."""
        if not text:
            return []
        memo = self.memo
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._pieces(text)
        out = list(self._pieces(first))
        for w in rest:
            ids = memo.get("\0" + w)
            if ids is None:
                if not w or w[0].isspace() or w[-1].isspace():
                    return self._pieces(text)
                ids = self._pieces(" " + w)
                if len(w) < 40:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo["\0" + w] = ids
            out.extend(ids)
        return out

    def count(self, text: str | None) -> int:
        """The number of ids of a text."""
        return len(self.encode(text))

    def decode(self, ids) -> str:
        """The text of ids."""
        o, b = self.offsets, self.bytes
        return b"".join(b[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per worker process."""
    return BytePairEncoder(path)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``key`` and the id list of ``text`` for every row of ``df`` (a row-wise map: no shuffle; repeated keys stay)."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    source = df.select(F.col(key), F.col(text))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, max(1, batch.num_rows), 1024):  # bounded Python lists, whatever Spark's batch size
                part = texts.slice(at, 1024)
                values: list[int] = []
                ends = [0]
                for t in part.to_pylist():
                    values += encode(t)
                    ends.append(len(values))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(values, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), ids], names=[key, out])

    return source.mapInArrow(run, schema)


def count_column(df: DataFrame, keep: list[str], text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """The ``keep`` columns and the number of tokens of ``text``."""
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            *kept, texts = batch.columns
            sizes = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64())], names=[*keep, out])

    return df.select(*keep, text).mapInArrow(run, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 6: doc_id, ids of every document's text."""
    return encode_column(documents(spark, sf_dir, "doc_id", "text"))

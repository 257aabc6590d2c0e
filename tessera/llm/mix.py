"""Problem 7: a mix of sources near target shares, with capped repeats.

1. Tokens of every record of a listed source (one scan; the sizes are stored, not the texts).
2. A keyed 64-bit hash puts the records of a source in random order; its top bits make ``BLOCKS`` blocks. Only the
   table of block sizes (sources x blocks, a fixed bound) comes to the driver. The largest total at which every
   source can meet its share within its repeats gives each source its quota: some whole repeats of everything, and a
   rest that ends at one hash value. That value is found by splitting the last block again, always by counts of
   ``BLOCKS`` sub-blocks, until single records are left. So the quota is met to within one record.
3. A splitting tree deals blocks to output shards: at each node the multivariate hypergeometric distribution splits
   the exact number of blocks of each source between left and right; at the leaves each source's blocks, in keyed
   permutation, are drawn without replacement. Where the blocks are too few for the shards wanted (the driver's table
   stays as it is), tasks split on: each block has ``LEAF`` sub-blocks for every further shard, and a keyed permutation
   of these gives each shard exactly as many. Rows are moved to their shard and shuffled there by ``order_key``.

Plan: the deal table is bounded by sources x blocks x repeats and broadcast; records are never sorted or windowed by
source, so a source with most of the rows costs no more than its share. One shuffle of the result, by shard.

Defined cases: sources that aren't listed, null and empty texts take no part. A listed source without any token
reports an actual share of 0 and doesn't limit the others. A repeated row is a record of its own key but shares its
copies' hash. ``max_repeats`` null or < 1, ``target_share`` null or <= 0: not mixed. Empty tables: empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stored
from tessera.llm.encode import count_column

BLOCKS_BITS = 10
BLOCKS = 1 << BLOCKS_BITS
#: Blocks that a shard has at least, as a power of two.
LEAF_BITS = 4
LEAF = 1 << LEAF_BITS


def sized(spark: SparkSession, docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, tokens, key of the records that can be mixed. The targets table is small by definition."""
    own = targets.where("target_share > 0 and max_repeats >= 1").select("source").distinct()
    if own.count() <= 100_000:
        own = F.broadcast(own)
    used = docs.join(own, "source", "left_semi").where("text <> ''")
    table = count_column(used.select("doc_id", "source", "text"), ["doc_id", "source"])
    return stored(spark, table.withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 1)), "p7-sizes")


def sub_blocks(table: DataFrame, spans: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Tokens and records by source and sub-block of the given key spans (source, low, high)."""
    spark = table.sparkSession
    few = F.broadcast(spark.createDataFrame(spans, "source string, low long, high long"))
    part = table.join(few, "source").where("key >= low and key <= high")
    block = F.shiftrightunsigned(F.col("key") - F.col("low"), bits)
    return part.groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records")).toPandas().sort_values(["source", "block"])


def plan_quota(blocks: pd.DataFrame, targets: pd.DataFrame, total: int | None) -> pd.DataFrame:
    """source, share, max_repeats, available, quota, full (whole repeats), rest (tokens of one more repeat)."""
    have = blocks.groupby("source").tokens.sum()
    plan = targets.assign(available=targets.source.map(have).fillna(0).astype("int64"))
    can = plan[plan.available > 0]
    most = float((can.available * can.max_repeats / can.target_share).min()) if len(can) else 0.0
    size = most if total is None else float(total)
    plan["quota"] = np.minimum(plan.target_share * size, plan.available * plan.max_repeats)
    plan["full"] = np.floor(plan.quota / plan.available.clip(lower=1) + 1e-9).astype("int64").where(plan.available > 0, 0)
    plan["rest"] = (plan.quota - plan.full * plan.available).clip(lower=0)
    plan.loc[plan.full >= plan.max_repeats, "rest"] = 0.0
    return plan.reset_index(drop=True)


def cut_keys(table: DataFrame, blocks: pd.DataFrame, plan: pd.DataFrame) -> dict[str, int]:
    """For each source the hash value up to which one more repeat is used (-1: none)."""
    left = {r.source: float(r.rest) for r in plan.itertuples()}
    cut = dict.fromkeys(left, -1)
    low = dict.fromkeys(left, 0)
    bits = 63 - BLOCKS_BITS
    level = blocks[blocks.source.map(left) > 0]
    while len(level):
        spans = []
        for source, part in level.groupby("source"):
            total = part.tokens.cumsum().to_numpy()
            over = int(np.searchsorted(total, left[source], side="right"))
            before = int(total[over - 1]) if over else 0
            if over:
                cut[source] = low[source] + ((int(part.block.iloc[over - 1]) + 1) << bits) - 1
            left[source] -= before
            if over < len(part):
                row = part.iloc[over]
                start = low[source] + (int(row.block) << bits)
                if row.records == 1 or bits == 0:
                    if row.tokens - left[source] < left[source]:  # nearer with this record than without it
                        cut[source] = start + (1 << bits) - 1
                elif left[source] > 0:
                    spans.append((source, start, start + (1 << bits) - 1))
                low[source] = start
        if not spans:
            break
        bits = max(0, bits - BLOCKS_BITS)
        level = sub_blocks(table, pd.DataFrame(spans, columns=["source", "low", "high"]), bits)
    return cut


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard: counts split exactly, node by node, by multivariate hypergeometric draws."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    size = int(round(counts.sum() * left / shards))
    draw = rng.multivariate_hypergeometric(counts, size, method="marginals")
    return np.vstack([split_tree(draw, left, rng), split_tree(counts - draw, shards - left, rng)])


def deal(blocks: pd.DataFrame, plan: pd.DataFrame, cut: dict[str, int], shard_tokens: int, seed: int) -> tuple[pd.DataFrame, int]:
    """source, block, copy, shard: which shard gets which copy of which block; into how many (as a power of two) each is split."""
    rng = np.random.default_rng(seed)
    units = []
    for r in plan.itertuples():
        own = blocks[blocks.source == r.source].block.to_numpy()
        last = cut[r.source] >> (63 - BLOCKS_BITS) if cut[r.source] >= 0 else -1
        for copy in range(r.full + 1):
            use = own if copy < r.full else own[own <= last]
            units.append(pd.DataFrame({"source": r.source, "block": use, "copy": copy}))
    table = pd.concat(units, ignore_index=True) if units else pd.DataFrame({"source": [], "block": [], "copy": []})
    if not len(table):
        return table.assign(shard=[]), 0
    wanted = max(1, round(plan.quota.sum() / shard_tokens))
    shards = int(max(1, min(wanted, len(table) // LEAF)))
    more = max(0, int(wanted - 1) // shards).bit_length()
    table = table.iloc[rng.permutation(len(table))].sort_values("source", kind="stable", ignore_index=True)
    names, counts = np.unique(table.source, return_counts=True)
    quota = split_tree(counts.astype(np.int64), shards, rng)
    table["shard"] = np.concatenate([np.repeat(np.arange(shards), quota[:, i]) for i in range(len(names))])
    return table, more


def mix(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: int | None = None, shard_tokens: int = 1 << 22, seed: int = 7) -> DataFrame:
    """shard, order_key, doc_id, copy, source, tokens: the mix. ``targets`` (source, target_share, max_repeats) is small.

    ``total``: tokens wanted; None takes the most at which every source meets its share within its repeats. A larger
    total gives sources at their repeat limit less than their share.
    """
    table = sized(spark, docs, targets, seed)
    goal = targets.where("target_share > 0 and max_repeats >= 1").select("source", "target_share", "max_repeats").toPandas().drop_duplicates("source").sort_values("source")
    spans = pd.DataFrame({"source": goal.source, "low": 0, "high": (1 << 63) - 1})
    blocks = sub_blocks(table, spans, 63 - BLOCKS_BITS)
    plan = plan_quota(blocks, goal, total)
    cut = cut_keys(table, blocks, plan)
    dealt, more = deal(blocks, plan, cut, shard_tokens, seed)
    ends = pd.DataFrame([(r.source, int(r.full), cut[r.source]) for r in plan.itertuples()], columns=["source", "full", "cut"])
    dealt = F.broadcast(spark.createDataFrame(dealt.merge(ends, on="source", how="left"), "source string, block long, copy int, shard int, full int, cut long"))
    rows = table.withColumn("block", F.shiftrightunsigned("key", 63 - BLOCKS_BITS)).join(dealt, ["source", "block"])
    rows = rows.where((F.col("copy") < F.col("full")) | (F.col("key") <= F.col("cut")))
    shard = F.col("shard")
    if more:  # the sub-blocks of a block, in a keyed permutation: an odd factor and a shift
        mask = (1 << (more + LEAF_BITS)) - 1
        sub = F.shiftrightunsigned("key", max(0, 63 - BLOCKS_BITS - more - LEAF_BITS)).bitwiseAND(mask)
        unit = F.xxhash64(F.lit(seed + 2), "source", "block", "copy")
        turned = (sub * unit.bitwiseAND(mask).bitwiseOR(1) + F.shiftrightunsigned(unit, 32)).bitwiseAND(mask)
        shard = F.shiftleft(shard.cast("long"), more) + F.shiftright(turned, LEAF_BITS)
    rows = rows.select(shard.cast("long").alias("shard"), F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("order_key"), "doc_id", "copy", "source", "tokens")
    return rows.repartition("shard").sortWithinPartitions("shard", "order_key")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, actual_share, tokens, records, copies, repeats (the most copies of one record)."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).alias("records"), (F.max("copy") + 1).alias("repeats"))
    whole = used.agg(F.sum("tokens").alias("whole"))
    wide = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").crossJoin(F.broadcast(whole))  # one row
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tokens", "records", "copies", "repeats")]
    return wide.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), "max_repeats", *zero)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return documents(spark, sf_dir, "doc_id", "source", "text"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: the mix."""
    return mix(spark, *_tables(spark, sf_dir))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 7: target and actual shares and repeats of each source."""
    docs, targets = _tables(spark, sf_dir)
    return report(mix(spark, docs, targets), targets)

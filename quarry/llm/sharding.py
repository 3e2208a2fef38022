"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Every input partition permutes its rows locally; how many of them go to each shard is drawn from the
multivariate hypergeometric law, so that a uniform permutation of the whole table results while every shard
gets exactly its size; after the exchange each shard is permuted again. Only metadata (row counts of input
partitions, one per scan split, and the matrix drawn from them) visits the driver.

Defined cases: a null text counts as empty (size 16, crc 0); null ids and repeated rows are rows like any
other; an empty table gives an empty result; more shards than rows leaves shards empty; extra columns are
ignored by the digest and kept by `shuffle_shards`, whose own columns start with an underscore.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import check_columns, load, materialize

#: Largest matrix that is broadcast, in cells of 8 bytes; a larger one is joined by shuffle.
BROADCAST_CELLS = 1_000_000
#: Rows that one task of the second permutation sorts, on average.
ROWS_A_BUCKET = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One exact hypergeometric draw; beyond numpy's range by inversion outwards from the mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    lo, hi = max(0, sample - bad), min(good, sample)
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    lg = math.lgamma
    p = math.exp(lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(sample - mode + 1) - lg(bad - sample + mode + 1) - lg(good + bad + 1) + lg(sample + 1) + lg(good + bad - sample + 1))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            pu *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > lo:
            pd *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows: input partitions, columns: shards; row sums are counts, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    small = total < 1_000_000_000  # numpy draws a whole row at once
    for i, left in enumerate(counts):
        if small:
            out[i] = rng.multivariate_hypergeometric(room, left, method="marginals")
            room = (np.asarray(room) - out[i]).tolist()
            continue
        rest = sum(room)
        for j in range(n_shards):
            rest -= room[j]
            out[i, j] = x = left if j == n_shards - 1 else hypergeometric(rng, room[j], rest, left)
            room[j] -= x
            left -= x
            if not left:
                break
    return out


def shuffle_shards(df: DataFrame, *tie: str, n_shards: int = 40, seed: int = 20_240_501) -> DataFrame:
    """df with _shard and _slot: a uniform random permutation cut into n_shards shards of equal row counts.

    tie: columns whose hash orders the rows of a partition; rows alike in them are interchangeable.
    """
    spark = df.sparkSession
    local = df.withColumn("_u", F.xxhash64(F.lit(seed), *(F.col(c) for c in tie))).sortWithinPartitions("_u", *tie)
    thin = materialize(local.drop("_u").withColumn("_rid", F.monotonically_increasing_id()), "shards")
    part = F.shiftrightunsigned("_rid", 33)
    counts = {r[0]: r[1] for r in thin.groupBy(part.alias("p")).count().collect()}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], n_shards, seed)
    ends = spark.createDataFrame([(p, row) for p, row in zip(parts, np.cumsum(matrix, axis=1).tolist())], "_part long, _ends array<long>")
    if matrix.size <= BROADCAST_CELLS:
        ends = F.broadcast(ends)
    pos = F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    total = sum(counts.values())
    bits = max(0, math.ceil(math.log2(max(1, total) / (n_shards * ROWS_A_BUCKET))))
    dealt = (
        thin.withColumn("_part", part)
        .join(ends, "_part")
        .withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= pos)))
        .withColumn("_v", F.xxhash64(F.lit(seed + 1), "_rid"))
        .withColumn("_b", F.shiftrightunsigned("_v", 64 - bits) if bits else F.lit(0).cast("long"))
        .drop("_part", "_ends")
    )
    before = Window.partitionBy("_shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_shard", "_b").count().select("_shard", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_shard", "_b").orderBy("_v", "_rid")
    return dealt.join(sizes, ["_shard", "_b"]).withColumn("_slot", F.col("_first") + F.row_number().over(within) - 1).drop("_b", "_v", "_rid", "_first")


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    check_columns(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffle_shards(thin, "doc_id", "text_crc32", "size").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

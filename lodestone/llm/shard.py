"""Sharding by a keyed permutation of global row numbers.

A Feistel network over the smallest even-width domain that holds all rows, walked along its cycles until it
lands below the row count, permutes row numbers 0..n-1. Shard and slot follow from the permuted number alone
(number mod shards, number div shards), so any row's place can be computed from its row number and back.

Nulls: a null text has 0 bytes, a null doc_id is a value like any other and sorts first. Repeated rows are
separate rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, mix

ROUNDS = 6


def _round_keys(seed: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def permute(x: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, on an array."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _round_keys(seed)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (mix(left + k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(np.asarray(x).astype(np.uint64))
    while len(out) and (off := out >= np.uint64(n)).any():  # cycle walking: the domain is under 4 n, so a few steps
        out[off] = once(out[off])
    return out.astype(np.int64)


def row_numbers(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Adds row_number, gapless from 0 by the order columns, without one task for all rows.

    Rows are range-partitioned and sorted, written with their partition and place in it, and partition sizes
    (one number each) are summed up on the driver.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    put = df.repartitionByRange(*order).sortWithinPartitions(*order)
    put = materialize(put.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["_part"], r["n"]) for r in put.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(offsets, "_part long, _base long"))
    return put.join(base, "_part").withColumn("row_number", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base"), total


def shard(df: DataFrame, shards: int, seed: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot: row counts of shards differ by one at most."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.xxhash64(raw).alias("_tie"),
    )
    numbered, total = row_numbers(slim, "doc_id", "_tie", "text_crc32", "size")

    @F.pandas_udf("long")
    def permuted(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed))

    out = numbered.withColumn("_p", permuted("row_number"))
    return out.select("doc_id", "size", "text_crc32", "row_number", F.pmod("_p", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"))


def op7_feistel_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")

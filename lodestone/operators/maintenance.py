"""Sizes, verification, live sets and compaction decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import live

MIB = 1 << 20


def store_stats(frames: DataFrame) -> DataFrame:
    """One row: frames in all, by state, and text bytes."""
    size = F.coalesce(F.octet_length("search_text"), F.lit(0))
    return frames.agg(
        F.count("*").alias("frames"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "deleted").alias("deleted"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum(F.when(~live(), size)), F.lit(0)).cast("long").alias("dead_bytes"),
    )


def dead_fraction(stats: DataFrame) -> DataFrame:
    return stats.withColumn("dead_fraction", F.round(F.coalesce(F.try_divide("dead_bytes", "bytes"), F.lit(0.0)), 6))


def rewrite_live_set(frames: DataFrame) -> DataFrame:
    """frames with the payload of those that are not live emptied; ids and metadata stay."""
    return frames.withColumn("search_text", F.when(live(), F.col("search_text")).otherwise(F.lit("")))


def compaction_decision(counters: DataFrame, every: int = 32, interval_ms: int = 300_000, idle_ms: int = 15_000, dead_bytes: int = 64 * MIB, fraction: float = 0.25) -> DataFrame:
    """counters (flushes, since_last_ms, idle_ms, bytes, dead_bytes) with the first gate that holds a compaction back, or run."""
    ratio = F.coalesce(F.try_divide(F.col("dead_bytes").cast("double"), F.col("bytes")), F.lit(0.0))
    gate: Column = (
        F.when(F.col("flushes") % every != 0, "cadence")
        .when(F.col("since_last_ms") < interval_ms, "interval")
        .when(F.col("idle_ms") < idle_ms, "busy")
        .when((F.col("dead_bytes") < dead_bytes) & (ratio < fraction), "small_gain")
        .otherwise("run")
    )
    return counters.withColumn("decision", gate)


def auto_commit(pending: DataFrame, capacity: int, share: float = 0.8, least: int = 128 << 10, largest: int = 4 * MIB) -> DataFrame:
    """pending (sequence, bytes) with whether a commit is due after each record; large logs never commit by themselves."""
    total = F.sum("bytes").over(Window.partitionBy(F.lit(1)).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))  # one log has one order
    due = F.lit(capacity <= largest) & (total >= least) & (total >= int(share * capacity))
    return pending.withColumn("commit_due", due)


def verify_checksums(frames: DataFrame, payload: str = "payload", checksum: str = "checksum") -> DataFrame:
    """Frames whose payload does not have its stored SHA-256."""
    return frames.where(~F.sha2(F.col(payload), 256).eqNullSafe(F.col(checksum)))


def overlapping_ranges(ranges: DataFrame, key: str = "segment") -> DataFrame:
    """Byte ranges (key, start, end) that begin before an earlier one of their key ends."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_before", F.max("end").over(w)).where(F.col("start") < F.col("_before")).drop("_before")


def duplicate_content(frames: DataFrame) -> DataFrame:
    """content_hash, copies, first frame of texts that occur more than once."""
    return frames.groupBy(F.sha2(F.coalesce("search_text", F.lit("")), 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("frame_id").alias("first_frame")).where("copies > 1")

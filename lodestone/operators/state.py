"""Log replay: frames and their state from ordered mutations, validation of supersede links, access statistics."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replay(frames: DataFrame, mutations: DataFrame, after_sequence: int = 0) -> DataFrame:
    """frames (frame_id, status, superseded_by) after mutations (sequence, op, frame_id, other_id) beyond a committed sequence.

    op put adds a frame, delete marks it, supersede links frame_id (old) to other_id (new); the last of each kind holds.
    """
    log = mutations.where(F.col("sequence") > after_sequence)
    puts = log.where("op = 'put'").select("frame_id").distinct().join(frames.select("frame_id"), "frame_id", "left_anti")
    base = frames.select("frame_id", "status", "superseded_by").unionByName(puts.select("frame_id", F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by")))
    change = log.where("op <> 'put'").groupBy("frame_id").agg(
        F.max(F.when(F.col("op") == "delete", F.col("sequence"))).alias("_del"), F.max_by("other_id", F.when(F.col("op") == "supersede", F.col("sequence"))).alias("_by")
    )
    out = base.join(change, "frame_id", "left")
    return out.select("frame_id", F.when(F.col("_del").isNotNull(), "deleted").otherwise(F.col("status")).alias("status"), F.coalesce("_by", "superseded_by").alias("superseded_by"))


def supersede_errors(frames: DataFrame, links: DataFrame) -> DataFrame:
    """sequence, problem of supersede links (sequence, frame_id, other_id) that must be refused: self, unknown, reversed, second."""
    ids = frames.select("frame_id")
    known = links.join(ids.withColumn("_a", F.lit(True)), "frame_id", "left").join(ids.select(F.col("frame_id").alias("other_id"), F.lit(True).alias("_b")), "other_id", "left")
    back = links.select(F.col("other_id").alias("frame_id"), F.col("frame_id").alias("other_id"), F.col("sequence").alias("_back"))
    turned = known.join(back.groupBy("frame_id", "other_id").agg(F.min("_back").alias("_back")), ["frame_id", "other_id"], "left")
    first = F.when(F.col("frame_id") == F.col("other_id"), "self").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_back") < F.col("sequence"), "reversed")
    checked = turned.withColumn("_first", first)
    order = Window.partitionBy("frame_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    checked = checked.withColumn("_n", F.count_if(F.col("_first").isNull()).over(order))  # refused links do not count as superseders
    problem = F.coalesce("_first", F.when(F.col("_n") > 1, "second"))
    return checked.withColumn("problem", problem).where("problem is not null").select("sequence", "problem")


def pending_since(mutations: DataFrame, sequence: int, op: str = "embed") -> DataFrame:
    """What an index that has applied a sequence still misses: the last op of each frame."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("sequence"))
    return mutations.where((F.col("sequence") > sequence) & (F.col("op") == op)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def access_stats(log: DataFrame) -> DataFrame:
    """frame_id, accesses, first_ms, last_ms."""
    return log.groupBy("frame_id").agg(F.count("*").alias("accesses"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


def merge_access_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Statistics of two logs together, from their statistics."""
    return old.unionByName(new).groupBy("frame_id").agg(F.sum("accesses").alias("accesses"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read from there; a temporary one only in local mode without that setting."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
            folder = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, folder, True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def dense_ids(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """rows with frame_id, consecutive from start in the given order, without one task for all rows.

    Rows are counted per range partition and partition offsets are added; numbered rows are written to the checkpoint folder first, so the split is the same for both.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    placed = cut(placed.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return placed.join(F.broadcast(before.select("_part", "_base")), "_part").withColumn("frame_id", F.lit(start) + F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")

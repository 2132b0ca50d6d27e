"""Incremental forms of what the engine keeps up to date: access statistics, log replay, indexes by digest.

Each takes a streaming DataFrame and returns a query or a streaming DataFrame; the batch operators of the same name define the
result. State and offsets live in the checkpoint location that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state


def access_stats(events: DataFrame) -> DataFrame:
    """Running count, first and last access per frame; write in update mode."""
    return state.access_stats(events)


def windowed_activity(events: DataFrame, time: str = "ts", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accesses per frame and time window with a watermark; an addition of this engine."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("window"), "frame_id").agg(F.count("*").alias("accesses"))


def replay_to(mutations: DataFrame, path: str, checkpoint: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Applies each micro-batch of mutations to a snapshot: read() gives the current frames, write(frames, batch) stores the next ones.

    write must replace the snapshot of a batch it has seen (a batch may come twice after a failure).
    """

    def apply(batch: DataFrame, number: int) -> None:
        write(state.replay(read(), batch), number)

    return mutations.writeStream.option("checkpointLocation", checkpoint).option("path", path).foreachBatch(apply).start()


def changed_only(files: DataFrame, known: DataFrame) -> DataFrame:
    """Of a stream of files (path, size, hash), those that known does not hold unchanged."""
    return files.join(known.select("path", "size", "hash"), ["path", "size", "hash"], "left_anti")


def append_postings(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends postings (term, frame_id, tf) of arriving frames; frames are append-only, so postings are too."""
    from ..functions import text as tx

    def apply(batch: DataFrame, number: int) -> None:
        terms = batch.select("frame_id", F.explode(tx.tokens(F.col("search_text"))).alias("term")).groupBy("term", "frame_id").agg(F.count("*").alias("tf"))
        terms.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return frames.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).start()

"""Sessions and handoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .state import dense_ids


def tag_session(frames: DataFrame, session_id: str) -> DataFrame:
    """frames stamped with a session, where their metadata has none."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    own = F.map_concat(F.map_filter(meta, lambda k, v: k != "session_id"), F.create_map(F.lit("session_id"), F.coalesce(F.try_element_at(meta, F.lit("session_id")), F.lit(session_id))))
    return frames.withColumn("metadata", own)


def session_stats(frames: DataFrame) -> DataFrame:
    """session_id, frames, tokens, first_ms, last_ms."""
    session = F.try_element_at("metadata", F.lit("session_id"))
    got = frames.select(session.alias("session_id"), "timestamp_ms", token_estimate(F.coalesce("search_text", F.lit(""))).alias("tokens")).where("session_id is not null")
    return got.groupBy("session_id").agg(F.count("*").alias("frames"), F.sum("tokens").alias("tokens"), F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_ms"))


def handoff_text(content: str, tasks: list[str]) -> str:
    """A handoff note with its open tasks."""
    return content + ("\n\nPending tasks:\n" + "\n".join(f"- {t}" for t in tasks) if tasks else "")


def write_handoffs(notes: DataFrame, frames: DataFrame) -> DataFrame:
    """frames with a handoff frame for each of notes (content, tasks, project, at_ms), numbered on after the largest id."""
    tasks = F.when(F.size("tasks") > 0, F.concat(F.lit("\n\nPending tasks:\n- "), F.array_join("tasks", "\n- "))).otherwise("")
    last = frames.agg(F.coalesce(F.max("frame_id"), F.lit(-1)).alias("_last"))  # one row
    new = dense_ids(notes.select("at_ms", "project", F.concat("content", tasks).alias("search_text")), ["at_ms", "project", "search_text"], 1).crossJoin(F.broadcast(last))
    meta = F.map_filter(F.create_map(F.lit("label"), F.lit("handoff"), F.lit("project"), F.col("project")), lambda k, v: v.isNotNull())
    new = new.select((F.col("_last") + F.col("frame_id")).alias("frame_id"), F.col("at_ms").alias("timestamp_ms"), F.lit("handoff").alias("kind"), meta.alias("metadata"), "search_text")
    return frames.select(*new.columns).unionByName(new)


def newest_handoff(frames: DataFrame, project: str | None = None) -> DataFrame:
    """The newest handoff frame (kind or label handoff), of a project if one is named: one row at most."""
    is_note = (F.col("kind") == "handoff") | (F.try_element_at("metadata", F.lit("label")) == "handoff")
    own = F.lit(True) if project is None else F.try_element_at("metadata", F.lit("project")) == project
    newest = frames.where(F.coalesce(is_note, F.lit(False)) & F.coalesce(own, F.lit(False))).agg(F.max_by(F.struct("frame_id", "timestamp_ms", "search_text"), F.struct("timestamp_ms", "frame_id")).alias("h"))
    return newest.where("h is not null").select("h.*")


def latest_handoff(frames: DataFrame, by: str = "session_id") -> DataFrame:
    """The newest frame (time, then id) of each value of a metadata key."""
    keyed = frames.withColumn(by, F.try_element_at("metadata", F.lit(by))).where(F.col(by).isNotNull())
    return keyed.groupBy(by).agg(F.max_by(F.struct("frame_id", "timestamp_ms", "search_text"), F.struct("timestamp_ms", "frame_id")).alias("h")).select(by, "h.*")

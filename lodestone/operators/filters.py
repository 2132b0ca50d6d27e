"""Predicates over frames, timeline scans, lookups and bins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_time(column: Column, after_ms: int | None = None, before_ms: int | None = None) -> Column:
    """after <= t < before; either end may be open."""
    out = F.lit(True)
    if after_ms is not None:
        out = out & (column >= after_ms)
    if before_ms is not None:
        out = out & (column < before_ms)
    return out


def live() -> Column:
    return (F.col("status") == "active") & F.col("superseded_by").isNull()


def metadata_matches(entries: dict[str, str]) -> Column:
    """All entries hold; frames without metadata fail."""
    out = F.lit(True)
    for key, value in sorted(entries.items()):
        out = out & F.coalesce(F.try_element_at("metadata", F.lit(key)) == value, F.lit(False))
    return out


def tags_match(tags: list[tuple[str, str]]) -> Column:
    """Every (key, value) is among the frame's tags."""
    out = F.lit(True)
    for key, value in tags:
        out = out & F.coalesce(F.array_contains("tags", F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))), F.lit(False))
    return out


def labels_match(labels: list[str]) -> Column:
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, labels)), F.col("labels"))) == 0, F.lit(False)) if labels else F.lit(True)


@dataclass(frozen=True)
class FrameFilter:
    """What a hit must satisfy. frame_ids is a DataFrame of ids, joined, so an allow-list may have any size."""

    after_ms: int | None = None
    before_ms: int | None = None
    include_deleted: bool = False
    include_superseded: bool = False
    include_surrogates: bool = False
    min_score: float | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    tags: list[tuple[str, str]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    frame_ids: DataFrame | None = None

    def condition(self) -> Column:
        out = in_time(F.col("timestamp_ms"), self.after_ms, self.before_ms)
        if not self.include_deleted:
            out = out & (F.col("status") == "active")
        if not self.include_superseded:
            out = out & F.col("superseded_by").isNull()
        if not self.include_surrogates:
            out = out & (F.coalesce(F.col("kind"), F.lit("")) != "surrogate")
        return out & metadata_matches(self.metadata) & tags_match(self.tags) & labels_match(self.labels)

    def frames(self, frames: DataFrame) -> DataFrame:
        """The frames that pass, all but the score rule."""
        out = frames.where(self.condition())
        return out if self.frame_ids is None else out.join(self.frame_ids.select("frame_id"), "frame_id", "left_semi")


def timeline(frames: DataFrame, limit: int, newest_first: bool = True, after_ms: int | None = None, before_ms: int | None = None, include_deleted: bool = False, include_superseded: bool = False) -> DataFrame:
    """Frames in time order, ties by id."""
    keep = FrameFilter(after_ms, before_ms, include_deleted, include_superseded, include_surrogates=True)
    at = F.col("timestamp_ms")
    return keep.frames(frames).orderBy(at.desc() if newest_first else at.asc(), "frame_id").limit(limit)


def lookup(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """Frames with the given ids; Spark broadcasts ids if they are few."""
    return frames.join(ids.select("frame_id").distinct(), "frame_id", "left_semi")


def eligible_for_surrogate() -> Column:
    return live() & (F.col("role") == "chunk") & (F.coalesce(F.col("kind"), F.lit("")) != "surrogate") & (F.trim(F.coalesce(F.col("search_text"), F.lit(""))) != "")


def geo_bin(degrees: Column) -> Column:
    """Hundredths of a degree."""
    return F.floor(degrees * 100).cast("long")


def near_place(points: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Points (lat, lon) in the bins of the radius's bounding box; the box wraps at 180 degrees. No radius, no filter."""
    if radius_m <= 0:
        return points
    import math

    dlat = radius_m / 111_320.0
    dlon = radius_m / (111_320.0 * max(0.01, math.cos(math.radians(lat))))
    low, high = math.floor((lat - dlat) * 100), math.floor((lat + dlat) * 100)
    west, east = lon - dlon, lon + dlon
    inside = geo_bin(F.col("lat")).between(low, high)
    bins = geo_bin(F.col("lon"))
    if dlon >= 180:
        return points.where(inside)
    if west < -180 or east > 180:
        start, end = math.floor(((west + 540) % 360 - 180) * 100), math.floor(((east + 540) % 360 - 180) * 100)
        return points.where(inside & ((bins >= start) | (bins <= end)))
    return points.where(inside & bins.between(math.floor(west * 100), math.floor(east * 100)))

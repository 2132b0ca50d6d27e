"""Photo and video memory over metadata tables: segments, transcripts, roots, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_search import top


def segments(videos: DataFrame, length_ms: int, overlap_ms: int, max_segments: int | None = None) -> DataFrame:
    """video_id, index, start_ms, end_ms: windows of length_ms every length_ms - overlap_ms, the last clamped to the duration."""
    stride = max(1, length_ms - overlap_ms)
    last = F.ceil(F.col("duration_ms") / F.lit(float(stride))).cast("long") - 1
    if max_segments is not None:
        last = F.least(last, F.lit(max_segments - 1))
    cut = videos.where("duration_ms > 0").select("video_id", "duration_ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("index"))
    return cut.select("video_id", "index", (F.col("index") * stride).alias("start_ms"), F.least(F.col("index") * stride + length_ms, F.col("duration_ms")).alias("end_ms"))


def transcript_of(segs: DataFrame, chunks: DataFrame, least_ms: int = 250, max_bytes: int = 4096, bucket_ms: int = 60_000) -> DataFrame:
    """segs with transcript: texts of chunks (video_id, start_ms, end_ms, text) that overlap by least_ms, in order, capped in bytes.

    Both sides are dealt into time buckets, so a long video is not one join key.
    """
    slots = lambda: F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.greatest("start_ms", F.col("end_ms") - 1) / bucket_ms)))
    a = segs.select("video_id", "index", "start_ms", "end_ms", slots().alias("_b"))
    b = chunks.select("video_id", "start_ms", "end_ms", slots().alias("_b"), F.col("text").alias("_t")).select("video_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "_b", "_t")
    shared = F.least("end_ms", "_e") - F.greatest("start_ms", "_s")
    pairs = a.join(b, ["video_id", "_b"]).where(shared >= least_ms).select("video_id", "index", "_s", "_e", "_t").distinct()
    text = pairs.groupBy("video_id", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s", "_e", "_t"))), lambda x: x["_t"]), " ").alias("t"))
    return segs.join(text, ["video_id", "index"], "left").withColumn("transcript", utf8_cap(F.coalesce("t", F.lit("")), max_bytes)).drop("t")


def utf8_cap(text: Column, limit: int) -> Column:
    """At most limit bytes, no split character."""
    cut = lambda n: F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(cut(limit), cut(limit - 1), cut(limit - 2), cut(limit - 3), F.lit("")))


def roots_of(hits: DataFrame, frames: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """query_id, root_id, score, frames: hits on derived frames counted for their live root; the best score holds."""
    up = hits.join(frames.select("frame_id", F.coalesce("parent_id", "frame_id").alias("root_id")), "frame_id")
    good = frames.where("status = 'active' and superseded_by is null")
    if kinds:
        good = good.where(F.col("kind").isin(kinds))
    up = up.join(good.select(F.col("frame_id").alias("root_id")), "root_id", "left_semi")
    return up.groupBy("query_id", "root_id").agg(F.max("score").alias("score"), F.count("*").alias("frames"))


def top_roots(roots: DataFrame, k: int, epsilon: float | None = None) -> DataFrame:
    """The first k roots; with epsilon, scores in one step of that width tie and the smaller id comes first."""
    value = F.col("score") if epsilon is None else F.floor(F.col("score") / epsilon)
    return top(roots, k, [value.desc(), F.asc("root_id")])


def best_segments(hits: DataFrame, n: int) -> DataFrame:
    """query_id, root_id, index, score, position: the best hit of each segment, n per root."""
    best = hits.groupBy("query_id", "root_id", "index").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "root_id").orderBy(F.desc("score"), "index")
    return best.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def derived(frames: DataFrame) -> DataFrame:
    """root_id, caption, summary, tags (each the last by id), regions: what was derived from a photo."""
    last = lambda kind: F.max_by("search_text", F.when(F.col("kind") == kind, F.col("frame_id")))
    got = frames.where("parent_id is not null and status = 'active'").groupBy(F.col("parent_id").alias("root_id"))
    return got.agg(last("photo.caption").alias("caption"), last("photo.ocr.summary").alias("summary"), last("photo.tags").alias("tags"), F.array_sort(F.collect_list(F.when(F.col("kind") == "photo.region", F.struct("frame_id", "search_text")))).alias("regions"))


def ocr_summary(blocks: DataFrame, limit: int = 12) -> DataFrame:
    """photo_id, text: distinct lines of blocks (photo_id, position, text, confidence) in order, limit at most."""
    clean = blocks.withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " "))).where("t <> ''")
    first = clean.groupBy("photo_id", F.lower("t").alias("_k")).agg(F.min(F.struct("position", "t")).alias("m"))
    packed = first.groupBy("photo_id").agg(F.array_sort(F.collect_list("m")).alias("l"))
    return packed.select("photo_id", F.array_join(F.transform(F.slice("l", 1, limit), lambda x: x["t"]), "\n").alias("text"))


def photo_summary(caption: Column, ocr: Column, tags: Column, taken: Column) -> Column:
    """Labelled parts that are there, or a fallback."""
    part = lambda name, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    text = F.concat_ws("\n", part("Caption", caption), part("Text", ocr), part("Tags", tags), part("Taken", taken))
    return F.when(text == "", "Photo").otherwise(text)


def closed_to_half_open(end_ms: Column) -> Column:
    return end_ms + 1

"""Retrieval and latency metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def retrieval(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: recall at k and mean reciprocal rank over all queries of expected (query_id, frame_id)."""
    good = hits.where(F.col("rank") <= k).join(expected, ["query_id", "frame_id"])
    first = good.groupBy("query_id").agg(F.min("rank").alias("rank"), F.countDistinct("frame_id").alias("found"))
    asked = expected.groupBy("query_id").agg(F.countDistinct("frame_id").alias("wanted"))
    per = asked.join(first, "query_id", "left").select(F.coalesce(F.col("found"), F.lit(0)).alias("found"), "wanted", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("rr"))
    return per.agg(F.round(F.avg(F.col("found") / F.col("wanted")), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("queries"))


def mean_judgement(scores: DataFrame, value: str = "score") -> DataFrame:
    """One row: the mean of a judge's scores and how many there are."""
    return scores.agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n"))


def token_f1(pairs: DataFrame, key: str = "id") -> DataFrame:
    """key, precision, recall, f1 of the token multisets of answer and expected."""
    bag = lambda c: pairs.select(key, F.explode(tx.tokens(F.col(c))).alias("t")).groupBy(key, "t").agg(F.count("*").alias(c))
    both = bag("answer").join(bag("expected"), [key, "t"], "full_outer").groupBy(key).agg(
        F.sum(F.least(F.coalesce("answer", F.lit(0)), F.coalesce("expected", F.lit(0)))).alias("common"), F.sum(F.coalesce("answer", F.lit(0))).alias("a"), F.sum(F.coalesce("expected", F.lit(0))).alias("e")
    )
    p, r = F.coalesce(F.try_divide("common", "a"), F.lit(0.0)), F.coalesce(F.try_divide("common", "e"), F.lit(0.0))
    scored = both.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))
    return pairs.select(key).join(scored, key, "left").fillna(0.0)


def latency(samples: DataFrame, value: str, key: str) -> DataFrame:
    """key, n, mean, p50, p95, p99 (interpolated)."""
    q = lambda p, name: F.round(F.percentile(value, p), 6).alias(name)
    return samples.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(0.5, "p50"), q(0.95, "p95"), q(0.99, "p99"))


def changed_files(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """diffs with changed_files: lines that open a file's diff."""
    return diffs.withColumn("changed_files", F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.startswith("diff --git "))))

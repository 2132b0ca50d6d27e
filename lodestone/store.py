"""Engine tables and how the test tables map onto them.

A store is a set of DataFrames: nothing is opened, locked or cached here. Frames are append-only records with a dense id;
chunks, surrogates and handoffs are frames too. All operators take DataFrames and return DataFrames, and work on a batch of
queries (query_id) where a single-query engine would be called once per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Milliseconds of the first test frame (2024-01-01T00:00:00Z) and between frames.
BASE_MS, STEP_MS = 1704067200000, 3600000
#: "Latest" in as-of queries: ends of open ranges are compared as this value.
MAX_MS = 9223372036854775807

FRAMES = T.StructType(
    [
        T.StructField("frame_id", T.LongType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("superseded_by", T.LongType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("search_text", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("labels", T.ArrayType(T.StringType())),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as frames; every 17th is deleted, every 13th superseded by its successor (rules of the test mapping)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    marks = labels.select(F.col("doc_id").alias("_doc"), F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("labels"))
    i = F.col("doc_id")
    return docs.join(marks, i == F.col("_doc"), "left").select(
        i.alias("frame_id"),
        (F.lit(BASE_MS) + i * STEP_MS).alias("timestamp_ms"),
        F.col("source").alias("kind"),
        F.lit("document").alias("role"),
        F.when(i % 17 == 16, "deleted").otherwise("active").alias("status"),
        F.when(i % 13 == 12, i + 1).alias("superseded_by"),
        F.lit(None).cast("long").alias("parent_id"),
        F.lit(None).cast("long").alias("chunk_index"),
        F.lit(None).cast("long").alias("chunk_count"),
        F.col("text").alias("search_text"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
        F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value")), F.struct(F.lit("size").alias("key"), F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("value"))).alias("tags"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("vector"), "label")


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, at_ms: events as accesses of the frame with the user's number."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("frame_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_id")


def session_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chunk frames tagged with their session."""
    t = table(spark, sf_dir, "conversations")
    ms = F.lit(BASE_MS) + F.col("conv_id") * STEP_MS + F.col("turn") * 1000
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), ms.alias("timestamp_ms"), F.col("role").alias("kind"), F.create_map(F.lit("session_id"), F.col("conv_id").cast("string")).alias("metadata"), F.col("turn").alias("chunk_index"), F.col("text").alias("search_text"))


@dataclass(frozen=True)
class Facts:
    """The tables of structured memory."""

    entity: DataFrame
    alias: DataFrame
    predicate: DataFrame
    fact: DataFrame
    span: DataFrame
    evidence: DataFrame


#: Object kinds of a fact: which of the object columns holds its value.
STRING, INT, REAL, BOOL, BLOB, TIME, ENTITY = 1, 2, 3, 4, 5, 6, 7
DAY_MS = 86400000


def facts(spark: SparkSession, sf_dir: str) -> Facts:
    """Customers and nations as entities; nation, order status and order day facts, valid from the order's date.

    An order's facts are valid until 60 days later if its status is F, open otherwise; they are known to the system one day after they
    became valid. Evidence points to documents by modulo.
    """
    customer, nation, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    entity = customer.select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("customer:"), "c_custkey").alias("key"), F.lit("customer").alias("kind"))
    entity = entity.unionByName(nation.select((F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("entity_id"), F.concat(F.lit("nation:"), "n_nationkey").alias("key"), F.lit("nation").alias("kind")))
    alias = customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("alias"), F.lower("c_name").alias("alias_norm"))
    alias = alias.unionByName(nation.select((F.lit(1000000000) + F.col("n_nationkey")).cast("long").alias("entity_id"), F.col("n_name").alias("alias"), F.lower("n_name").alias("alias_norm")))
    predicate = spark.createDataFrame([(1, "lives_in"), (2, "order.status"), (3, "order.day")], "predicate_id long, key string")
    none = lambda t: F.lit(None).cast(t)
    lives = customer.select(
        F.col("c_custkey").alias("fact_id"), F.col("c_custkey").alias("subject_id"), F.lit(1).cast("long").alias("predicate_id"), F.lit(ENTITY).alias("object_kind"),
        none("string").alias("object_text"), none("long").alias("object_int"), (F.lit(1000000000) + F.col("c_nationkey")).cast("long").alias("object_entity_id"),
    )
    status = orders.select(
        (F.lit(2000000000) + F.col("o_orderkey")).cast("long").alias("fact_id"), F.col("o_custkey").alias("subject_id"), F.lit(2).cast("long").alias("predicate_id"), F.lit(STRING).alias("object_kind"),
        F.col("o_orderstatus").alias("object_text"), none("long").alias("object_int"), none("long").alias("object_entity_id"),
    )
    day = F.floor(F.unix_millis(F.col("o_orderdate").cast("timestamp")) / DAY_MS).cast("long")
    days = orders.select(
        (F.lit(4000000000) + F.col("o_orderkey")).cast("long").alias("fact_id"), F.col("o_custkey").alias("subject_id"), F.lit(3).cast("long").alias("predicate_id"), F.lit(INT).alias("object_kind"),
        none("string").alias("object_text"), day.alias("object_int"), none("long").alias("object_entity_id"),
    )
    ends = F.when(F.col("o_orderstatus") == "F", (day + 60) * DAY_MS)
    span = customer.select(F.col("c_custkey").alias("fact_id"), F.lit(0).cast("long").alias("valid_from_ms"), none("long").alias("valid_to_ms"), F.lit(0).cast("long").alias("system_from_ms"), none("long").alias("system_to_ms"))
    for base in (2000000000, 4000000000):
        span = span.unionByName(orders.select((F.lit(base) + F.col("o_orderkey")).cast("long").alias("fact_id"), (day * DAY_MS).alias("valid_from_ms"), ends.alias("valid_to_ms"), ((day + 1) * DAY_MS).alias("system_from_ms"), none("long").alias("system_to_ms")))
    span = span.withColumn("span_id", F.col("fact_id"))
    evidence = orders.crossJoin(F.broadcast(docs)).select(  # one row: the number of documents
        (F.lit(2000000000) + F.col("o_orderkey")).cast("long").alias("fact_id"), none("long").alias("span_id"), (F.col("o_orderkey") % F.greatest("n_docs", F.lit(1))).alias("source_frame_id"),
        F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("confidence"), (day * DAY_MS).alias("asserted_at_ms"),
    )
    return Facts(entity, alias, predicate, lives.unionByName(status).unionByName(days), span, evidence)

"""Structured memory: entities, aliases, bitemporal facts, evidence, and the simpler latest-value store.

Ranges are half-open, an open end is null and compares as later than everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import alias_norm
from ..store import ENTITY, MAX_MS, Facts
from .state import dense_ids


def holds_at(start: str, end: str, at: Column) -> Column:
    return (F.col(start) <= at) & (F.coalesce(F.col(end), F.lit(MAX_MS)) > at)


def facts_as_of(store: Facts, valid_ms: Column | int, system_ms: Column | int, subjects: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Facts that held at valid_ms as known at system_ms, with keys of subject, predicate and object.

    asked (as_of_id, valid_ms, system_ms, key): many times at once; each meets the spans of its own subject, an equi-join
    with range conditions.
    """
    subject = store.entity.select(F.col("entity_id").alias("subject_id"), F.col("key").alias("subject"))
    if subjects is not None:
        subject = subject.join(subjects.select(F.col("key").alias("subject")).distinct(), "subject", "left_semi")
    if asked is not None:
        subject = subject.join(asked.select("as_of_id", F.col("key").alias("subject"), F.col("valid_ms").alias("_valid"), F.col("system_ms").alias("_system")), "subject")
        valid, system = F.col("_valid"), F.col("_system")
    else:
        valid, system = (x if isinstance(x, Column) else F.lit(x) for x in (valid_ms, system_ms))
    target = store.entity.select(F.col("entity_id").alias("object_entity_id"), F.col("key").alias("object_key"))
    predicate = store.predicate.select("predicate_id", F.col("key").alias("predicate"))
    got = store.fact.join(subject, "subject_id").join(store.span, "fact_id").where(holds_at("valid_from_ms", "valid_to_ms", valid) & holds_at("system_from_ms", "system_to_ms", system))
    return got.join(predicate, "predicate_id").join(target, "object_entity_id", "left").drop("_valid", "_system")


def object_text(kind: str = "object_kind") -> Column:
    """The object as text, whatever its kind: what facts are ordered by."""
    return F.coalesce(F.col("object_key"), F.col("object_text"), F.col("object_int").cast("string"))


def ordered(facts: DataFrame, limit: int) -> DataFrame:
    """facts, limit at most per subject, with position and truncated (also true if there are exactly limit)."""
    order = [F.asc("predicate"), F.asc("object_kind"), object_text().asc(), F.desc("valid_from_ms"), F.asc("fact_id")]
    window = Window.partitionBy("subject")
    out = facts.withColumn("position", F.row_number().over(window.orderBy(*order))).withColumn("truncated", F.count("*").over(window) >= limit)
    return out.where(F.col("position") <= limit)


def resolve_alias(store: Facts, names: DataFrame) -> DataFrame:
    """names (alias) with the keys of entities that have it, folded on both sides."""
    asked = names.select("alias", alias_norm("alias").alias("_n"))
    known = store.alias.select("entity_id", alias_norm("alias").alias("_n")).distinct()
    return asked.join(known, "_n").join(store.entity.select("entity_id", "key", "kind"), "entity_id").select("alias", "key", "kind")


def entity_candidates(store: Facts, queries: DataFrame, limit: int = 16) -> DataFrame:
    """query_id, key, rank, position: whole-alias matches before token matches, longer aliases first, limit per query."""
    whole = queries.select("query_id", F.lower(F.trim("query")).alias("alias_norm"), F.lit(0).alias("match"))
    token = queries.select("query_id", F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[\s\p{Punct}]+"), lambda t: t != ""))).alias("alias_norm"), F.lit(1).alias("match"))
    joined = whole.unionByName(token).join(store.alias.select("entity_id", "alias_norm"), "alias_norm").join(store.entity.select("entity_id", "key"), "entity_id")
    best = joined.groupBy("query_id", "key").agg(F.min(F.struct("match", (-F.length("alias_norm")).alias("neg"))).alias("m"))
    window = Window.partitionBy("query_id").orderBy("m.match", "m.neg", "key")
    return best.withColumn("position", F.row_number().over(window)).where(F.col("position") <= limit).select("query_id", "key", F.col("m.match").alias("match"), "position")


def evidence_frames(store: Facts, facts: DataFrame, limit: int, key: list[str] | None = None, need_span: bool = False) -> DataFrame:
    """source_frame_id, confidence, asserted_at_ms, n_facts, rank of the evidence of facts (fact_id and key columns)."""
    key = key or []
    spans = store.span.select("span_id", F.col("fact_id").alias("_span_fact"))
    joined = store.evidence.join(spans, "span_id", "left").withColumn("fact_id", F.coalesce("fact_id", "_span_fact"))
    if need_span:
        joined = joined.where(F.col("span_id").isNotNull())
    joined = joined.join(facts.select("fact_id", *key).distinct(), "fact_id")
    got = joined.groupBy(*key, "source_frame_id").agg(F.max(F.coalesce("confidence", F.lit(-1.0))).alias("confidence"), F.max("asserted_at_ms").alias("asserted_at_ms"), F.countDistinct("fact_id").alias("n_facts"))
    if not key:
        return got.orderBy(F.desc("confidence"), F.desc("asserted_at_ms"), F.desc("n_facts"), "source_frame_id").limit(limit)
    window = Window.partitionBy(*key).orderBy(F.desc("confidence"), F.desc("asserted_at_ms"), F.desc("n_facts"), "source_frame_id")
    return got.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def structured_lane(store: Facts, queries: DataFrame, as_of_ms: int, max_facts: int = 64, max_frames: int = 32) -> DataFrame:
    """query_id, frame_id, rank: evidence frames of facts about the entities that a query names."""
    named = entity_candidates(store, queries)
    subjects = named.select("key")
    facts = ordered(facts_as_of(store, as_of_ms, as_of_ms, subjects), max_facts)
    mine = facts.select("subject", "fact_id").join(named.select("query_id", F.col("key").alias("subject")), "subject").select("query_id", "fact_id")
    return evidence_frames(store, mine, max_frames, ["query_id"]).select("query_id", F.col("source_frame_id").alias("frame_id"), "rank")


def _numbered(rows: DataFrame, order: list[str], table: DataFrame, column: str) -> DataFrame:
    """rows with column, consecutive after the largest of table, without one task for all rows."""
    last = table.agg(F.coalesce(F.max(column), F.lit(0)).alias("_last"))  # one row
    return dense_ids(rows, order, 1).crossJoin(F.broadcast(last)).withColumn(column, F.col("_last") + F.col("frame_id")).drop("frame_id", "_last")


def upsert_entities(entity: DataFrame, fresh: DataFrame) -> DataFrame:
    """entity with new keys of fresh (key, kind) added after the largest id; an empty stored kind is filled in."""
    new = fresh.groupBy("key").agg(F.max("kind").alias("new_kind"))
    kept = entity.join(new, "key", "left").withColumn("kind", F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.col("new_kind"), F.lit(""))).select("entity_id", "key", "kind")
    added = _numbered(new.join(entity.select("key"), "key", "left_anti"), ["key"], entity, "entity_id")
    return kept.unionByName(added.select("entity_id", "key", F.coalesce("new_kind", F.lit("")).alias("kind")))


def upsert_aliases(alias: DataFrame, entity: DataFrame, fresh: DataFrame) -> DataFrame:
    """alias with those of fresh (key, alias) whose entity has no alias of the same folded form yet; the first spelling stays."""
    named = fresh.join(entity.select("entity_id", "key"), "key").select("entity_id", "alias", alias_norm("alias").alias("alias_norm"))
    new = named.groupBy("entity_id", "alias_norm").agg(F.min("alias").alias("alias")).join(alias.select("entity_id", "alias_norm"), ["entity_id", "alias_norm"], "left_anti")
    return alias.select("entity_id", "alias", "alias_norm").unionByName(new.select("entity_id", "alias", "alias_norm"))


def span_hash(fact: Column, valid_from: Column, valid_to: Column, system_from: Column) -> Column:
    """What makes a span the same: its fact, valid range (-1 for an open end) and start in the system, as SHA-256 of decimal numbers."""
    return F.sha2(F.concat_ws("|", *[x.cast("string") for x in (fact, valid_from, F.coalesce(valid_to, F.lit(-1)), system_from)]), 256)


def bad_ranges(fresh: DataFrame) -> DataFrame:
    """Rows whose valid range is empty or backward: they are refused."""
    return fresh.where(F.col("valid_to_ms") <= F.col("valid_from_ms"))


def assert_facts(store: Facts, fresh: DataFrame) -> Facts:
    """The store after fresh facts (subject, predicate, object_kind, object_text, valid_from_ms, valid_to_ms, system_from_ms, source_frame_id, confidence).

    Missing subjects and predicates are created, facts that are there already (same subject, predicate, kind and value) and spans of
    the same key are not repeated, evidence is appended each time. Rows of bad_ranges go.
    """
    ok = fresh.where(F.col("valid_to_ms").isNull() | (F.col("valid_to_ms") > F.col("valid_from_ms")))
    entity = upsert_entities(store.entity, ok.select(F.col("subject").alias("key"), F.lit("").alias("kind")))
    names = ok.select(F.col("predicate").alias("key")).distinct().join(store.predicate.select("key"), "key", "left_anti")
    predicate = store.predicate.unionByName(_numbered(names, ["key"], store.predicate, "predicate_id").select("predicate_id", "key"))
    keyed = ok.join(entity.select(F.col("entity_id").alias("subject_id"), F.col("key").alias("subject")), "subject").join(predicate.select("predicate_id", F.col("key").alias("predicate")), "predicate")
    same = ["subject_id", "predicate_id", "object_kind", "object_text"]
    new = keyed.select(*same).distinct().join(store.fact.select(*same), same, "left_anti")
    columns = store.fact.columns
    added = _numbered(new, same, store.fact, "fact_id")
    fact = store.fact.unionByName(added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(store.fact.schema[c].dataType).alias(c) for c in columns]))
    told = keyed.join(fact.select("fact_id", *same), same)
    key = ["fact_id", "valid_from_ms", "system_from_ms", F.coalesce("valid_to_ms", F.lit(-1)).alias("_to")]
    spans = told.select(*key, "valid_to_ms").distinct().join(store.span.select(*key), ["fact_id", "valid_from_ms", "system_from_ms", "_to"], "left_anti")
    spans = _numbered(spans, ["fact_id", "valid_from_ms", "system_from_ms", "_to"], store.span, "span_id").withColumn("system_to_ms", F.lit(None).cast("long"))
    proof = told.where(F.col("source_frame_id").isNotNull()).select("fact_id", F.lit(None).cast("long").alias("span_id"), "source_frame_id", "confidence", F.col("system_from_ms").alias("asserted_at_ms"))
    return Facts(entity, store.alias, predicate, fact, store.span.unionByName(spans.select(*store.span.columns)), store.evidence.unionByName(proof))


def retract(span: DataFrame, retractions: DataFrame) -> DataFrame:
    """span with the open system ranges of retracted facts (fact_id, at_ms) closed; a second time changes nothing, nor do rows of retract_errors."""
    first = retractions.groupBy("fact_id").agg(F.min("at_ms").alias("_at"))
    joined = span.join(first, "fact_id", "left")
    close = F.col("system_to_ms").isNull() & (F.col("_at") > F.col("system_from_ms"))
    return joined.withColumn("system_to_ms", F.when(close, F.col("_at")).otherwise(F.col("system_to_ms"))).select(*span.columns)


def retract_errors(span: DataFrame, retractions: DataFrame) -> DataFrame:
    """fact_id, at_ms of retractions that come no later than the start of an open span: callers raise on them."""
    open_ = span.where(F.col("system_to_ms").isNull()).groupBy("fact_id").agg(F.max("system_from_ms").alias("_from"))
    return retractions.join(open_, "fact_id").where(F.col("at_ms") <= F.col("_from")).select("fact_id", "at_ms")


def distinct_facts(facts: DataFrame, limit: int) -> DataFrame:
    """Each fact once, the first by id."""
    return facts.dropDuplicates(["fact_id"]).orderBy("fact_id").limit(limit)


def latest_values(log: DataFrame) -> DataFrame:
    """entity, attribute, value, version of a log (sequence, entity, attribute, op, value): upserts count versions, a removal starts anew."""
    w = Window.partitionBy("entity", "attribute").orderBy("sequence")
    epochs = log.withColumn("epoch", F.sum(F.when(F.col("op") == "forget", 1).otherwise(0)).over(w))
    last = epochs.groupBy("entity", "attribute").agg(F.max("epoch").alias("epoch"))
    live = epochs.join(last, ["entity", "attribute", "epoch"]).where("op = 'remember'")
    return live.groupBy("entity", "attribute").agg(F.max_by("value", "sequence").alias("value"), F.count("*").alias("version"))


def by_prefix(values: DataFrame, prefix: str, limit: int = -1) -> DataFrame:
    out = values.where(F.col("entity").startswith(prefix)).orderBy("entity", "attribute")
    return out if limit < 0 else out.limit(limit)


def edges(store: Facts) -> DataFrame:
    """src, predicate, dst: facts whose object is an entity."""
    e = store.entity
    src, dst = e.select(F.col("entity_id").alias("subject_id"), F.col("key").alias("src")), e.select(F.col("entity_id").alias("object_entity_id"), F.col("key").alias("dst"))
    return store.fact.where(F.col("object_kind") == ENTITY).join(src, "subject_id").join(dst, "object_entity_id").join(store.predicate.select("predicate_id", F.col("key").alias("predicate")), "predicate_id").select("src", "predicate", "dst")


def walk(links: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """key, hops: entities within some hops of start (key), along edges in either direction."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("key").distinct().withColumn("hops", F.lit(0))
    for n in range(1, hops + 1):
        step = seen.where(F.col("hops") == n - 1).join(both, F.col("key") == F.col("src")).select(F.col("dst").alias("key")).distinct()
        seen = seen.unionByName(step.join(seen, "key", "left_anti").withColumn("hops", F.lit(n)))
    return seen



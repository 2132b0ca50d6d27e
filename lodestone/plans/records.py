"""Queries over facts, handoffs, contexts, citations and row functions, with the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text as tx
from ..operators import context, facts, fusion, metrics, sessions, text_search
from ..store import table
from .catalogue import _FACTS, _HQ, _INDEX, _STOPS, _W, _bench_queries, _index, _hybrid_queries, _terms_sql, _two_tier_sql, _BENCH, query

# ---- structured memory that is written to ----


def _told(spark: SparkSession, d: str) -> DataFrame:
    """New facts: suppliers and some customers trade under a name; every seventh range is backward."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("subject"), F.lit("trades_as").alias("predicate"), F.col("s_name").alias("object_text"), F.col("s_suppkey").alias("n"))
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.lit("order.status").alias("predicate"), F.col("o_orderstatus").alias("object_text"), F.col("o_orderkey").alias("n"))
    both = s.unionByName(o)
    return both.select(
        "subject", "predicate", F.lit(store.STRING).alias("object_kind"), "object_text", (F.col("n") % 10).cast("long").alias("valid_from_ms"),
        F.when(F.col("n") % 7 == 0, F.lit(0)).when(F.col("n") % 2 == 0, F.lit(1000)).cast("long").alias("valid_to_ms"), F.lit(5000).cast("long").alias("system_from_ms"), (F.col("n") % 50).cast("long").alias("source_frame_id"), F.lit(0.5).alias("confidence"),
    )  # fmt: skip


_TOLD = """
told0 AS (SELECT 'supplier:' || s_suppkey AS subject, 'trades_as' AS predicate, s_name AS v, s_suppkey AS n FROM supplier UNION ALL SELECT 'customer:' || o_custkey, 'order.status', o_orderstatus, o_orderkey FROM orders WHERE o_orderkey % 3 = 0),
told1 AS (SELECT subject, predicate, v, n % 10 AS vf, CASE WHEN n % 7 = 0 THEN 0 WHEN n % 2 = 0 THEN 1000 END AS vt, n % 50 AS source FROM told0),
told AS (SELECT * FROM told1 WHERE vt IS NULL OR vt > vf),
had AS (SELECT DISTINCT 'customer:' || o_custkey AS subject, 'order.status' AS predicate, o_orderstatus AS v FROM orders)"""


@query("fact_assert", f"""WITH {_TOLD}, new AS (SELECT DISTINCT subject, predicate, v FROM told EXCEPT SELECT * FROM had)
SELECT predicate, count(*) AS facts, count(DISTINCT subject) AS subjects FROM new GROUP BY predicate
UNION ALL SELECT 'entities', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(DISTINCT subject) FROM told WHERE subject LIKE 'supplier:%'), 0
UNION ALL SELECT 'evidence', (SELECT count(*) FROM orders) + (SELECT count(*) FROM told WHERE predicate = 'trades_as') + (SELECT count(*) FROM told JOIN (SELECT 'customer:' || o_custkey AS subject, o_orderstatus AS v, count(*) AS c FROM orders GROUP BY ALL) USING (subject, v)  WHERE predicate = 'order.status' AND c = 1), 0""")
def fact_assert(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what assert_facts adds. A status fact that several orders of a customer share is there several times in the base tables: only those of one order are told again."""
    base, told = store.facts(spark, d), _told(spark, d)
    once = table(spark, d, "orders").groupBy(F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.col("o_orderstatus").alias("object_text")).agg(F.count("*").alias("c"))
    kept = told.join(once.where("c > 1").drop("c"), ["subject", "object_text"], "left_anti").unionByName(told.where("predicate = 'trades_as'").limit(0))
    got = facts.assert_facts(base, kept.select(*told.columns))
    names = got.predicate.select("predicate_id", F.col("key").alias("predicate"))
    added = got.fact.join(base.fact.select("fact_id"), "fact_id", "left_anti").join(names, "predicate_id")
    out = added.groupBy("predicate").agg(F.count("*").alias("facts"), F.countDistinct("subject_id").alias("subjects"))
    count = lambda name, df: df.agg(F.lit(name).alias("predicate"), F.count("*").alias("facts"), F.lit(0).cast("long").alias("subjects"))  # noqa: E731
    return out.unionByName(count("entities", got.entity)).unionByName(count("evidence", got.evidence))


@query("span_hash", f"WITH {_FACTS} SELECT fact_id, sha256(fact_id || '|' || vf || '|' || coalesce(vt, -1) || '|' || sf) AS hash FROM fact")
def span_hash(spark: SparkSession, d: str) -> DataFrame:
    s = store.facts(spark, d).span
    return s.select("fact_id", facts.span_hash(F.col("fact_id"), F.col("valid_from_ms"), F.col("valid_to_ms"), F.col("system_from_ms")).alias("hash"))


@query("alias_upsert", """WITH have AS (SELECT c_custkey AS entity_id, lower(c_name) AS n FROM customer UNION ALL SELECT 1000000000 + n_nationkey, lower(n_name) FROM nation),
fresh AS (SELECT 1000000000 + n_nationkey AS entity_id, upper(n_name) AS a FROM nation UNION ALL SELECT 1000000000 + n_nationkey, 'Land of ' || n_name FROM nation)
SELECT entity_id, n AS alias_norm FROM have UNION SELECT entity_id, lower(a) FROM fresh""")
def alias_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Nations get their name in capitals, which they have, and another one, twice."""
    base = store.facts(spark, d)
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("key"), F.explode(F.array(F.upper("n_name"), F.concat(F.lit("Land of "), "n_name"), F.concat(F.lit("land of  "), "n_name"))).alias("alias"))
    return facts.upsert_aliases(base.alias, base.entity, n).select("entity_id", "alias_norm")


@query("retract_errors", f"WITH {_FACTS} SELECT fact_id, sf + (fact_id % 3) - 1 AS at_ms FROM fact WHERE fact_id % 3 <> 2")
def retract_errors(spark: SparkSession, d: str) -> DataFrame:
    """Retractions one millisecond before, at and after the start."""
    s = store.facts(spark, d).span
    return facts.retract_errors(s, s.select("fact_id", (F.col("system_from_ms") + F.col("fact_id") % 3 - 1).alias("at_ms")))


@query("facts_distinct", f"WITH {_FACTS} SELECT DISTINCT fact_id FROM fact ORDER BY fact_id LIMIT 50")
def facts_distinct(spark: SparkSession, d: str) -> DataFrame:
    f = store.facts(spark, d).fact
    return facts.distinct_facts(f.unionByName(f), 50).select("fact_id")


# ---- handoffs ----


@query("handoff_write", f"""WITH n AS (SELECT n_nationkey AS k, n_name, {store.BASE_MS} + n_nationkey * 7919 % 1000 AS at_ms, 'p' || n_nationkey % 4 AS project FROM nation)
SELECT project, at_ms AS timestamp_ms, 'Stopped at ' || n_name || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || 'Pending tasks:' || chr(10) || '- read' || chr(10) || '- write' ELSE '' END AS search_text FROM n QUALIFY row_number() OVER (PARTITION BY project ORDER BY at_ms DESC, k) = 1""")
def handoff_write(spark: SparkSession, d: str) -> DataFrame:
    """A note per nation; the newest of each project."""
    k = F.col("n_nationkey")
    notes = table(spark, d, "nation").select(F.concat(F.lit("Stopped at "), "n_name").alias("content"), F.when(k % 2 == 0, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array().cast("array<string>")).alias("tasks"), F.concat(F.lit("p"), (k % 4).cast("string")).alias("project"), (F.lit(store.BASE_MS) + k * 7919 % 1000).cast("long").alias("at_ms"))
    frames = sessions.write_handoffs(notes, store.session_frames(spark, d))
    out = [sessions.newest_handoff(frames, f"p{i}").select(F.lit(f"p{i}").alias("project"), "timestamp_ms", "search_text") for i in range(4)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# ---- contexts ----

_HITS = f"WITH {_BENCH}, {_INDEX}, {_terms_sql('bq')}, {_two_tier_sql(10)}"


def _bench_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = text_search.search(_index(spark, d), _bench_queries(spark, d), 10)
    frames = store.frames(spark, d).select("frame_id", F.substring("search_text", 1, 200).alias("preview"))
    return hits.join(frames, "frame_id")


@query("plain_context", rf"""{_HITS}, shown AS (SELECT query_id, frame_id, rank, substring(d.text, 1, 200) AS t FROM txt JOIN documents d ON d.doc_id = frame_id WHERE substring(d.text, 1, 200) <> ''),
once AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY query_id, t ORDER BY rank, frame_id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, frame_id) AS position, len(list_filter(regexp_split_to_array(t, '[ 	
]+'), lambda x: x <> '')) AS w FROM once),
want AS (SELECT *, least(w, CASE WHEN position = 1 THEN 30 ELSE 60 END) AS want FROM placed WHERE position <= 6),
room AS (SELECT *, 60 - coalesce(sum(want) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM want)
SELECT query_id, position, CASE WHEN position = 1 THEN 'expanded' ELSE 'snippet' END AS kind, frame_id, CAST(least(want, room) AS BIGINT) AS tokens FROM room WHERE least(want, room) > 0""")
def plain_context(spark: SparkSession, d: str) -> DataFrame:
    return context.plain_context(_bench_hits(spark, d), 60, 5, 30, 1 << 16).drop("text")


@query("citations", f"""{_HITS} SELECT query_id, frame_id, score, 'snippet' AS kind, CASE WHEN frame_id % 2 = 0 THEN 'src/' || frame_id || '.py' END AS path, CASE WHEN frame_id % 2 = 0 THEN CAST(frame_id % 90 AS INT) END AS line_start, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS position FROM txt WHERE rank <= 5""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    hits = _bench_hits(spark, d)
    made = hits.where("rank <= 7").select("query_id", F.col("rank").alias("position"), F.lit("snippet").alias("kind"), "frame_id")
    even = F.col("frame_id") % 2 == 0
    frames = store.frames(spark, d).select("frame_id", F.when(even, F.create_map(F.lit("relative_path"), F.concat(F.lit("src/"), F.col("frame_id").cast("string"), F.lit(".py")), F.lit("line_start"), (F.col("frame_id") % 90).cast("string"), F.lit("line_end"), F.lit("?"))).alias("metadata"))
    return context.citations(made, frames, hits, 5).select("query_id", "frame_id", "score", "kind", "path", "line_start", "position")


@query("lane_dedup", f"{_HITS} SELECT query_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM txt")
def lane_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each hit comes twice, the second time with a lower score."""
    hits = text_search.search(_index(spark, d), _bench_queries(spark, d), 10).select("query_id", "frame_id", "score")
    return fusion.best_of_lane(hits.unionByName(hits.withColumn("score", F.col("score") - 1)))


@query("retrieval_mean", f"""WITH {_HQ}, {_INDEX}, {_terms_sql('hq')}, {_two_tier_sql(10)}, own AS (SELECT query_id, rank FROM txt WHERE frame_id = query_id)
SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) AS queries FROM hq LEFT JOIN own USING (query_id)""")
def retrieval_mean(spark: SparkSession, d: str) -> DataFrame:
    q = _hybrid_queries(spark, d)
    return metrics.retrieval(text_search.search(_index(spark, d), q, 10), q.select("query_id", F.col("query_id").alias("frame_id")), 10)


@query("mean_judgement", "SELECT round(avg(quality), 6) AS mean, count(quality) AS n FROM labels")
def mean_judgement(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_judgement(table(spark, d, "labels"), "quality")


# ---- row functions ----


@query("text_heads", "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS head, CASE WHEN strlen(text) <= 4 * 25 THEN text END AS short FROM documents")
def text_heads(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.first_lines(t, 2).alias("head"), F.when(F.octet_length(t) <= 100, tx.byte_cap(t, 100)).alias("short"))


@query("quoted_phrase_terms", rf"""WITH q AS (SELECT doc_id, regexp_extract_all(text, '{_W}') AS w FROM documents), p AS (SELECT doc_id, list_filter(list_transform(w[2:4], lambda x: lower(x)), lambda x: x NOT IN ({_STOPS}) AND x <> 'date') AS p FROM q WHERE len(w) >= 4)
SELECT doc_id, array_to_string([x for x, i in zip_dummy], '') AS terms FROM p""".replace("array_to_string([x for x, i in zip_dummy], '')", "array_to_string(list_filter(p, lambda x, i: NOT list_contains(p[1:i - 1], x)), ' ')"))
def quoted_phrase_terms(spark: SparkSession, d: str) -> DataFrame:
    """The second to fourth word of each text as a quoted phrase: its index term."""
    w = table(spark, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w")).where(F.size("w") >= 4)
    quoted = F.concat(F.lit('find "'), F.array_join(F.slice("w", 2, 3), " "), F.lit('" now'))
    return w.select("doc_id", F.coalesce(F.get(tx.phrase_terms(quoted), 0), F.lit("")).alias("terms"))


@query("literal_values", "SELECT l_orderkey, l_linenumber, 'int' AS kind, CAST(l_orderkey AS VARCHAR) AS printed FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_linenumber, 'string', l_returnflag FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_orderkey, l_linenumber, 'bool', 'true' FROM lineitem WHERE l_linenumber = 3")
def literal_values(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    source = F.when(n == 1, F.col("l_orderkey").cast("string")).when(n == 2, F.col("l_returnflag")).otherwise(F.lit("TRUE"))
    out = table(spark, d, "lineitem").where("l_linenumber <= 3").select("l_orderkey", "l_linenumber", tx.literal_value(source).alias("v"))
    return out.select("l_orderkey", "l_linenumber", "v.kind", tx.literal_text(F.col("v")).alias("printed"))

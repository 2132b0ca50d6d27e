"""The registered queries and the SQL each one must agree with.

Each query applies an operator to whole test tables. Its SQL is written for another engine, from the operator's
definition. Queries without SQL are held to examples or brute force in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import store
from ..functions import hashing, scoring
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import answers, chunking, context, facts, filters, fusion, maintenance, media, metrics, rerank, search, sessions, state, surrogates, text_search, vector_search
from ..sources import files, snapshots
from ..store import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


#: The fixed "now" of queries about age: 2024-03-01T00:00:00Z.
NOW_MS = 1709251200000
_W = r"[\p{L}\p{N}]+"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_FRAMES = f"""fr AS (
  SELECT d.doc_id AS frame_id, {store.BASE_MS} + d.doc_id * {store.STEP_MS} AS timestamp_ms, source AS kind, source, lang, n_chars, text AS search_text,
    CASE WHEN d.doc_id % 17 = 16 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN d.doc_id % 13 = 12 THEN d.doc_id + 1 END AS superseded_by,
    coalesce(l.quality, 0) = 1 AS good, coalesce(l.toxic, 0) = 1 AS toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
live AS (SELECT * FROM fr WHERE status = 'active' AND superseded_by IS NULL)"""


# ---- keyword search ----

_INDEX = rf"""
tok AS (SELECT doc_id AS frame_id, unnest(regexp_extract_all(lower(text), '{_W}')) AS term FROM documents),
post AS (SELECT term, frame_id, count(*) AS tf FROM tok GROUP BY ALL),
lens AS (SELECT doc_id AS frame_id, len(regexp_extract_all(lower(coalesce(text, '')), '{_W}')) AS len FROM documents),
tot AS (SELECT count(*) AS n, avg(len) AS average FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


def _terms_sql(source: str) -> str:
    """qt: the first 16 distinct terms of each query of a source (query_id, query)."""
    return rf"""
qt0 AS (SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT query_id, list_filter(regexp_extract_all(lower(query), '{_W}'), lambda x: x NOT IN ({_STOPS}) AND x <> 'date') AS l FROM {source})),
qt1 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) AS r FROM qt0 GROUP BY query_id, term),
qt AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS n_terms FROM qt1 WHERE r <= 16),
bm AS (
  SELECT query_id, frame_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) AS score, count(*) AS hits, any_value(n_terms) AS n_terms
  FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (frame_id), tot GROUP BY query_id, frame_id)"""


def _two_tier_sql(k: int) -> str:
    return f"""
t0 AS (SELECT query_id, frame_id, score, 0 AS tier FROM bm WHERE hits = n_terms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= {k}),
t1 AS (SELECT query_id, frame_id, score, 1 AS tier FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) <= {k}),
txt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, frame_id) AS rank FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 WHERE (query_id, frame_id) NOT IN (SELECT (query_id, frame_id) FROM t0)) QUALIFY rank <= {k})"""


_BENCH = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def _bench_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, d: str) -> text_search.Index:
    return text_search.build_index(table(spark, d, "documents"), "doc_id", "text")


@query("bm25_topk", f"WITH {_BENCH}, {_INDEX}, {_terms_sql('bq')} SELECT query_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM bm QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return text_search.top(text_search.bm25(_index(spark, d), _bench_queries(spark, d)).drop("all_terms"), 10)


@query("bm25_and_or_fallback", f"WITH {_BENCH}, {_INDEX}, {_terms_sql('bq')}, {_two_tier_sql(10)} SELECT query_id, frame_id, score, tier, rank FROM txt")
def bm25_and_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    return text_search.search(_index(spark, d), _bench_queries(spark, d), 10)


@query(
    "tfidf_topk",
    rf"""WITH {_BENCH}, {_INDEX}, q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '{_W}')) AS term FROM bq) GROUP BY ALL)
SELECT query_id, frame_id, round(sum(times * tf * (ln((n + 1) / (df + 1)) + 1)), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(times * tf * (ln((n + 1) / (df + 1)) + 1)), 6) DESC, frame_id) AS rank
FROM q JOIN post USING (term) JOIN dfs USING (term), tot GROUP BY query_id, frame_id QUALIFY rank <= 10""",
)
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return text_search.top(text_search.tfidf(_index(spark, d), _bench_queries(spark, d)), 10)


_PHRASED = rf"""pq AS (SELECT item_id AS query_id, '"' || array_to_string(w[1:2], ' ') || '" ' || w[4] AS query, w[1:2] AS p FROM (SELECT item_id, regexp_extract_all(text, '{_W}') AS w FROM benchmark) WHERE len(w) >= 4)"""


@query(
    "bm25_phrases",
    rf"""WITH {_PHRASED}, {_INDEX}, {_terms_sql('pq')},
ph AS (SELECT query_id, list_filter(list_transform(p, lambda x: lower(x)), lambda x: x NOT IN ({_STOPS}) AND x <> 'date') AS w FROM pq),
ph1 AS (SELECT query_id, list_distinct(w) AS s, w[1] AS a, w[2] AS b, CASE WHEN w[1] = w[2] THEN 1 ELSE len(w) END AS m FROM ph WHERE len(w) > 0),
seqs AS (SELECT doc_id AS frame_id, regexp_extract_all(lower(text), '{_W}') AS t FROM documents),
hit AS (SELECT query_id, frame_id, CASE WHEN m = 1 THEN len(list_filter(t, lambda x: x = a)) ELSE len(list_filter(range(1, len(t)), lambda i: t[i] = a AND t[i + 1] = b)) END AS tf, len(t) AS len
  FROM ph1 JOIN seqs ON list_contains(t, a) AND (m = 1 OR list_contains(t, b))),
pp AS (SELECT query_id, frame_id, tf, len, count(*) OVER (PARTITION BY query_id) AS df FROM hit WHERE tf > 0),
parts AS (
  SELECT query_id, frame_id, tf, len, df FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (frame_id)
  UNION ALL SELECT query_id, frame_id, tf, len, df FROM pp),
bm2 AS (SELECT query_id, frame_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) AS score, count(*) AS hits FROM parts, tot GROUP BY query_id, frame_id),
need AS (SELECT query_id, count(*) + any_value((SELECT count(*) FROM ph1 WHERE ph1.query_id = qt.query_id)) AS n_terms FROM qt GROUP BY query_id)
SELECT query_id, frame_id, score, CASE WHEN hits = n_terms THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hits = n_terms THEN 0 ELSE 1 END, score DESC, frame_id) AS rank
FROM bm2 JOIN need USING (query_id) QUALIFY rank <= 10""",
)
def bm25_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The first two words of each item in quotes, and its fourth."""
    items = table(spark, d, "benchmark").select("item_id", tx.words(F.col("text")).alias("w")).where(F.size("w") >= 4)
    quoted = F.concat(F.lit('"'), F.array_join(F.slice("w", 1, 2), " "), F.lit('" '), F.get("w", 3))
    return text_search.search(_index(spark, d), items.select(F.col("item_id").alias("query_id"), quoted.alias("query")), 10, phrases=True)


@query(
    "bm25_stop_words",
    rf"""WITH sq AS (SELECT * FROM (VALUES (1, 'The and of'), (2, 'what is the'), (3, 'zzzz qqqq')) v(query_id, query)), {_INDEX},
sw AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '{_W}'))) AS term FROM sq)
SELECT query_id, frame_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) AS score
FROM sw JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (frame_id), tot GROUP BY query_id, frame_id""",
)
def bm25_stop_words(spark: SparkSession, d: str) -> DataFrame:
    """Queries of stop words only keep them."""
    queries = spark.createDataFrame([(1, "The and of"), (2, "what is the"), (3, "zzzz qqqq")], "query_id int, query string")
    return text_search.bm25(_index(spark, d), queries, keep_stops=True).select("query_id", "frame_id", "score")


@query("postings_upsert", rf"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS uses FROM post WHERE frame_id % 3 <> 0 GROUP BY term")
def postings_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame is written twice, the second time blank: its postings go."""
    docs = table(spark, d, "documents")
    again = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("frame_id"), F.explode(F.array(F.struct(F.lit(1).alias("sequence"), F.lit("other words").alias("text")), F.struct(F.lit(2).alias("sequence"), F.lit(" ").alias("text")))).alias("x")).select("frame_id", "x.*")
    postings, _ = text_search.upsert_postings(_index(spark, d), again)
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


@query("snippets")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    queries = _bench_queries(spark, d)
    hits = text_search.top(text_search.bm25(_index(spark, d), queries), 5)
    return text_search.snippets(hits, store.frames(spark, d), queries).select("query_id", "frame_id", "rank", "snippet")


# ---- vectors ----


def _vector_sql(score: str, k: int = 10) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings),
s AS (SELECT query_id, frame_id, round({score}, 6) AS score FROM q, e) SELECT query_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM s QUALIFY rank <= {k}"""


_COS = "coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0), 0)"
_L2 = "-pow(list_distance(a, b), 2)"


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return store.embeddings(spark, d).where("frame_id % 100 = 0").select(F.col("frame_id").alias("query_id"), "vector")


for _name, _metric, _sql in (("vector_cosine_topk", "cosine", _COS), ("vector_dot_topk", "dot", "list_dot_product(a, b)"), ("vector_l2_topk", "l2", _L2)):
    query(_name, _vector_sql(_sql))(lambda spark, d, m=_metric: vector_search.blocked(store.embeddings(spark, d), _vector_queries(spark, d), 10, m))

query("vector_exact_expressions", _vector_sql(_COS))(lambda spark, d: vector_search.exact(store.embeddings(spark, d), _vector_queries(spark, d), 10))


@query("vector_hyperplane_recall")
def vector_hyperplane_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate index against the exact search, per query."""
    e, q = store.embeddings(spark, d), _vector_queries(spark, d)
    dims = len(e.select("vector").first()[0])
    near = vector_search.approximate(vector_search.hyperplane_index(e, dims, tables=16, bits=3), q, 10, dims, tables=16, bits=3)
    exact = vector_search.blocked(e, q, 10)
    return exact.select("query_id", "frame_id").join(near.select("query_id", "frame_id", F.lit(1).alias("_f")), ["query_id", "frame_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_f", F.lit(0))).alias("recall"))


@query(
    "l2_normalize",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS m FROM e)
SELECT vec_id, round(m, 6) AS magnitude, abs(m - 1) <= 0.001 AS unit, round(CASE WHEN m > 0 THEN v[1] / m ELSE v[1] END, 6) AS first_value, round(CASE WHEN m > 0 THEN list_sum(list_transform(v, lambda x: x / m)) ELSE list_sum(v) END, 6) AS total FROM n""",
)
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    n = vx.normalize(v)
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.magnitude(v), 6).alias("magnitude"), vx.is_normalized(v).alias("unit"), F.round(F.get(n, 0), 6).alias("first_value"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(
    "vector_algebra",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT x.vec_id, x.a, y.a AS b FROM e x JOIN e y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] + z[2])), 6) AS added, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS apart, round(list_sum(list_transform(a, lambda x: x * 2.5)), 6) AS scaled,
  round(list_distance(a, b), 6) AS distance, round(list_dot_product(a, b), 6) AS dot FROM p""",
)
def vector_algebra(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", total(vx.add(a, b)).alias("added"), total(F.transform(vx.subtract(a, b), F.abs)).alias("apart"), total(vx.scale(a, 2.5)).alias("scaled"), F.round(vx.distance(a, b), 6).alias("distance"), F.round(vx.dot(a, b), 6).alias("dot"))


# ---- fusion and unified search: queries are documents with an id divisible by 100, with their vectors ----

_HQ = "hq AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0)"
_CLASS = (
    "CASE WHEN " + " OR ".join(f"contains(lower(query), '{c}')" for c in tx.TEMPORAL_CUES) + " THEN 'temporal' WHEN "
    + " OR ".join([f"starts_with(lower(query), '{c}')" for c in tx.FACTUAL_STARTS] + [f"contains(lower(query), '{c}')" for c in tx.FACTUAL_CUES]) + " THEN 'factual' WHEN "
    + " OR ".join(f"contains(lower(query), '{c}')" for c in tx.SEMANTIC_CUES) + " THEN 'semantic' ELSE 'exploratory' END"
)


def _weight_sql(lane: int) -> str:
    return "CASE cls " + " ".join(f"WHEN '{n}' THEN CAST({w[lane]} AS DOUBLE)" for n, w in tx.CLASS_WEIGHTS.items()) + " END"


def _vec_lane_sql(k: int) -> str:
    return f"""
vs AS (SELECT q.vec_id AS query_id, e.vec_id AS frame_id, round({_COS}, 6) AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id % 100 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS b FROM embeddings) e WHERE q.vec_id IN (SELECT query_id FROM hq)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM vs QUALIFY rank <= {k})"""


def _hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return docs.join(_vector_queries(spark, d), "query_id", "left")


def _two_lanes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = _hybrid_queries(spark, d)
    text = text_search.search(_index(spark, d), q, 30)
    return text, vector_search.blocked(store.embeddings(spark, d), q.where("vector is not null"), 30)


def _fused_sql(lanes: str, order: str = "score DESC, best_rank, frame_id", k: int = 60) -> str:
    return f"""lanes AS ({lanes}), fused AS (SELECT query_id, frame_id, round(list_sum(list_sort(list(weight / ({k} + rank)))), 6) AS score, min(rank) AS best_rank, array_to_string(list_sort(list_distinct(list(lane))), ',') AS sources FROM lanes WHERE weight > 0 GROUP BY query_id, frame_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position FROM fused)"""


_TWO = "SELECT query_id, frame_id, rank, 'text' AS lane, 0.6 AS weight FROM txt UNION ALL SELECT query_id, frame_id, rank, 'vector', 0.4 FROM vec"
_TWO_LANES = f"WITH {_HQ}, {_INDEX}, {_terms_sql('hq')}, {_two_tier_sql(30)}, {_vec_lane_sql(30)}"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.array_join("sources", ","))


@query("rrf_hybrid", f"{_TWO_LANES}, {_fused_sql(_TWO)} SELECT query_id, frame_id, score, best_rank, sources, position FROM pos")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _flat(fusion.fuse_two(*_two_lanes(spark, d), alpha=0.6))


@query("rrf_frame_tiebreak", f"{_TWO_LANES}, {_fused_sql(_TWO.replace('0.6', '0.5').replace('0.4', '0.5'), 'score DESC, frame_id')} SELECT query_id, frame_id, score, best_rank, sources, position FROM pos")
def rrf_frame_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    text, vector = _two_lanes(spark, d)
    return _flat(fusion.fuse(fusion.lane(text, "text", 0.5).unionByName(fusion.lane(vector, "vector", 0.5)), tie="frame"))


@query(
    "rrf_diagnostics",
    f"""{_TWO_LANES}, {_fused_sql(_TWO)}, prev AS (SELECT *, lag(score) OVER w AS ps, lag(best_rank) OVER w AS pr FROM pos WINDOW w AS (PARTITION BY query_id ORDER BY position))
SELECT query_id, frame_id, position, CASE WHEN position = 1 THEN 'top_result' WHEN ps <> score THEN 'fused_score' WHEN pr <> best_rank THEN 'best_lane_rank' ELSE 'frame_id' END AS reason,
  (SELECT count(*) FROM lanes l WHERE l.query_id = prev.query_id AND l.frame_id = prev.frame_id) AS n_lanes FROM prev WHERE position <= 10""",
)
def rrf_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    text, vector = _two_lanes(spark, d)
    lanes = fusion.lane(text, "text", 0.6).unionByName(fusion.lane(vector, "vector", 0.4))
    return fusion.diagnostics(fusion.fuse(lanes), lanes).select("query_id", "frame_id", "position", "reason", F.size("lanes").cast("long").alias("n_lanes"))


_HYBRID_LANES = f"""SELECT query_id, frame_id, rank, 'text' AS lane, 0.5 * {_weight_sql(0)} AS weight FROM txt JOIN kinds USING (query_id)
UNION ALL SELECT query_id, frame_id, rank, 'vector', 0.5 * {_weight_sql(1)} FROM vec JOIN kinds USING (query_id)
UNION ALL SELECT query_id, frame_id, rank, 'timeline', {_weight_sql(2)} FROM kinds, newest WHERE cls = 'temporal'"""
_HYBRID = f"""{_TWO_LANES}, {_FRAMES}, kinds AS (SELECT query_id, {_CLASS} AS cls FROM hq), newest AS (SELECT frame_id, row_number() OVER (ORDER BY timestamp_ms DESC, frame_id) AS rank FROM live QUALIFY rank <= 30), {_fused_sql(_HYBRID_LANES)}"""


@query("unified_search_hybrid", f"{_HYBRID} SELECT query_id, frame_id, score, sources, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM pos JOIN live USING (frame_id) QUALIFY rank <= 10")
def unified_search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    got = search.unified_search(search.Request(), _hybrid_queries(spark, d), store.frames(spark, d), _index(spark, d), store.embeddings(spark, d))
    return _flat(got).drop("preview")


@query("unified_search_text", f"WITH {_HQ}, {_INDEX}, {_terms_sql('hq')}, {_two_tier_sql(30)}, {_FRAMES} SELECT query_id, frame_id, score, 'text' AS sources, row_number() OVER (PARTITION BY query_id ORDER BY txt.rank) AS rank FROM txt JOIN live USING (frame_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY txt.rank) <= 10")
def unified_search_text(spark: SparkSession, d: str) -> DataFrame:
    got = search.unified_search(search.Request(mode="text"), _hybrid_queries(spark, d), store.frames(spark, d), _index(spark, d))
    return _flat(got).drop("preview")


@query("unified_search_vector", f"WITH {_HQ}, {_vec_lane_sql(30)}, {_FRAMES} SELECT query_id, frame_id, score, 'vector' AS sources, row_number() OVER (PARTITION BY query_id ORDER BY vec.rank) AS rank FROM vec JOIN live USING (frame_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vec.rank) <= 10")
def unified_search_vector(spark: SparkSession, d: str) -> DataFrame:
    q = _hybrid_queries(spark, d).where("vector is not null")
    return _flat(search.unified_search(search.Request(mode="vector"), q, store.frames(spark, d), _index(spark, d), store.embeddings(spark, d))).drop("preview")


@query(
    "filtered_topk",
    f"WITH {_HQ}, {_INDEX}, {_terms_sql('hq')}, {_two_tier_sql(30)}, {_FRAMES} SELECT query_id, frame_id, score, 'text' AS sources, row_number() OVER (PARTITION BY query_id ORDER BY txt.rank) AS rank FROM txt JOIN live USING (frame_id) WHERE lang = 'en' AND good AND n_chars > 2000 AND score >= 1.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY txt.rank) <= 10",
)
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    keep = filters.FrameFilter(metadata={"lang": "en"}, labels=["quality"], tags=[("size", "long")], min_score=1.5)
    got = search.unified_search(search.Request(mode="text", frame_filter=keep), _hybrid_queries(spark, d), store.frames(spark, d), _index(spark, d))
    return _flat(got).drop("preview")


@query(
    "filtered_topk_pre",
    f"""WITH {_HQ}, {_FRAMES}, {_INDEX}, {_terms_sql('hq')}, kept AS (SELECT * FROM bm WHERE frame_id IN (SELECT frame_id FROM live WHERE lang = 'fr')), {_two_tier_sql(30).replace("FROM bm", "FROM kept")}
SELECT query_id, frame_id, score, 'text' AS sources, rank FROM txt WHERE rank <= 10""",
)
def filtered_topk_pre(spark: SparkSession, d: str) -> DataFrame:
    request = search.Request(mode="text", frame_filter=filters.FrameFilter(metadata={"lang": "fr"}), filter_mode="pre")
    return _flat(search.unified_search(request, _hybrid_queries(spark, d), store.frames(spark, d), _index(spark, d))).drop("preview")


@query(
    "timeline_fallback",
    f"WITH {_FRAMES}, newest AS (SELECT frame_id, row_number() OVER (ORDER BY timestamp_ms DESC, frame_id) AS r FROM fr QUALIFY r <= 10) SELECT 1 AS query_id, frame_id, round(1.0 / (60 + r), 6) AS score, 'timeline' AS sources, row_number() OVER (ORDER BY r) AS rank FROM newest JOIN live USING (frame_id)",
)
def timeline_fallback(spark: SparkSession, d: str) -> DataFrame:
    nothing = spark.createDataFrame([(1, "zzzzzz qqqqqq")], "query_id int, query string")
    return _flat(search.unified_search(search.Request(mode="text", timeline_fallback=True), nothing, store.frames(spark, d), _index(spark, d))).drop("preview")


@query("intent_rerank")
def intent_rerank(spark: SparkSession, d: str) -> DataFrame:
    q = _hybrid_queries(spark, d)
    hits = search.unified_search(search.Request(mode="text", top_k=20), q, store.frames(spark, d), _index(spark, d))
    return _flat(rerank.intent_rerank(hits, q)).drop("preview")


@query("answer_rerank")
def answer_rerank(spark: SparkSession, d: str) -> DataFrame:
    q = _hybrid_queries(spark, d)
    hits = search.unified_search(search.Request(mode="text", top_k=20), q, store.frames(spark, d), _index(spark, d))
    return _flat(rerank.answer_rerank(hits, q)).drop("preview")


# ---- query analysis, over all texts of conversations ----

_TALK = "FROM conversations"


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations")


@query("query_classification", f"WITH k AS (SELECT conv_id, turn, {_CLASS.replace('query', 'text')} AS cls {_TALK}) SELECT conv_id, turn, cls, {_weight_sql(0)} AS w_text, {_weight_sql(1)} AS w_vector, {_weight_sql(2)} AS w_time FROM k")
def query_classification(spark: SparkSession, d: str) -> DataFrame:
    k = _talk(spark, d).select("conv_id", "turn", tx.query_class(F.col("text")).alias("cls"))
    return k.select("*", *(tx.class_weight(F.col("cls"), i).alias(n) for i, n in enumerate(("w_text", "w_vector", "w_time"))))


def _any_sql(cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{c}')" for c in cues) + ")"


_STEM = (
    "CASE WHEN length(t) <= 3 THEN t WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y' WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, length(t) - 3) "
    "WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, length(t) - 2) WHEN t LIKE '%s' AND length(t) > 4 THEN left(t, length(t) - 1) ELSE t END"
)


@query(
    "intent_detection",
    rf"""WITH k AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(lower(text), '{_W}'), lambda t: {_STEM}) AS s {_TALK}),
f AS (SELECT *, {_any_sql(tx.LOCATION_CUES)} OR list_contains(s, 'move') OR list_contains(s, 'mov') AS loc, {_any_sql(tx.DATE_CUES)} AS dat, {_any_sql(tx.OWNER_CUES)} AS own FROM k)
SELECT conv_id, turn, concat_ws(',', CASE WHEN dat THEN 'date' END, CASE WHEN loc THEN 'location' END, CASE WHEN contains(lower(text), ' and ') AND CAST(loc AS INT) + CAST(dat AS INT) + CAST(own AS INT) > 1 THEN 'multi_hop' END, CASE WHEN own THEN 'ownership' END) AS intents FROM f""",
)
def intent_detection(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", F.array_join(tx.intents(F.col("text")), ",").alias("intents"))


@query("light_stem", rf"SELECT term, count(*) AS n FROM (SELECT {_STEM} AS term FROM (SELECT unnest(regexp_extract_all(lower(text), '{_W}')) AS t FROM documents)) WHERE term NOT IN ({_STOPS}) GROUP BY term")
def light_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(tx.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "query_signals",
    r"""WITH k AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(text, '[\s\p{P}]+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, round(least(1.0, least(len(w) / 8.0, 0.4) + CASE WHEN regexp_matches(text, '\p{Nd}') OR len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}'))) > 0 THEN 0.35 ELSE 0 END + CASE WHEN contains(text, '"') THEN 0.25 ELSE 0 END), 6) AS specificity FROM k""",
)
def query_signals(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", F.round(tx.specificity(F.col("text")), 6).alias("specificity"))



@query("date_keys", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS dates FROM orders")
def date_keys(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    later = day + F.expr("INTERVAL 3 DAYS")
    t = F.concat(F.lit("Shipped on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" and billed on "), F.date_format(later, "MMMM d, yyyy"), F.lit(" or 31 Feb 2024."))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(tx.date_keys(t), ",").alias("dates"))


@query("entity_terms")
def entity_terms(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", F.array_join(tx.entity_terms(F.col("text")), ",").alias("entities"))


# ---- frames ----


@query("timeline_desc", f"WITH {_FRAMES} SELECT frame_id, timestamp_ms, kind FROM live ORDER BY timestamp_ms DESC, frame_id LIMIT 100")
def timeline_desc(spark: SparkSession, d: str) -> DataFrame:
    return filters.timeline(store.frames(spark, d), 100).select("frame_id", "timestamp_ms", "kind")


_SPAN = (store.BASE_MS + 100 * store.STEP_MS, store.BASE_MS + 700 * store.STEP_MS)


@query("time_range_filter", f"WITH {_FRAMES} SELECT frame_id, timestamp_ms FROM fr WHERE timestamp_ms >= {_SPAN[0]} AND timestamp_ms < {_SPAN[1]}")
def time_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.frames(spark, d).where(filters.in_time(F.col("timestamp_ms"), *_SPAN)).select("frame_id", "timestamp_ms")


@query("metadata_filter", f"WITH {_FRAMES} SELECT frame_id, kind FROM fr WHERE lang = 'de' AND source = 'src3'")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.frames(spark, d).where(filters.metadata_matches({"lang": "de", "source": "src3"})).select("frame_id", "kind")


@query("label_filter", f"WITH {_FRAMES} SELECT frame_id FROM fr WHERE good AND toxic")
def label_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.frames(spark, d).where(filters.labels_match(["quality", "toxic"])).select("frame_id")


@query("tag_filter", f"WITH {_FRAMES} SELECT frame_id FROM fr WHERE lang = 'es' AND n_chars > 2000")
def tag_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.frames(spark, d).where(filters.tags_match([("lang", "es"), ("size", "long")])).select("frame_id")


@query("frame_lookup", f"WITH {_FRAMES} SELECT frame_id, status, superseded_by FROM fr WHERE frame_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("frame_id"))
    return filters.lookup(store.frames(spark, d), ids).select("frame_id", "status", "superseded_by")


@query("previews")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.byte_preview(F.col("text"), 101).alias("preview"), tx.first_lines(F.col("text"), 2).alias("head"))


@query("live_set_stats", f"WITH {_FRAMES} SELECT count(*) AS frames, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'deleted') AS deleted, count(superseded_by) AS superseded, CAST(sum(strlen(search_text)) AS BIGINT) AS bytes, CAST(sum(strlen(search_text)) FILTER (status = 'deleted' OR superseded_by IS NOT NULL) AS BIGINT) AS dead_bytes, round(sum(strlen(search_text)) FILTER (status = 'deleted' OR superseded_by IS NOT NULL) / sum(strlen(search_text)), 6) AS dead_fraction FROM fr")
def live_set_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.dead_fraction(maintenance.store_stats(store.frames(spark, d)))


@query("rewrite_live_set", f"WITH {_FRAMES} SELECT frame_id, CASE WHEN status = 'active' AND superseded_by IS NULL THEN strlen(search_text) ELSE 0 END AS size FROM fr")
def rewrite_live_set(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.rewrite_live_set(store.frames(spark, d)).select("frame_id", F.octet_length("search_text").cast("long").alias("size"))


@query(
    "compaction_gates",
    """WITH c AS (SELECT event_id, event_id % 64 AS flushes, (event_id * 7919) % 600000 AS since_last_ms, (event_id * 104729) % 30000 AS idle_ms, 1000000 + event_id AS bytes, (event_id * 31) % 1000000 AS dead_bytes FROM events)
SELECT event_id, CASE WHEN flushes % 32 <> 0 THEN 'cadence' WHEN since_last_ms < 300000 THEN 'interval' WHEN idle_ms < 15000 THEN 'busy' WHEN dead_bytes < 67108864 AND dead_bytes / bytes < 0.25 THEN 'small_gain' ELSE 'run' END AS decision FROM c""",
)
def compaction_gates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    c = table(spark, d, "events").select("event_id", (i % 64).alias("flushes"), (i * 7919 % 600000).alias("since_last_ms"), (i * 104729 % 30000).alias("idle_ms"), (i + 1000000).alias("bytes"), (i * 31 % 1000000).alias("dead_bytes"))
    return maintenance.compaction_decision(c).select("event_id", "decision")


@query("checksum_verify", "SELECT doc_id AS frame_id FROM documents WHERE doc_id % 11 = 5")
def checksum_verify(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh payload is altered after its checksum was taken."""
    f = snapshots.with_checksums(store.frames(spark, d))
    return maintenance.verify_checksums(f.withColumn("payload", F.when(F.col("frame_id") % 11 == 5, F.concat("payload", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("payload")))).select("frame_id")


@query("overlapping_ranges", """WITH r AS (SELECT user_id AS segment, (event_id * 37) % 100000 AS s, (event_id * 37) % 100000 + 1 + event_id % 50 AS e, event_id FROM events), p AS (SELECT *, max(e) OVER (PARTITION BY segment ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
SELECT segment, count(*) AS overlaps FROM p WHERE s < before GROUP BY segment""")
def overlapping_ranges(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    r = table(spark, d, "events").select(F.col("user_id").alias("segment"), (i * 37 % 100000).alias("start"), (i * 37 % 100000 + 1 + i % 50).alias("end"))
    return maintenance.overlapping_ranges(r).groupBy("segment").agg(F.count("*").alias("overlaps"))


@query("content_dedup", "SELECT sha256(coalesce(text, '')) AS content_hash, count(*) AS copies, min(doc_id) AS first_frame FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.duplicate_content(store.frames(spark, d))


@query("digest_diff", """WITH a AS (SELECT url AS path, strlen(html) AS size, sha256(html) AS hash FROM pages WHERE page_id % 10 <> 1), b AS (SELECT url AS path, strlen(html) AS size, CASE WHEN page_id % 10 = 2 THEN sha256(html || 'x') ELSE sha256(html) END AS hash FROM pages WHERE page_id % 10 <> 3)
SELECT path, CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'removed' WHEN a.hash = b.hash AND a.size = b.size THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path)""")
def digest_diff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    digest = lambda df, h: df.select(F.col("url").alias("path"), F.octet_length("html").alias("size"), h.alias("hash"))
    now = F.when(F.col("page_id") % 10 == 2, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256))
    return chunking.digest_diff(digest(p.where("page_id % 10 <> 1"), F.sha2("html", 256)), digest(p.where("page_id % 10 <> 3"), now))


@query("pages_text")
def pages_text(spark: SparkSession, d: str) -> DataFrame:
    return files.html_pages(table(spark, d, "pages"))


# ---- state ----

_LOG = """lg AS (SELECT event_id AS sequence, CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'supersede' ELSE 'put' END AS op, user_id AS frame_id, user_id + 1 AS other_id FROM events)"""


def _mutations(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "supersede").otherwise("put")
    return table(spark, d, "events").select(F.col("event_id").alias("sequence"), op.alias("op"), F.col("user_id").alias("frame_id"), (F.col("user_id") + 1).alias("other_id"))


@query("wal_replay", f"""WITH {_FRAMES}, {_LOG}, late AS (SELECT * FROM lg WHERE sequence > 100), base AS (SELECT frame_id, status, superseded_by FROM fr UNION ALL SELECT DISTINCT frame_id, 'active', NULL FROM late WHERE op = 'put' AND frame_id NOT IN (SELECT frame_id FROM fr)),
ch AS (SELECT frame_id, max(sequence) FILTER (op = 'delete') AS del, arg_max(other_id, sequence) FILTER (op = 'supersede') AS by_id FROM late WHERE op <> 'put' GROUP BY frame_id)
SELECT frame_id, CASE WHEN del IS NOT NULL THEN 'deleted' ELSE status END AS status, coalesce(by_id, superseded_by) AS superseded_by FROM base LEFT JOIN ch USING (frame_id)""")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    return state.replay(store.frames(spark, d), _mutations(spark, d), 100)


@query("supersede_validation", f"""WITH {_FRAMES}, l AS (SELECT event_id AS sequence, user_id AS frame_id, CASE WHEN event_id % 7 = 0 THEN user_id WHEN event_id % 5 = 0 THEN user_id - 1 ELSE user_id + 1 END AS other_id FROM events),
b AS (SELECT other_id AS frame_id, frame_id AS other_id, min(sequence) AS back FROM l GROUP BY ALL),
c AS (SELECT l.*, CASE WHEN l.frame_id = l.other_id THEN 'self' WHEN NOT (l.frame_id IN (SELECT frame_id FROM fr) AND l.other_id IN (SELECT frame_id FROM fr)) THEN 'unknown' WHEN back < sequence THEN 'reversed' END AS p FROM l LEFT JOIN b ON b.frame_id = l.frame_id AND b.other_id = l.other_id),
n AS (SELECT *, count(*) FILTER (p IS NULL) OVER (PARTITION BY frame_id ORDER BY sequence) AS n FROM c)
SELECT sequence, coalesce(p, 'second') AS problem FROM n WHERE p IS NOT NULL OR n > 1""")
def supersede_validation(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    links = table(spark, d, "events").select(i.alias("sequence"), u.alias("frame_id"), F.when(i % 7 == 0, u).when(i % 5 == 0, u - 1).otherwise(u + 1).alias("other_id"))
    return state.supersede_errors(store.frames(spark, d), links)


_ACCESS = "ac AS (SELECT user_id AS frame_id, count(*) AS accesses, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY user_id)"


@query("access_stats", f"WITH {_ACCESS} SELECT * FROM ac")
def access_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.access_stats(store.access_log(spark, d))


@query("access_stats_merge", f"WITH {_ACCESS} SELECT * FROM ac")
def access_stats_merge(spark: SparkSession, d: str) -> DataFrame:
    log = store.access_log(spark, d)
    return state.merge_access_stats(state.access_stats(log.where("event_id % 2 = 0")), state.access_stats(log.where("event_id % 2 = 1")))


_IMPORTANCE = f"""im AS (SELECT frame_id, CASE WHEN accesses IS NULL THEN exp(-greatest(0.0, ({NOW_MS} - timestamp_ms) / 3600000.0) / 168)
  ELSE 0.3 * exp(-greatest(0.0, ({NOW_MS} - timestamp_ms) / 3600000.0) / 168) + 0.4 * least(1.0, ln(accesses + 1) / 5) + 0.3 * exp(-greatest(0.0, ({NOW_MS} - last_ms) / 3600000.0) / 24) END AS v, timestamp_ms FROM fr LEFT JOIN ac USING (frame_id))"""


def _importance(spark: SparkSession, d: str) -> DataFrame:
    f = store.frames(spark, d).join(state.access_stats(store.access_log(spark, d)), "frame_id", "left")
    return f.withColumn("v", scoring.importance(F.lit(NOW_MS), F.col("timestamp_ms"), F.col("accesses"), F.col("last_ms")))


@query("importance_score", f"WITH {_FRAMES}, {_ACCESS}, {_IMPORTANCE} SELECT frame_id, round(v, 6) AS importance FROM im")
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return _importance(spark, d).select("frame_id", F.round("v", 6).alias("importance"))


@query("tier_select", f"WITH {_FRAMES}, {_ACCESS}, {_IMPORTANCE} SELECT frame_id, CASE WHEN v + 0.15 * 0.5 >= 0.6 THEN 'full' WHEN v + 0.15 * 0.5 >= 0.3 THEN 'gist' ELSE 'micro' END AS by_importance, CASE WHEN ({NOW_MS} - timestamp_ms) / 86400000.0 <= 7 THEN 'full' WHEN ({NOW_MS} - timestamp_ms) / 86400000.0 <= 30 THEN 'gist' ELSE 'micro' END AS by_age FROM im")
def tier_select(spark: SparkSession, d: str) -> DataFrame:
    return _importance(spark, d).select("frame_id", scoring.tier_by_importance(F.col("v"), F.lit(0.5)).alias("by_importance"), scoring.tier_by_age(F.lit(NOW_MS), F.col("timestamp_ms")).alias("by_age"))


# ---- sessions ----


@query("session_stats", f"SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS frames, CAST(sum(greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))) AS BIGINT) AS tokens, min({store.BASE_MS} + conv_id * {store.STEP_MS} + turn * 1000) AS first_ms, max({store.BASE_MS} + conv_id * {store.STEP_MS} + turn * 1000) AS last_ms FROM conversations GROUP BY conv_id")
def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return sessions.session_stats(store.session_frames(spark, d))


@query("latest_handoff", f"SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 1000 + turn AS frame_id, {store.BASE_MS} + conv_id * {store.STEP_MS} + turn * 1000 AS timestamp_ms, text AS search_text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def latest_handoff(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_handoff(store.session_frames(spark, d))


@query("session_search", "SELECT conv_id * 1000 + turn AS frame_id, role AS kind FROM conversations WHERE conv_id = 7")
def session_search(spark: SparkSession, d: str) -> DataFrame:
    return store.session_frames(spark, d).where(filters.metadata_matches({"session_id": "7"})).select("frame_id", "kind")


# ---- structured memory ----

_DAY = "CAST(floor(epoch_ms(o_orderdate) / 86400000) AS BIGINT)"
_FACTS = f"""
ent AS (SELECT c_custkey AS entity_id, 'customer:' || c_custkey AS key FROM customer UNION ALL SELECT 1000000000 + n_nationkey, 'nation:' || n_nationkey FROM nation),
fact AS (SELECT c_custkey AS fact_id, c_custkey AS subject_id, 'lives_in' AS predicate, 7 AS object_kind, NULL AS object_text, NULL AS object_int, 1000000000 + c_nationkey AS object_id, 0 AS vf, NULL AS vt, 0 AS sf FROM customer
  UNION ALL SELECT 2000000000 + o_orderkey, o_custkey, 'order.status', 1, o_orderstatus, NULL, NULL, {_DAY} * 86400000, CASE WHEN o_orderstatus = 'F' THEN ({_DAY} + 60) * 86400000 END, ({_DAY} + 1) * 86400000 FROM orders
  UNION ALL SELECT 4000000000 + o_orderkey, o_custkey, 'order.day', 2, NULL, {_DAY}, NULL, {_DAY} * 86400000, CASE WHEN o_orderstatus = 'F' THEN ({_DAY} + 60) * 86400000 END, ({_DAY} + 1) * 86400000 FROM orders),
full_fact AS (SELECT f.*, s.key AS subject, o.key AS object_key FROM fact f JOIN ent s ON s.entity_id = f.subject_id LEFT JOIN ent o ON o.entity_id = f.object_id)"""
_AT = 820454400000


@query("facts_asof", f"WITH {_FACTS} SELECT fact_id, subject, predicate, object_kind, coalesce(object_key, object_text, CAST(object_int AS VARCHAR)) AS object FROM full_fact WHERE vf <= {_AT} AND (vt IS NULL OR vt > {_AT}) AND sf <= {_AT}")
def facts_asof(spark: SparkSession, d: str) -> DataFrame:
    return facts.facts_as_of(store.facts(spark, d), _AT, _AT).select("fact_id", "subject", "predicate", "object_kind", facts.object_text().alias("object"))


@query("facts_ordered", f"""WITH {_FACTS}, h AS (SELECT * FROM full_fact WHERE vf <= {_AT} AND (vt IS NULL OR vt > {_AT}) AND sf <= {_AT})
SELECT subject, fact_id, row_number() OVER (PARTITION BY subject ORDER BY predicate, object_kind, coalesce(object_key, object_text, CAST(object_int AS VARCHAR)), vf DESC, fact_id) AS position, count(*) OVER (PARTITION BY subject) >= 8 AS truncated FROM h QUALIFY position <= 8""")
def facts_ordered(spark: SparkSession, d: str) -> DataFrame:
    return facts.ordered(facts.facts_as_of(store.facts(spark, d), _AT, _AT), 8).select("subject", "fact_id", "position", "truncated")


@query("facts_asof_boundaries", f"""WITH {_FACTS}, ask AS (SELECT o_orderkey AS as_of_id, 'customer:' || o_custkey AS key, ({_DAY} + 60) * 86400000 AS t FROM orders)
SELECT as_of_id, count(*) AS n, min(fact_id) AS least, max(fact_id) AS most FROM ask JOIN full_fact ON subject = ask.key AND vf <= t AND (vt IS NULL OR vt > t) AND sf <= t GROUP BY as_of_id""")
def facts_asof_boundaries(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_millis(F.col("o_orderdate").cast("timestamp")) / store.DAY_MS).cast("long")
    ask = table(spark, d, "orders").select(F.col("o_orderkey").alias("as_of_id"), F.concat(F.lit("customer:"), "o_custkey").alias("key"), ((day + 60) * store.DAY_MS).alias("valid_ms"), ((day + 60) * store.DAY_MS).alias("system_ms"))
    return facts.facts_as_of(store.facts(spark, d), 0, 0, asked=ask).groupBy("as_of_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("least"), F.max("fact_id").alias("most"))


@query("evidence_rank", f"""WITH {_FACTS}, ev AS (SELECT 2000000000 + o_orderkey AS fact_id, o_orderkey % (SELECT greatest(count(*), 1) FROM documents) AS source_frame_id, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0 END AS confidence, {_DAY} * 86400000 AS asserted_at_ms FROM orders),
h AS (SELECT fact_id FROM full_fact WHERE vf <= {_AT} AND (vt IS NULL OR vt > {_AT}) AND sf <= {_AT})
SELECT source_frame_id, max(coalesce(confidence, -1.0)) AS confidence, max(asserted_at_ms) AS asserted_at_ms, count(DISTINCT fact_id) AS n_facts FROM ev JOIN h USING (fact_id) GROUP BY source_frame_id ORDER BY confidence DESC, asserted_at_ms DESC, n_facts DESC, source_frame_id LIMIT 32""")
def evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    s = store.facts(spark, d)
    return facts.evidence_frames(s, facts.facts_as_of(s, _AT, _AT), 32)


@query("alias_resolve", "SELECT upper(c_name) AS alias, 'customer:' || c_custkey AS key, 'customer' AS kind FROM customer UNION ALL SELECT lower(n_name), 'nation:' || n_nationkey, 'nation' FROM nation")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "customer").select(F.upper("c_name").alias("alias")).unionByName(table(spark, d, "nation").select(F.lower("n_name").alias("alias")))
    return facts.resolve_alias(store.facts(spark, d), names)


@query("entity_candidates", """WITH q AS (SELECT c_custkey AS query_id, 'Ask ' || c_name || ' about ' || n_name AS query FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 10000000 + n_nationkey, n_name FROM nation),
al AS (SELECT 'customer:' || c_custkey AS key, lower(c_name) AS a FROM customer UNION ALL SELECT 'nation:' || n_nationkey, lower(n_name) FROM nation),
m AS (SELECT query_id, lower(trim(query)) AS a, 0 AS match FROM q UNION ALL SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[\\s!-/:-@\\[-`{-~]+'), lambda t: t <> ''))), 1 FROM q),
b AS (SELECT query_id, key, min(match) AS match, arg_min(length(al.a), match * 1000 - length(al.a)) AS size FROM m JOIN al USING (a) GROUP BY query_id, key)
SELECT query_id, key, match, row_number() OVER (PARTITION BY query_id ORDER BY match, size DESC, key) AS position FROM b QUALIFY position <= 16""")
def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Ask "), "c_name", F.lit(" about "), "n_name").alias("query"))
    q = q.unionByName(n.select((F.col("n_nationkey") + 10000000).cast("long").alias("query_id"), F.col("n_name").alias("query")))
    return facts.entity_candidates(store.facts(spark, d), q)


@query("structured_lane")
def structured_lane(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("what did "), "c_name", F.lit(" order")).alias("query"))
    q = n.unionByName(table(spark, d, "customer").select((F.col("c_custkey") + 10000000).alias("query_id"), F.col("c_name").alias("query")))
    return facts.structured_lane(store.facts(spark, d), q, _AT)


@query("eav_latest", """WITH l AS (SELECT event_id AS sequence, 'user:' || user_id AS entity, event_type AS attribute, CASE WHEN event_id % 9 = 0 THEN 'forget' ELSE 'remember' END AS op, CAST(event_id AS VARCHAR) AS value FROM events),
e AS (SELECT *, sum(CASE WHEN op = 'forget' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, attribute ORDER BY sequence) AS epoch FROM l), m AS (SELECT *, max(epoch) OVER (PARTITION BY entity, attribute) AS last FROM e)
SELECT entity, attribute, arg_max(value, sequence) AS value, count(*) AS version FROM m WHERE epoch = last AND op = 'remember' GROUP BY entity, attribute""")
def eav_latest(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "events").select(F.col("event_id").alias("sequence"), F.concat(F.lit("user:"), "user_id").alias("entity"), F.col("event_type").alias("attribute"), F.when(F.col("event_id") % 9 == 0, "forget").otherwise("remember").alias("op"), F.col("event_id").cast("string").alias("value"))
    return facts.latest_values(log)


@query("retract_replay", f"""WITH {_FACTS}, r AS (SELECT 2000000000 + l_orderkey AS fact_id, min(CAST(floor(epoch_ms(l_shipdate) / 86400000) AS BIGINT) * 86400000) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT fact_id, sf AS system_from_ms, CASE WHEN t > sf THEN t END AS system_to_ms FROM fact LEFT JOIN r USING (fact_id)""")
def retract_replay(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select((F.lit(2000000000) + F.col("l_orderkey")).cast("long").alias("fact_id"), (F.floor(F.unix_millis(F.col("l_shipdate").cast("timestamp")) / store.DAY_MS) * store.DAY_MS).cast("long").alias("at_ms"))
    return facts.retract(store.facts(spark, d).span, gone).select("fact_id", "system_from_ms", "system_to_ms")


@query("entity_upsert", "WITH o AS (SELECT 'nation:' || n_nationkey AS key FROM nation), f AS (SELECT 'nation:' || n_nationkey AS key FROM nation UNION SELECT 'region:' || r_regionkey FROM region) SELECT key, CASE WHEN key IN (SELECT key FROM o) THEN 'nation' ELSE 'place' END AS kind, CASE WHEN key IN (SELECT key FROM o) THEN 0 ELSE row_number() OVER (PARTITION BY key IN (SELECT key FROM o) ORDER BY key) END AS place FROM f")
def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    have = store.facts(spark, d).entity.where("kind = 'nation'")
    fresh = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("key"), F.lit("place").alias("kind")).unionByName(table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("key"), F.lit("place").alias("kind")))
    out = facts.upsert_entities(have, fresh)
    return out.select("key", "kind", F.greatest(F.col("entity_id") - 1000000024, F.lit(0)).alias("place"))


@query("edges_two_hop", "SELECT 'customer:' || c.c_custkey AS key, 2 AS hops FROM customer c WHERE c_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 1) AND c_custkey <> 1 UNION ALL SELECT 'nation:' || c_nationkey, 1 FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'customer:1', 0 FROM customer WHERE c_custkey = 1")
def edges_two_hop(spark: SparkSession, d: str) -> DataFrame:
    s = store.facts(spark, d)
    return facts.walk(facts.edges(s), s.entity.where("key = 'customer:1'"), 2)


@query("fact_hash")
def fact_hash(spark: SparkSession, d: str) -> DataFrame:
    held = facts.facts_as_of(store.facts(spark, d), store.MAX_MS - 1, store.MAX_MS - 1)
    return held.select("fact_id", hashing.fact_hash("subject", "predicate", "object_kind", facts.object_text()).alias("hash"))


# ---- chunks, sentences, contexts ----


@query("chunk_whitespace", r"""WITH w AS (SELECT doc_id AS frame_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT frame_id, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 120) / 104.0)) AS BIGINT) + 1)) AS i FROM w WHERE len(w) > 0)
SELECT frame_id, i AS chunk_index, count(*) OVER (PARTITION BY frame_id) AS chunk_count, sha256(array_to_string(w[i * 104 + 1:i * 104 + 120], ' ')) AS hash FROM s""")
def chunk_whitespace(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.word_chunks(store.frames(spark, d), 120, 16)
    return out.select("frame_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), F.sha2("text", 256).alias("hash"))


@query("chunk_line_window")
def chunk_line_window(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(store.frames(spark, d), 120, 20).drop("text")


@query("remember")
def remember(spark: SparkSession, d: str) -> DataFrame:
    return chunking.remember(store.frames(spark, d)).select("frame_id", "role", "parent_id", "chunk_index", "chunk_count")


@query("code_manifest")
def code_manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.concat("url", F.lit(".ts")).alias("path"), F.col("html").alias("text"))
    return chunking.manifest(pages).drop("text")


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, ceil(strlen(text) / 4.0)) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


_SENT = rf"""sn AS (SELECT doc_id AS frame_id, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g')), '([^.!?;]+[.!?;]*)', 1), lambda s: trim(s)), lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]')) AS l FROM documents),
se AS (SELECT frame_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS s FROM sn), sw AS (SELECT *, regexp_extract_all(lower(s), '{_W}') AS w FROM se),
sc AS (SELECT frame_id, i, s, CASE WHEN len(w) = 0 THEN 0 ELSE least(len(w), 40) * (CASE WHEN len(w) < 4 THEN 0.25 ELSE 1 END) * (CASE WHEN len(w) > 80 THEN 0.7 ELSE 1 END) + (CASE WHEN regexp_matches(s, '\p{{Nd}}') THEN 6 ELSE 0 END) + (CASE WHEN contains(s, ':') THEN 4 ELSE 0 END)
  + (CASE WHEN s LIKE '-%' OR s LIKE '*%' THEN 2 ELSE 0 END) + (CASE WHEN contains(s, '`') THEN 2 ELSE 0 END) + len(list_distinct(w)) / len(w) * 3 END AS score FROM sw)"""


@query("sentence_scores", f"WITH {_SENT} SELECT frame_id, i, round(score, 4) AS score FROM sc")
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    s = store.frames(spark, d).select("frame_id", F.posexplode(surrogates.sentences(F.col("search_text"))).alias("i", "s"))
    return s.select("frame_id", F.col("i").cast("long").alias("i"), F.round(surrogates.sentence_score(F.col("s")), 4).alias("score"))


@query("mmr_surrogate")
def mmr_surrogate(spark: SparkSession, d: str) -> DataFrame:
    return surrogates.summarize(store.frames(spark, d))


@query("jaccard_neighbours", rf"""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{_W}'), lambda x: length(x) > 2)) AS b FROM documents)
SELECT x.doc_id, round(CASE WHEN len(x.b) = 0 OR len(y.b) = 0 THEN 0 ELSE len(list_intersect(x.b, y.b)) / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END, 6) AS jaccard FROM t x JOIN t y ON y.doc_id = x.doc_id + 1""")
def jaccard_neighbours(spark: SparkSession, d: str) -> DataFrame:
    bag = lambda: F.array_distinct(F.filter(tx.tokens(F.col("text")), lambda t: F.length(t) > 2))
    a = table(spark, d, "documents").select("doc_id", bag().alias("a"))
    b = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), bag().alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(surrogates.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_TURNS = "tu AS (SELECT conv_id AS query_id, turn AS rank, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM conversations)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("context_budget_prefix", f"WITH {_TURNS} SELECT query_id, rank, tokens, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS spent FROM tu QUALIFY spent <= 400")
def context_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    return context.prefix(_turns(spark, d), 400)


@query("context_budget_greedy", f"""WITH RECURSIVE {_TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM tu),
g AS (SELECT query_id, r, rank, tokens, CASE WHEN tokens <= 400 THEN 400 - tokens ELSE 400 END AS room, tokens <= 400 AS kept FROM o WHERE r = 1
  UNION ALL SELECT o.query_id, o.r, o.rank, o.tokens, CASE WHEN o.tokens <= g.room THEN g.room - o.tokens ELSE g.room END, o.tokens <= g.room FROM g JOIN o ON o.query_id = g.query_id AND o.r = g.r + 1)
SELECT query_id, rank, tokens FROM g WHERE kept""")
def context_budget_greedy(spark: SparkSession, d: str) -> DataFrame:
    packed = _turns(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tokens"))).alias("items"))
    return packed.select("query_id", F.explode(context.greedy(F.col("items"), 400)).alias("x")).select("query_id", "x.rank", "x.tokens")


@query("recall_context")
def recall_context(spark: SparkSession, d: str) -> DataFrame:
    q, f = _hybrid_queries(spark, d), store.frames(spark, d)
    hits = search.unified_search(search.Request(mode="text", top_k=24), q, f, _index(spark, d))
    built, _ = context.recall(q, rerank.answer_rerank(hits, q), f, NOW_MS)
    return built


@query("dense_context")
def dense_context(spark: SparkSession, d: str) -> DataFrame:
    q, f = _hybrid_queries(spark, d), store.frames(spark, d)
    hits = search.unified_search(search.Request(mode="text", top_k=24), q, f, _index(spark, d))
    told = surrogates.summarize(f.join(hits.select("frame_id").distinct(), "frame_id", "left_semi")).select("frame_id", F.col("gist").alias("text"))
    return context.build_context(hits, f, context.ContextOptions(dense=True), told)


@query("answer_extract")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    q = t.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    items = t.where("turn > 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text"), (1.0 / (F.col("turn") + 1)).alias("score"))
    return answers.extract_answers(q, items)


# ---- media ----


@query("segment_windows", "WITH v AS (SELECT user_id AS video_id, CAST(sum(event_id % 1000) AS BIGINT) AS d FROM events GROUP BY user_id), s AS (SELECT video_id, d, unnest(range(0, least(CAST(ceil(d / 3000.0) AS BIGINT), 200))) AS i FROM v WHERE d > 0) SELECT video_id, i AS index, i * 3000 AS start_ms, least(i * 3000 + 4000, d) AS end_ms FROM s")
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    return media.segments(_videos(spark, d), 4000, 1000, 200)


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.sum(F.col("event_id") % 1000).alias("duration_ms"))


@query("transcript_overlap", """WITH v AS (SELECT user_id AS video_id, CAST(sum(event_id % 1000) AS BIGINT) AS d FROM events GROUP BY user_id), s AS (SELECT video_id, d, unnest(range(0, CAST(ceil(d / 3000.0) AS BIGINT))) AS i FROM v WHERE d > 0), g AS (SELECT video_id, i, i * 3000 AS a, least(i * 3000 + 4000, d) AS b FROM s),
c AS (SELECT DISTINCT user_id AS video_id, (event_id * 13) % 20000 AS s, (event_id * 13) % 20000 + 500 + event_id % 900 AS e, event_type || event_id % 10 AS t FROM events)
SELECT g.video_id, i AS index, a AS start_ms, b AS end_ms, coalesce(string_agg(t, ' ' ORDER BY s, e, t), '') AS transcript FROM g LEFT JOIN c ON c.video_id = g.video_id AND least(b, e) - greatest(a, s) >= 250 GROUP BY ALL""")
def transcript_overlap(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    chunks = table(spark, d, "events").select(F.col("user_id").alias("video_id"), (i * 13 % 20000).alias("start_ms"), (i * 13 % 20000 + 500 + i % 900).alias("end_ms"), F.concat("event_type", (i % 10).cast("string")).alias("text"))
    return media.transcript_of(media.segments(_videos(spark, d), 4000, 1000), chunks, max_bytes=1 << 20)


_POINTS = "pt AS (SELECT c_custkey AS id, (c_custkey * 7919 % 18000) / 100.0 - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0 - 180 AS lon FROM customer)"


@query("geo_bins", f"WITH {_POINTS} SELECT id FROM pt WHERE floor(lat * 100) BETWEEN floor((10 - 1000000 / 111320.0) * 100) AND floor((10 + 1000000 / 111320.0) * 100) AND (floor(lon * 100) >= floor((179 - 1000000 / (111320.0 * cos(radians(10)))) * 100) OR floor(lon * 100) <= floor((179 + 1000000 / (111320.0 * cos(radians(10))) - 360) * 100))")
def geo_bins(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), ((k * 7919 % 18000) / 100.0 - 90).alias("lat"), ((k * 104729 % 36000) / 100.0 - 180).alias("lon"))
    return filters.near_place(points, 10.0, 179.0, 1_000_000.0).select("id")


@query("root_topk", f"""WITH {_HQ}, {_INDEX}, {_terms_sql('hq')}, {_two_tier_sql(30)}, {_FRAMES}, r AS (SELECT query_id, frame_id - frame_id % 4 AS root_id, max(score) AS score, count(*) AS frames FROM txt WHERE frame_id - frame_id % 4 IN (SELECT frame_id FROM live) GROUP BY ALL)
SELECT query_id, root_id, score, frames, row_number() OVER (PARTITION BY query_id ORDER BY floor(score / 0.001) DESC, root_id) AS rank FROM r QUALIFY rank <= 5""")
def root_topk(spark: SparkSession, d: str) -> DataFrame:
    """Four neighbouring documents as one photo or video and what was derived from it."""
    f = store.frames(spark, d).withColumn("parent_id", F.when(F.col("frame_id") % 4 != 0, F.col("frame_id") - F.col("frame_id") % 4))
    hits = text_search.search(_index(spark, d), _hybrid_queries(spark, d), 30)
    return media.top_roots(media.roots_of(hits, f), 5, 1e-3)


@query("segments_per_video", """WITH h AS (SELECT user_id % 10 AS query_id, user_id AS root_id, event_id % 20 AS index, max(value) AS score FROM events GROUP BY ALL) SELECT query_id, root_id, index, score, row_number() OVER (PARTITION BY query_id, root_id ORDER BY score DESC, index) AS position FROM h QUALIFY position <= 3""")
def segments_per_video(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select((F.col("user_id") % 10).alias("query_id"), F.col("user_id").alias("root_id"), (F.col("event_id") % 20).alias("index"), F.col("value").alias("score"))
    return media.best_segments(hits, 3)


# ---- metrics ----


@query("retrieval_metrics")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each document's own text must find it (or an exact copy before it)."""
    q = _hybrid_queries(spark, d)
    hits = text_search.search(_index(spark, d), q, 10)
    return metrics.retrieval(hits, q.select("query_id", F.col("query_id").alias("frame_id")), 10)


@query("token_f1", rf"""WITH p AS (SELECT x.conv_id * 1000 + x.turn AS id, coalesce(x.text, '') AS a, coalesce(y.text, '') AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
t AS (SELECT id, unnest(regexp_extract_all(lower(a), '{_W}')) AS t, 1 AS a, 0 AS b FROM p UNION ALL SELECT id, unnest(regexp_extract_all(lower(b), '{_W}')), 0, 1 FROM p), g AS (SELECT id, t, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL),
s AS (SELECT id, sum(least(a, b)) AS c, sum(a) AS a, sum(b) AS b FROM g GROUP BY id), r AS (SELECT p.id, coalesce(c / nullif(s.a, 0), 0) AS p, coalesce(c / nullif(s.b, 0), 0) AS r FROM p LEFT JOIN s ON s.id = p.id)
SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("expected"))
    pairs = t.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), "expected")
    return metrics.token_f1(pairs)


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency(table(spark, d, "events"), "value", "event_type")


@query("lane_rank", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def lane_rank(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("rank"))


from . import records  # noqa: E402, F401  registers its queries here

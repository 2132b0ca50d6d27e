"""Answers taken from context items: candidates by pattern, the best by relevance, a sentence as the last resort.

Patterns and what asks for them are a table; each gives an array of candidates (text, score) for an item, and a query's answer is
the first kind that it asks for and that has a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .surrogates import sentences

_NAME = r"[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*"
_DATE = r"(?:" + "|".join(m.capitalize() for m in tx.MONTHS) + r")\s+\d{1,2},\s*\d{4}"

#: (kind, pattern, group, bonus, words that ask for it), in order of priority.
PATTERNS: list[tuple[str, str, int, float, list[str]]] = [
    ("appointment", rf"({_DATE}\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM|am|pm))", 1, 0.55, ["dentist", "appointment"]),
    ("pet", rf"\b(?:dog|puppy|cat|pet)\s+(?:is\s+)?(?:named|called)\s+({_NAME})", 1, 0.40, ["dog", "pet", "adopt"]),
    ("allergy", r"\ballergic\s+to\s+([a-z][a-z -]*[a-z])", 1, 0.40, ["allergy", "allergic"]),
    ("destination", rf"\b(?:flying|flight|travel(?:ling|ing)?)\s+to\s+({_NAME})", 1, 0.45, ["flying", "flight", "travel"]),
    ("preference", r"\bprefers?\s+([^.;\n]+)", 1, 0.35, ["status update", "written", "prefer"]),
    ("city", rf"\bmoved?\s+to\s+({_NAME})", 1, 0.45, ["city", "where", "moved"]),
    ("launch", rf"\b[Pp]ublic launch\s+(?:is|on|date is)\s+({_DATE})", 1, 0.55, ["launch", "timeline"]),
    ("owner", rf"({_NAME})\s+owns\s+", 1, 0.50, ["who", "owner", "owns"]),
    ("date", rf"({_DATE})", 1, 0.20, ["when", "date"]),
]


def relevance(query: Column, text: Column, base: Column) -> Column:
    """The item's score and the shares of the query's terms, entities, years and dates that its text has."""
    share = lambda f: tx.let(F.array_distinct(f(query)), lambda q: F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(f(text)))) / F.size(q)).otherwise(0.0))
    return base + 0.8 * share(tx.terms) + 0.9 * share(tx.entity_terms) + 0.5 * share(tx.years) + 0.5 * share(tx.date_keys)


def extract_answers(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, answer, kind. items: query_id, position, text, score."""
    joined = queries.join(items, "query_id").withColumn("text", F.trim(F.regexp_replace(tx.without_marks(F.col("text")), r"\s+", " "))).where("text <> ''")
    low = F.lower("query")
    rel = relevance(F.col("query"), F.col("text"), F.col("score"))
    found = []
    for rank, (kind, pattern, group, bonus, cues) in enumerate(PATTERNS):
        hit = F.regexp_extract("text", pattern, group)
        text = F.concat(F.lit("allergic to "), hit) if kind == "allergy" else hit
        found.append(F.when(tx.any_of(low, cues) & (hit != ""), F.struct(F.lit(rank).alias("priority"), (-F.round(rel + bonus, 6)).alias("neg"), F.col("position"), text.alias("answer"), F.lit(kind).alias("kind"))))
    sentence = tx.let(
        F.transform(sentences(F.col("text")), lambda s: F.struct((-F.size(F.array_intersect(F.array_distinct(tx.terms(F.col("query"))), F.array_distinct(tx.terms(s))))).alias("n"), s.alias("s"))), lambda a: F.array_min(a)["s"]
    )
    found.append(F.struct(F.lit(len(PATTERNS)).alias("priority"), (-F.round(rel, 6)).alias("neg"), F.col("position"), F.coalesce(sentence, F.col("text")).alias("answer"), F.lit("sentence").alias("kind")))
    best = joined.select("query_id", F.array_min(F.array_compact(F.array(*found))).alias("a")).groupBy("query_id").agg(F.min("a").alias("a"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("a.answer", F.lit("")).alias("answer"), F.coalesce("a.kind", F.lit("none")).alias("kind"))

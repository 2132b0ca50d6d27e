"""Quality rules: a threshold table compiled into one projection of built-in functions.

Nulls: a null text counts as empty: all counts are 0 and base_failed is true (fewer than 20 words). Ratios of
empty texts are 0. Texts may be of any length, an empty table gives an empty one. Rows are judged one by one, so ties and repeated rows need no rule. Other columns
are passed through untouched; an added column whose name is taken gets a trailing underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it on for was with as by at this an be are "
    "der die das und in von zu den mit ist des nicht ein eine auf "
    "le la les de des et en un une du que qui est dans pour "
    "el los las y a se no con por su del al lo"
).split()

#: (feature, comparison, threshold): a document is kept if all hold. Loose ends of what running text shows.
RULES: tuple[tuple[str, str, float], ...] = (
    ("mean_word_length", ">=", 2.0),
    ("mean_word_length", "<=", 20.0),
    ("symbol_word_ratio", "<=", 0.10),
    ("dup_line_ratio", "<=", 0.50),
    ("ellipsis_line_ratio", "<=", 0.30),
    ("stop_word_ratio", ">=", 0.02),
    ("adjacent_word_ratio", "<=", 0.30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once per row, though body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column, k: int = 8) -> Column:
    """Words inside k-word windows that occur twice or more in the array."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda p: F.transform(F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"])), lambda x: x["i"]))
        return let(F.array_sort(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))), F.lit(0), lambda a, x: a + x))

    spread = let(hashes, lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))))
    return F.when(F.size(words) < k + 1, F.lit(0)).otherwise(spread).cast("long")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of df) and the counts and ratios that RULES name."""
    t = F.coalesce(F.col("row").getField(text), F.lit(""))
    bare = F.translate(t, " \t\n\x0b\x0c\r", "")
    out = df.select(F.struct("*").alias("row")).withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != ""))
    words, lines = F.col("_words"), F.col("_lines")
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(words),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
            "n_adjacent_words": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long"),
        }
    ).drop("_words", "_lines")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumns(
        {
            "mean_word_length": ratio("word_chars", "n_words"),
            "symbol_word_ratio": ratio("n_symbols", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
            "stop_word_ratio": ratio("n_stop_words", "n_words"),
            "adjacent_word_ratio": ratio("n_adjacent_words", "n_words"),
        }
    )


def compile_rules(rules: tuple[tuple[str, str, float], ...] = RULES) -> Column:
    """One Boolean column from the table."""
    verdict = F.lit(True)
    for feature, comparison, bound in rules:
        value = F.col(feature)
        verdict = verdict & (value >= bound if comparison == ">=" else value <= bound)
    return verdict


def quality_rules(df: DataFrame, rules: tuple[tuple[str, str, float], ...] = RULES, text: str = "text") -> DataFrame:
    """df with its features, base_failed and kept."""
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    out = features(df, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    return out.select("row.*", *(F.col(c).alias(free_name(c, df.columns)) for c in out.columns[1:]))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = quality_rules(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP10_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS lines
  FROM t),
g AS (
  SELECT *, CASE WHEN len(words) < 8 THEN [] ELSE list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' ')) END AS grams FROM w),
occ AS (SELECT doc_id, t, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g),
rep AS (SELECT doc_id, t, i FROM occ QUALIFY count(*) OVER (PARTITION BY doc_id, t, gram) >= 2),
cov AS (SELECT doc_id, t, count(DISTINCT i + k) AS n FROM rep, range(0, 8) r(k) GROUP BY ALL),
f AS (
  SELECT g.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(translate(g.t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(g.t) - length(translate(g.t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS n_stop,
    len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ell,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_adj
  FROM g LEFT JOIN cov ON cov.doc_id IS NOT DISTINCT FROM g.doc_id AND cov.t = g.t),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 2.0 * n_words AND word_chars <= 20.0 * n_words AND n_symbols <= 0.10 * n_words
  AND n_dup_lines <= 0.50 * n_lines AND n_ell <= 0.30 * n_lines AND n_stop >= 0.02 * n_words AND n_adj <= 0.30 * n_words AS kept
FROM b
"""

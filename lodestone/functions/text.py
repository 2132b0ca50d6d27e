"""Row-local text functions as column expressions: terms, entities, dates, query classes and signals.

Lists of words and patterns are data; each function builds one expression from them, so Catalyst folds them for
constant queries and no Python runs per row. Letters and digits are those of Unicode (\\p{L}, \\p{N}).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide terms, entities and intents.
STOP_WORDS = ["a", "an", "and", "are", "at", "did", "do", "for", "from", "in", "is", "of", "on", "or", "the", "to", "what", "when", "where", "which", "who", "with"]
ENTITY_CUES = ["for", "about", "did", "does", "with", "from"]
NAME_FOLLOWERS = ["moved", "move", "owns", "owned", "launch", "launched"]
ENTITY_NOISE = ["city", "date", "owner", "owns", "launch", "public", "project", "beta", "deployment", "readiness", "timeline", "status", "updates", "update", "report", "checklist", "signoff", "team", "health", "allergic"]
TEMPORAL_CUES = ["when", "yesterday", "today", "last ", "recent", "latest", "before ", "after ", "between "]
FACTUAL_STARTS = ["what is", "what are", "who is", "who are"]
FACTUAL_CUES = ["define ", "definition of", "meaning of"]
SEMANTIC_CUES = ["how ", "why ", "explain", "describe", "relate"]
LOCATION_CUES = ["city", "where", "moved", "moving"]
DATE_CUES = ["date", "when", "launch", "timeline"]
OWNER_CUES = ["who", "owner", "owns", "deployment readiness"]
TENTATIVE = ["tentative", "draft", "proposed", "pending approval", "target is", "target date", "could be", "estimate"]
SEARCH_DISTRACTORS = ["weekly report", "checklist", "signoff", "allergic", "distractor", "draft memo", "tentative", "pending approval"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Fusion weights of a query class: keyword, vector, time.
CLASS_WEIGHTS = {"factual": (0.7, 0.3, 0.0), "semantic": (0.3, 0.7, 0.0), "temporal": (0.25, 0.25, 0.5), "exploratory": (0.4, 0.5, 0.1)}

WORD = r"[\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return out


def words(text: Column) -> Column:
    """Runs of letters and digits, as they are."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits: the keyword index's terms."""
    return words(F.lower(text))


def stem(token: Column) -> Column:
    """A light English stemmer with length guards."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 5), cut(3))
        .when(token.endswith("ed") & (n > 4), cut(2))
        .when(token.endswith("es") & (n > 4), cut(2))
        .when(token.endswith("s") & (n > 4), cut(1))
        .otherwise(token)
    )


def terms(text: Column) -> Column:
    """Stemmed terms without stop words (which are looked up after stemming), in order, repeats kept."""
    return F.filter(F.transform(tokens(text), stem), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def query_tokens(text: Column, limit: int = 16) -> Column:
    """Distinct index terms of a query, without stop words, limit at most; the operator's own cap on query length."""
    return F.slice(F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS) & (t != "date"))), 1, limit)


def entity_terms(text: Column) -> Column:
    """Distinct entity-like terms, sorted: words with digits, word and number pairs, names by case or by neighbouring cues."""

    def pick(ws: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            x, before, after = F.lower(w), F.lower(F.get(ws, i - 1)), F.lower(F.get(ws, i + 1))
            letters = x.rlike(r"^\p{L}+$")
            mixed = F.when(x.rlike(r"\p{L}") & x.rlike(r"\p{Nd}"), x)
            pair = F.when(letters & after.rlike(r"^\p{Nd}+$"), F.concat(x, after))
            cue = F.coalesce(before.isin(ENTITY_CUES), F.lit(False)) | F.coalesce(after.isin(NAME_FOLLOWERS), F.lit(False))
            name = F.when(letters & (F.length(x) >= 3) & ~x.isin(STOP_WORDS) & ~x.isin(ENTITY_NOISE) & (w.rlike(r"\p{Lu}") | (cue & (F.length(x) >= 4))), x)
            return F.array(mixed, pair, name)

        return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(ws, of)))))

    return let(words(text), pick)


def years(text: Column) -> Column:
    return F.array_distinct(F.filter(words(text), lambda w: w.rlike(r"^\p{Nd}{4}$")))


def date_keys(text: Column) -> Column:
    """Distinct dates named in a text, as yyyy-mm-dd, sorted; calendar dates of 1900 to 2999 only."""
    names = "|".join(MONTHS) + "|" + "|".join(m[:3] for m in MONTHS) + "|sept"
    gap = r"(?:,\s*|\s+)"
    month_first = rf"(?i)\b((?:{names})\.?\s+\d{{1,2}}{gap}\d{{4}})\b"
    day_first = rf"(?i)\b(\d{{1,2}}\s+(?:{names})\.?{gap}\d{{4}})\b"
    iso = r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b"
    number = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m[:3]), F.lit(i + 1))])
    found = lambda pattern: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
    part = lambda s, i: F.get(F.split(F.trim(F.regexp_replace(s, r"[,.\s]+", " ")), " "), i)
    month_of = lambda s: F.try_element_at(number, F.lower(F.substring(s, 1, 3)))

    def key(y: Column, m: Column, d: Column) -> Column:
        y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
        return F.when(y.between(1900, 2999), F.date_format(F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)), "yyyy-MM-dd"))

    isos = F.transform(found(iso), lambda s: key(*[F.get(F.split(s, "[-/.]"), i) for i in range(3)]))
    firsts = F.transform(found(month_first), lambda s: key(part(s, 2), month_of(part(s, 0)), part(s, 1)))
    days = F.transform(found(day_first), lambda s: key(part(s, 2), month_of(part(s, 1)), part(s, 0)))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(isos, firsts, days))))


def query_class(query: Column) -> Column:
    q = F.lower(query)
    starts = F.lit(False)
    for s in FACTUAL_STARTS:
        starts = starts | q.startswith(s)
    return F.when(any_of(q, TEMPORAL_CUES), "temporal").when(starts | any_of(q, FACTUAL_CUES), "factual").when(any_of(q, SEMANTIC_CUES), "semantic").otherwise("exploratory")


def class_weight(kind: Column, lane: int) -> Column:
    """The weight of a lane (0 keyword, 1 vector, 2 time) for a query class."""
    out = F.lit(CLASS_WEIGHTS["exploratory"][lane])
    for name in ("factual", "semantic", "temporal"):
        out = F.when(kind == name, F.lit(CLASS_WEIGHTS[name][lane])).otherwise(out)
    return out


def intents(query: Column) -> Column:
    """Sorted names of a query's intents: date, location, multi_hop, ownership."""
    q = F.lower(query)
    t = terms(query)
    location = any_of(q, LOCATION_CUES) | F.array_contains(t, "move") | F.array_contains(t, "mov")
    date, owner = any_of(q, DATE_CUES), any_of(q, OWNER_CUES)
    several = (location.cast("int") + date.cast("int") + owner.cast("int")) > 1
    return F.array_compact(F.array(F.when(date, "date"), F.when(location, "location"), F.when(q.contains(" and ") & several, "multi_hop"), F.when(owner, "ownership")))


def specificity(query: Column) -> Column:
    """0 to 1: how exact a query is, from its length, its numbers and names, and its quotes."""
    parts = F.filter(F.split(query, r"[\s\p{P}]+"), lambda w: w != "")
    entity = query.rlike(r"\p{Nd}") | F.exists(parts, lambda w: w.rlike(r"^\p{Lu}"))
    score = F.least(F.size(parts) / F.lit(8.0), F.lit(0.4)) + F.when(entity, 0.35).otherwise(0.0) + F.when(query.contains('"'), 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def quoted_phrases(query: Column, limit: int = 4) -> Column:
    """Texts in double or single quotes with a letter or digit, in order, distinct without regard to case."""
    found = F.regexp_extract_all(query, F.lit(r"\"([^\"]+)\"|'([^']+)'"), 0)
    bare = F.filter(F.transform(found, lambda s: F.trim(F.substring(s, F.lit(2), F.length(s) - 2))), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    lows = let(bare, lambda b: F.filter(b, lambda s, i: ~F.exists(F.slice(b, 1, i), lambda o: F.lower(o) == F.lower(s))))
    return F.slice(lows, 1, limit)


def phrase_terms(query: Column, limit: int = 4, words_each: int = 8) -> Column:
    """Quoted phrases as index terms joined by spaces, distinct; phrases of stop words only go."""
    joined = F.transform(quoted_phrases(query, limit), lambda p: F.array_join(query_tokens(p, words_each), " "))
    return F.array_distinct(F.filter(joined, lambda p: p != ""))


def comparable(text: Column) -> Column:
    """Lower case, everything that is no letter or digit a single space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def without_marks(text: Column) -> Column:
    """A snippet without its highlighting brackets."""
    return F.translate(text, "[]", "")


def token_estimate(text: Column) -> Column:
    """A token count without a vocabulary: a token for each four bytes, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def code_tokens(text: Column) -> Column:
    """White-space words and each operator character."""
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) + F.length(text) - F.length(F.regexp_replace(text, r"[{}()\[\];,.<>+\-*/=&|!?:]", ""))).cast("long")


def byte_preview(text: Column, limit: int) -> Column:
    """The first limit bytes; null where the cut splits a character."""
    return F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))


def byte_cap(text: Column, limit: int) -> Column:
    """The first limit bytes of a text, less the character that the cut splits."""
    cut = lambda n: F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*[cut(limit - i) for i in range(min(4, limit + 1))], F.lit("")))


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def minute_second(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def valid_identifier(name: Column, namespaced: bool = False) -> Column:
    """Letters, digits and ._:- , 256 bytes at most; entity keys are ns:id."""
    ok = name.rlike(r"^[A-Za-z0-9._:-]+$") & (F.octet_length(name) <= 256)
    return ok & name.rlike(r"^[^:]+:.+$") if namespaced else ok


def literal_kind(text: Column) -> Column:
    """The type a literal is read as: int, double, bool or string."""
    return F.when(text.try_cast("bigint").isNotNull(), "int").when(text.try_cast("double").isNotNull(), "double").when(F.lower(text).isin("true", "false"), "bool").otherwise("string")


def literal_value(text: Column) -> Column:
    """kind and the typed value (whole, real, truth, string; the others null) of a literal."""
    kind = literal_kind(text)
    pick = lambda name, value: F.when(kind == name, value)
    return F.struct(kind.alias("kind"), pick("int", text.try_cast("bigint")).alias("whole"), pick("double", text.try_cast("double")).alias("real"), pick("bool", F.lower(text) == "true").alias("truth"), pick("string", text).alias("string"))


def literal_text(value: Column) -> Column:
    """A typed value as text again."""
    return F.coalesce(value["whole"].cast("string"), value["real"].cast("string"), value["truth"].cast("string"), value["string"])


def metadata_of(json: Column) -> Column:
    """A JSON object of scalars as a string map; null where it is none."""
    return F.from_json(json, "map<string,string>")


def wants_full_text(query: Column, preview: Column, full: Column, most_bytes: int = 4096) -> Column:
    """The full text instead of a preview for queries about a date, place or owner, if it is short enough."""
    pointed = F.size(F.array_intersect(intents(query), F.array(F.lit("date"), F.lit("location"), F.lit("ownership")))) > 0
    return F.when(pointed & (F.octet_length(full) <= most_bytes), full).otherwise(preview)


def cue_tags(text: Column, limit: int = 8) -> Column:
    """The most frequent longer terms of a text, by count then spelling: plain tags where no model gives any."""
    known = F.filter(terms(text), lambda t: F.length(t) > 3)
    counted = let(known, lambda k: F.transform(F.array_distinct(k), lambda t: F.struct((-F.size(F.filter(k, lambda x: x == t))).alias("n"), t.alias("t"))))
    return F.transform(F.slice(F.array_sort(counted), 1, limit), lambda x: x["t"])

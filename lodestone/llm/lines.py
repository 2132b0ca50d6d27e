r"""Line dedup: lines that repeat an earlier line, or differ from one by a few edits, are dropped.

Lines are cut at \n; all but blank ones (nothing but ASCII white space) take part, blank ones always stay. Lines under
NEAR_LEAST code points are compared for equality only. The order of lines is doc_id, text hash, place in the text. A line goes if an earlier line of the input equals it or lies within
the edit distance, whether or not that earlier line stays. The distance grows with the shorter line's length: one edit
for each STEP code points, 1 at least and THRESHOLD at most.

A segment-partition join finds near lines. Lines within t edits are cut into t + 1 segments of the width of their length
class, half of them counted from the line's start and half from its end. Of two lines within t edits, either the starts
differ by fewer edits than they have segments or the ends do, so some segment i (from 0) of the shorter line is whole in
the longer one and shifted by i places at most, either way. Without its last i characters, what starts at the same place of the
line that is shifted back lies in both: so each line probes with shifts 0 to i only, whatever its own
length, m * (m + 1) / 2 substrings for m segments. A line within THRESHOLD of a shorter class probes that class too.

1. Keys (64-bit hashes of segments) that two different lines share, and whole lines that occur twice, are found by one
   aggregation of (key, least and largest value), without texts, and marked in a bitmap of fixed size (a false positive only costs time).
2. A second scan lists the lines with a marked key, still without texts: lines are known by 128 bits of hash, and by
   the place of their first occurrence. A third one fetches the text of each line that shares a key, once.
3. Each line is compared with the earliest line of each of its keys, once per pair of lines: by counts of some characters, of
   which an edit changes two at most, then by banded edit distance (levenshtein with a limit).
4. Lines not yet found to repeat, and only those, are compared with all earlier lines of their keys, inside a join
   condition. Members of a key that lie within t of its leader are left out for lines beyond 2 t of it (triangle
   inequality), so a family of variants of one line is not compared pair by pair.

Built-in functions only. Nulls: a null text has no lines and stays null; an empty one has one blank line; a null doc_id sorts
first. Texts and lines may be of any length. Rows with equal doc_id and text are one document in the order of lines, and get the same result. An
empty table gives an empty one. Other columns are passed through untouched; an added column whose name is taken gets a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, free_name, materialize

THRESHOLD = 5
STEP = 32
NEAR_LEAST = 30
FILTER_BITS = 25
#: Characters whose counts are compared before an edit distance is worked out.
COUNTED = " etaoinshrdlucm."


def _edits(length: Column, t: int) -> Column:
    """Edits that two lines may differ by, the shorter of which has length code points; t at most."""
    return F.when(length < NEAR_LEAST, 0).otherwise(F.least(F.lit(t), F.greatest(F.lit(1), F.floor(length / STEP).cast("int"))))


def _base(length: Column, t: int) -> Column:
    """The least length of a line's class: a class for each distance, and beyond the last one for each doubling."""
    top, edits = max(NEAR_LEAST, STEP * t), _edits(length, t)
    doubled = F.call_function("shiftleft", F.lit(top), F.floor(F.log2(F.floor(length / top).cast("double"))).cast("int"))
    return F.when(length >= top, doubled).otherwise(F.greatest(F.lit(NEAR_LEAST), edits * STEP)).cast("int")


def _places(t: int) -> list[int]:
    """Side, segment and shift, as one number, of the substrings that a line probes: segments from the start, then from the end."""
    left = (t + 2) // 2
    return [(side * 64 + i) * 64 + shift for side, m in ((0, left), (1, t + 1 - left)) for i in range(m) for shift in range(i + 1)]


def _keyed(lines: DataFrame, t: int) -> DataFrame:
    """lines, a row for each index and probe key: an index key is a probe without shift. The line's own hash h is a key, too, with place -1."""
    size, base, width, edits = F.col("size"), F.col("base"), F.col("width"), F.col("edits")
    own, shorter = _base(size, t), _base(size - t, t)
    none = F.lit(0)
    bases = F.when(size < NEAR_LEAST, F.array(none)).when((size - t < NEAR_LEAST) | (own == shorter), F.array(own, none)).otherwise(F.array(own, shorter, none))
    out = lines.withColumn("base", F.explode(bases))
    out = out.withColumn("edits", _edits(base, t)).withColumn("width", F.floor(base / (edits + 1)).cast("int"))
    # The line's start and end, as far as its segments reach (a built-in that cuts goes through the whole string each time).
    # Lines of ASCII are cut as bytes, without going through them: equal segments of either kind have equal bytes, and so equal hashes.
    out = out.withColumn("reach", width * F.shiftright(edits + 2, 1)).withColumn("plain", F.octet_length("line") == size)
    ends = {"head": F.lit(1), "tail": size - F.col("reach") + 1}
    for name, at in ends.items():
        out = out.withColumn(name, F.when((base > 0) & ~F.col("plain"), F.substring("line", at, F.col("reach"))))
        out = out.withColumn(f"{name}_bytes", F.when((base > 0) & F.col("plain"), F.substring(F.col("line").cast("binary"), at, F.col("reach"))))
    places = F.array(F.lit(-1))
    for k in range(1, t + 1):
        places = F.when(edits == k, F.array(*[F.lit(x) for x in _places(k)])).otherwise(places)
    x = F.col("place")
    out = out.withColumn("place", F.explode(places))
    i, shift = F.shiftright(x, 6).bitwiseAND(63), x.bitwiseAND(63)
    # The substring, shifted, ends within the class's least length, so it lies in the line.
    at = {"head": width * i + shift + 1, "tail": F.col("reach") - width * (i + 1) + i - shift + 1}
    hashed = lambda end: F.xxhash64(F.shiftright(x, 6), base, F.substring(end, at[end[:4]], width - i))
    return out.withColumn(
        "key", F.when(x < 0, F.col("h")).when(F.col("plain"), F.when(x < 4096, hashed("head_bytes")).otherwise(hashed("tail_bytes"))).otherwise(F.when(x < 4096, hashed("head")).otherwise(hashed("tail")))
    )


def _lines(docs: DataFrame) -> DataFrame:
    """dk, th, pos, line, size and the two halves h, g of its hash, of the lines that take part."""
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    slim = slim.where(F.ltrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")
    return slim.withColumns({"size": F.length("line"), "h": F.xxhash64(F.lit(1), "line"), "g": F.xxhash64(F.lit(2), "line")})


def _bitmap(keys: DataFrame) -> Column:
    """A bitmap of 2**FILTER_BITS bits over a column key: one array of 64-bit words, as a scalar subquery."""
    spark = keys.sparkSession
    words = keys.select(_word(F.col("key")).cast("long").alias("w"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))
    every = spark.range(1 << (FILTER_BITS - 6)).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    packed = every.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("l"))  # as many rows as the bitmap has words
    return materialize(packed.select(F.transform("l", lambda x: x["bits"]).alias("words"))).scalar()


def _word(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - FILTER_BITS + 6).cast("int")


def _hit(bitmap: Column, key: Column) -> Column:
    bit = F.call_function("shiftrightunsigned", F.get(bitmap, _word(key)), key.bitwiseAND(63).cast("int"))
    return key.isNotNull() & (bit.bitwiseAND(1) == 1)


def _counts(line: Column) -> Column:
    """How often a line has each of COUNTED."""
    return F.array(*[F.octet_length(line) - F.octet_length(F.call_function("replace", line, F.lit(c), F.lit(""))) for c in COUNTED])


def _apart(a: Column, b: Column) -> Column:
    """The sum of differences of two lines' counts: an edit changes it by two at most."""
    one, two = (lambda i: F.get(a, F.lit(i))), (lambda i: F.get(b, F.lit(i)))
    return sum((F.abs(one(i) - two(i)) for i in range(1, len(COUNTED))), F.abs(one(0) - two(0)))


def repeated_lines(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """dk, th, pos of the lines that go."""
    at, who = F.struct("dk", "th", "pos"), ["h", "g"]
    keyed = _keyed(_lines(docs), t)
    value = F.when(F.col("place") < 0, F.hash("dk", "th", "pos")).otherwise(F.shiftright("g", 32).cast("int"))
    shared = keyed.select("key", value.alias("v")).groupBy("key").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b")
    marked = _bitmap(shared)
    once = keyed.withColumn("key", F.explode(F.array("key")))  # a filter on an expression would work it out for each mention
    found = materialize(once.where(_hit(marked, F.col("key"))).select("dk", "th", "pos", "size", "h", "g", "key"))
    # Exact repeats.
    same = found.where("key = h")
    firsts = same.groupBy(*who).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    exact = same.join(firsts, who).where("struct(dk, th, pos) <> first").select("dk", "th", "pos")
    # Distinct lines of each key, and the earliest of them.
    members = found.where("key <> h").groupBy("key", "size", *who).agg(F.min(at).alias("at"))
    members = materialize(members)
    leaders = members.groupBy("key").agg(F.min(F.struct("at", "h", "g", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    led = materialize(members.join(leaders, "key").select("key", "size", "at", "n", *who, F.col("lead.h").alias("lh"), F.col("lead.g").alias("lg"), (F.abs(F.col("size") - F.col("lead.size")) <= 2 * t).alias("close")))
    # The text of each of these lines, from its first occurrence.
    wanted = led.select("at.*", *who).distinct()
    places = _bitmap(wanted.select(F.xxhash64("dk", "th", "pos").alias("key")))
    texts = _lines(docs).where((F.col("size") >= NEAR_LEAST) & _hit(places, F.xxhash64("dk", "th", "pos"))).select("dk", "th", "pos", "line")
    texts = materialize(texts.join(wanted, ["dk", "th", "pos"]).groupBy(*who).agg(F.first("line").alias("line")).withColumn("counts", _counts(F.col("line"))))
    # Lines against their leaders.
    limit = lambda a, b: _edits(F.least(F.length(a), F.length(b)), t)
    asked = led.where("close and (h <> lh or g <> lg)").select(*who, "lh", "lg").distinct()
    lead_texts = texts.select(F.col("h").alias("lh"), F.col("g").alias("lg"), F.col("line").alias("lead"), F.col("counts").alias("lead_counts"))
    judged = asked.join(texts, who).join(lead_texts, ["lh", "lg"])
    apart = _apart(F.col("counts"), F.col("lead_counts"))
    edits = F.when(apart <= 2 * limit(F.col("line"), F.col("lead")), F.levenshtein("line", "lead", t)).otherwise(-1)
    judged = judged.select(*who, "lh", "lg", edits.alias("edits"), limit(F.col("line"), F.col("lead")).alias("limit"), (apart > 4 * t).alias("far"))
    judged = materialize(judged).select(*who, "lh", "lg", F.col("edits").between(0, F.col("limit")).alias("dup"), "far")
    done = judged.where("dup").select(*who).distinct()
    # The others against all earlier lines of keys with three members or more.
    rest = led.where("n > 2 and (h <> lh or g <> lg)")
    open_ = rest.join(done, who, "left_anti")
    asking = open_.select("key").distinct()
    flags = rest.join(asking, "key", "left_semi").join(judged, [*who, "lh", "lg"], "left").select("key", "size", "at", *who, F.coalesce("dup", F.lit(False)).alias("dup"), F.coalesce("far", F.lit(True)).alias("far"))
    flags = materialize(flags)
    every_key = flags.groupBy(*who).agg(F.collect_set("key").alias("keys"))  # a line has no more than two classes' keys
    flags = materialize(flags.join(texts.join(every_key, who), who))
    a, b = flags.join(done, who, "left_anti").alias("a"), flags.alias("b")
    meets = (F.col("a.key") == F.col("b.key")) & (F.col("b.at") < F.col("a.at")) & (F.abs(F.col("a.size") - F.col("b.size")) <= t)
    one, two = F.col("a.line"), F.col("b.line")
    meets = meets & ~(F.col("a.far") & F.col("b.dup")) & (_apart(F.col("a.counts"), F.col("b.counts")) <= 2 * limit(one, two))
    # Once per pair, at the least key that both have.
    meets = meets & (F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key"))
    meets = meets & (F.levenshtein(one, two, t).bitwiseAND(255) <= limit(one, two))  # beyond t it is -1
    late = a.join(b, meets, "left_semi").select(*who).distinct()
    gone = done.unionByName(late).distinct()
    out = found.select("dk", "th", "pos", *who).join(gone, who, "left_semi").select("dk", "th", "pos")
    return out.unionByName(exact).distinct()


def without_repeats(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """row (all columns of docs), kept (the text that stays), n_lines and n_dropped for each row of docs."""
    drops = repeated_lines(docs, t).groupBy("dk", "th").agg(F.collect_set("pos").alias("drop"))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("dk"), F.xxhash64("text").alias("th"))
    out = keyed.join(drops, ["dk", "th"], "left")
    text = F.col("row.text")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("drop", i))
    n = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long")
    return out.select("row", F.when(F.col("drop").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept"), n.alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def with_text(columns: list[str], text: Column) -> list[Column]:
    """The fields of row, with another text."""
    return [text.alias(c) if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in columns]


def dedup_lines(docs: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """docs with text replaced by what stays, and n_lines, n_dropped."""
    out = without_repeats(docs, t)
    return out.select(*with_text(docs.columns, F.col("kept")), F.col("n_lines").alias(free_name("n_lines", docs.columns)), F.col("n_dropped").alias(free_name("n_dropped", docs.columns)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))

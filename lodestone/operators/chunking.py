"""Chunkers, ingest and the code-chunk manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.hashing import fnv_hex

#: Languages by file extension.
LANGUAGES = {"h": "cpp", "hpp": "cpp", "cpp": "cpp", "cc": "cpp", "c": "c", "cs": "csharp", "py": "python", "swift": "swift", "js": "javascript", "ts": "typescript", "json": "json", "ini": "ini", "md": "markdown", "txt": "text"}


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_chunks(frames: DataFrame, target: int, overlap: int, text: str = "search_text", key: str = "frame_id") -> DataFrame:
    """key, chunk_index, chunk_count, text: windows of target words that step back by overlap (none if it reaches target)."""
    step = max(1, target - overlap) if overlap < target else target

    def windows(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - target) / F.lit(float(step))).cast("int"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(target)), " "))).otherwise(F.array().cast("array<string>"))

    cut = frames.select(key, let(words(F.col(text)), windows).alias("_c"))
    return cut.select(key, F.size("_c").alias("chunk_count"), F.posexplode("_c").alias("chunk_index", "text")).select(key, "chunk_index", "chunk_count", "text")


def remember(documents: DataFrame, target: int = 120, overlap: int = 16) -> DataFrame:
    """Document frames and their chunk frames, linked by parent_id; ids of chunks continue after the largest document id."""
    chunks = word_chunks(documents, target, overlap)
    top = documents.agg(F.max("frame_id").alias("_top"))
    sized = chunks.join(documents.select("frame_id", "timestamp_ms", "kind", "metadata"), "frame_id")
    # ids: the chunk's place among all chunks, from per-document offsets
    counts = chunks.groupBy("frame_id").agg(F.max("chunk_count").alias("n"))
    offset = counts.withColumn("_off", F.sum("n").over(Window.orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)))  # a row per document, numbers only
    out = sized.join(offset.select("frame_id", F.coalesce("_off", F.lit(0)).alias("_off")), "frame_id").crossJoin(F.broadcast(top))
    chunk_frames = out.select((F.col("_top") + 1 + F.col("_off") + F.col("chunk_index")).alias("frame_id"), "timestamp_ms", "kind", F.lit("chunk").alias("role"), F.col("frame_id").alias("parent_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_count").cast("long").alias("chunk_count"), F.col("text").alias("search_text"), "metadata")
    docs = documents.select("frame_id", "timestamp_ms", "kind", F.lit("document").alias("role"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("long").alias("chunk_index"), F.lit(None).cast("long").alias("chunk_count"), "search_text", "metadata")
    return docs.unionByName(chunk_frames)


def line_windows(text: str, target: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text): lines filled up to target tokens, stepping back by up to overlap tokens, always forward."""
    lines = text.split("\n")
    cost = [max(1, -(-len(x.encode()) // 4)) for x in lines]
    at = 0
    while at < len(lines):
        end, total = at, 0
        while end < len(lines) and (end == at or total + cost[end] <= target):
            total += cost[end]
            end += 1
        yield at + 1, end, "\n".join(lines[at:end])
        if end >= len(lines):
            return
        back, spent = end, 0
        while back - 1 > at and spent + cost[back - 1] <= overlap:
            back -= 1
            spent += cost[back]
        at = back


def line_chunks(files: DataFrame, target: int, overlap: int, key: str = "frame_id", text: str = "search_text") -> DataFrame:
    """key, chunk_index, line_start, line_end, text."""

    @F.pandas_udf("array<struct<line_start: int, line_end: int, text: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"line_start": a, "line_end": b, "text": x} for a, b, x in line_windows(t or "", target, overlap) if x.strip()])

    return files.select(key, F.posexplode(cut(F.col(text))).alias("chunk_index", "_c")).select(key, "chunk_index", "_c.*")


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("unknown"))


def symbol_of(text: Column) -> Column:
    """The first class, struct, enum, function or definition that a chunk names."""
    return F.regexp_extract(text, r"(?m)\b(?:class|struct|enum(?:\s+class)?|def|func|function|namespace)\s+(?:[A-Z]+_API\s+)?([A-Za-z_]\w*)", 1)


def manifest(files: DataFrame, target: int = 200, overlap: int = 20) -> DataFrame:
    """files (path, text) as chunk records, in path order: chunk_id, path, language, symbol, lines, tokens, hash, bytes."""
    got = line_chunks(files.select("path", "text"), target, overlap, "path", "text")
    out = got.select(
        fnv_hex(F.concat_ws("|", "path", "line_start", "line_end")).alias("chunk_id"), "path", language_of(F.col("path")).alias("language"), symbol_of(F.col("text")).alias("symbol"), "line_start", "line_end",
        F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 4)).cast("long").alias("token_estimate"), fnv_hex("text").alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), "text",
    )
    return out.orderBy(F.lower("path"), "path", "line_start", "line_end", "chunk_id")


def digest_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """path, change of digest tables (path, size, hash): added, changed, removed or same."""
    a, b = previous.select("path", F.col("size").alias("_s"), F.col("hash").alias("_h")), current.select("path", "size", "hash")
    change = F.when(F.col("_h").isNull(), "added").when(F.col("hash").isNull(), "removed").when((F.col("_h") == F.col("hash")) & (F.col("_s") == F.col("size")), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


#: Macros whose specifiers are facts.
MACROS = ("UCLASS", "USTRUCT", "UENUM", "UPROPERTY", "UFUNCTION")


def code_facts(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, subject, predicate, object: types, bases, includes and macro specifiers that a chunk of C++ declares."""
    t = F.col(text)
    found = lambda pattern, *names: F.regexp_extract_all(t, F.lit(pattern), 0)
    part = lambda s, pattern, i: F.regexp_extract(s, pattern, i)
    fact = lambda s, p, o: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"))
    decl = r"\b(class|struct|enum)\s+(?:class\s+)?(?:[A-Z]+_API\s+)?([A-Za-z_]\w*)"
    base = decl + r"\s*(?:final\s*)?:\s*(?:public|protected|private)\s+([A-Za-z_]\w*)"
    macro = r"\b(" + "|".join(MACROS) + r")\(([^)]*)\)\s*(?:class\s+|struct\s+|enum\s+)?(?:[\w:<>*&]+\s+)*?([A-Za-z_]\w*)\s*[;(:{=]"
    out = F.concat(
        F.transform(found(decl), lambda s: fact(part(s, decl, 2), F.lit("declared_as"), part(s, decl, 1))),
        F.transform(found(base), lambda s: fact(part(s, base, 2), F.lit("inherits"), part(s, base, 3))),
        F.transform(found(r'#include\s+["<]([^">]+)[">]'), lambda s: fact(F.lit(""), F.lit("includes"), part(s, r'["<]([^">]+)[">]', 1))),
        F.flatten(F.transform(found(macro), lambda s: F.transform(F.filter(F.transform(F.split(part(s, macro, 2), ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: fact(part(s, macro, 3), F.concat(F.lower(part(s, macro, 1)), F.lit(".specifier")), x)))),
    )
    return chunks.select(key, F.inline(F.array_distinct(out)))


def useless_chunk() -> Column:
    """Chunks of generated ids and nothing else."""
    return F.trim(F.coalesce("text", F.lit(""))).rlike(r"^[0-9A-Fa-f-]{32,36}$") | (F.length(F.trim(F.coalesce("text", F.lit("")))) < 3)


def parsed_triples(answers: DataFrame, key: str = "chunk_id", text: str = "answer") -> DataFrame:
    """key, subject, predicate, object of answers that hold a JSON array of triples; ids and bare numbers as subjects are refused."""
    body = F.regexp_extract(F.col(text), r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<struct<subject: string, predicate: string, object: string>>")
    got = answers.select(key, F.inline(F.coalesce(rows, F.array().cast("array<struct<subject: string, predicate: string, object: string>>"))))
    good = F.lit(True)
    for part in ("subject", "predicate", "object"):
        good = good & (F.trim(F.coalesce(F.col(part), F.lit(""))) != "")
    return got.where(good & ~F.col("subject").rlike(r"^([0-9A-Fa-f]{32}|[0-9A-Fa-f-]{36}|[0-9]+)$")).distinct()


def regions(boxes: DataFrame, least: float = 0.02, limit: int = 8) -> DataFrame:
    """photo_id, x, y, w, h, position of boxes (photo_id, x, y, w, h, confidence) that are large enough, surest first, limit per photo."""
    w = Window.partitionBy("photo_id").orderBy(F.desc("confidence"), F.desc(F.col("w") * F.col("h")), "x", "y")
    return boxes.where(F.col("w") * F.col("h") >= least).withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)

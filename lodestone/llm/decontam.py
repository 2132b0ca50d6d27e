r"""Benchmark decontamination: one Aho-Corasick automaton over normalised item windows, one scan of each text.

Texts and items are lower-cased (A-Z) and cut into words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+. A window is 10
consecutive item words (an item of fewer, but not none, is one window). A document word inside any occurrence of
a window is hit; its place in the original text is kept.

The automaton holds items of up to MAX_BYTES of text; a larger benchmark is cut into such blocks of
whole items, each with an automaton and a pass of its own over what the one before wrote. One block is read, broadcast and held at a time, so
neither the driver nor what is sent grows with the benchmark (one longer item is a block).

Nulls: a null or empty text or item has no words; texts may be of any length; empty tables give empty results, or no hits. A null item_id never counts as an item, but its windows hit. Repeated
items count once per item_id, repeated documents are judged row by row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_held, give_back, materialize

WINDOW = 10
#: Normalised item bytes that one automaton holds.
MAX_BYTES = 4 << 20
#: Bytes of a normalised text: a word's bytes, everything else a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words in a text that has not been lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def build(items: list[tuple[object, str]], window: int = WINDOW):
    """The automaton: each pattern's value is (its words, its bytes, the items that have it)."""
    import ahocorasick

    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text or "")
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", (size, set()))[1].add(item)
    automaton = ahocorasick.Automaton()
    for pattern, (size, ids) in found.items():
        automaton.add_word(pattern.decode("latin-1"), (size, len(pattern), tuple(ids)))
    if found:
        automaton.make_automaton()
    return automaton if found else None


def scan(automaton, text: str) -> tuple[int, np.ndarray, set]:
    """Words of the text, which of them are hit, and the items found."""
    words = words_of(text)
    hit, found = np.zeros(len(words) + 1, np.int32), set()
    if automaton is not None and words:
        line = b" " + b" ".join(words) + b" "
        starts = None
        for end, (size, length, items) in automaton.iter(line.decode("latin-1")):
            if starts is None:
                starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            first = int(np.searchsorted(starts, end - length + 1))
            hit[first] += 1
            hit[first + size] -= 1
            found.update(items)
    return len(words), np.cumsum(hit[:-1]) > 0, found


def spans(text: str, hit: np.ndarray) -> list[dict]:
    """[start, end) of each run of hit words in the original text, in code points."""
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if hit[i]:
            if last == i - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Whole items in blocks of at most MAX_BYTES (one longer item is a block)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len((row["t"] or "").encode("utf-8"))
        if block and size + n > MAX_BYTES:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    yield block


def _one_by_one(spark: SparkSession, benchmark: DataFrame, item_id: str) -> Iterator[tuple[object, bool]]:
    """Each block, broadcast, and whether it is the last; the one before is given up when the next is asked for."""
    blocks = _blocks(benchmark, item_id, "text")
    block, sent = next(blocks), None
    while block is not None:
        following = next(blocks, None)
        if sent is not None:
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)
        yield sent, following is None
        block = following


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", item_id: str = "item_id", with_spans: bool = True) -> DataFrame:
    """key, n_words, n_hit, items (sorted as strings), spans of hit words in the original text."""
    shape = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    middle = pa.schema([("key", pa.int64()), ("text", pa.string()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])
    df = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("items"))

    def pass_over(sent, last: bool):
        made: list = []

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_held()
            if not made:
                made.append(build(sent.value, window))
            for batch in batches:
                out: list[tuple] = []
                for k, body, hits, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    n, hit, found = scan(made[0], body or "")
                    names = {str(x) for x in found if x is not None} | set(items or ())
                    if hits is not None:
                        hit = hit | np.unpackbits(np.frombuffer(hits, np.uint8))[:n].astype(bool)
                    n_hit = int(hit.sum())
                    if last:
                        out.append((k, n, n_hit, sorted(names), spans(body or "", hit) if n_hit and with_spans else []))
                    else:
                        out.append((k, body, np.packbits(hit).tobytes() if n_hit else hits, sorted(names)))
                to = shape if last else middle
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * len(to), to.types, strict=True)], schema=to)
            give_back()

        return run

    for sent, last in _one_by_one(docs.sparkSession, benchmark, item_id):
        if last:
            df = df.mapInArrow(pass_over(sent, last), "key long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>")
        else:
            df = materialize(df.mapInArrow(pass_over(sent, last), "key long, text string, hits binary, items array<string>"))
    return df.withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs, all columns untouched, without the rows that have a hit word."""
    at = docs.columns.index(text)

    def pass_over(sent):
        made: list = []

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop_held()
            if not made:
                made.append(build(sent.value, window))
            for batch in batches:
                yield batch.filter(pa.array([not scan(made[0], body.as_py() or "")[1].any() for body in batch.column(at)], pa.bool_()))
            give_back()

        return run

    df = docs
    for sent, last in _one_by_one(docs.sparkSession, benchmark, "item_id"):
        df = df.mapInArrow(pass_over(sent), docs.schema)
        df = df if last else materialize(df)
    return df


def op2_aho_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.col("items")
    return out.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))



OP2_SQL = r"""
WITH
low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT k FROM win),
spot AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM low, sizes WHERE len(w) >= k),
hits AS (SELECT a.doc_id, a.i, a.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM spot) a JOIN win ON win.k = a.k AND win.g = a.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

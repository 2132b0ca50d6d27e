"""Helpers shared by the training-data operators: shared-folder tables, hashing kernels, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = b" \t\n\x0b\x0c\r"
#: Lower-cases A-Z only; bytes.split() then cuts at exactly SPACE.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that one kernel call handles at most (a longer document is one call).
CHUNK = 1 << 20

_own_root: list[str] = []
_steady: list[bool] = []


def steady_heap() -> None:
    """Fixes the size from which a worker's C library maps arrays and gives them back at once; without one that can, nothing happens.

    Left to itself the library lets the size grow with what was freed. Too small a one costs more than the kernels
    themselves, as each array's pages are then cleared anew: 16 MiB keeps the arrays of a CHUNK of text on the heap.
    """
    if not _steady:
        _steady.append(True)
        try:
            libc = ctypes.CDLL(None)
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        except (AttributeError, OSError):
            pass


def give_back() -> None:
    """Gives memory that a worker no longer uses back to the machine: idle workers live on for a minute beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_held: dict[str, dict] = {}


def held(operator: str) -> dict:
    """What an operator's tasks keep in a worker for its later tasks; tasks of other operators drop it."""
    return _held.setdefault(operator, {})


def drop_held() -> None:
    """Called by a task that keeps nothing: workers are used again by other stages, whose tables would stay beside its own."""
    tables = [x for x in _held.values() if x]
    for x in tables:
        x.clear()
    if tables:
        give_back()


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests, local mode)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="lodestone-"))
        atexit.register(shutil.rmtree, _own_root[0], True)
    return _own_root[0]


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many trailing underscores as it takes to be none of taken (Spark's names have no case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lodestone/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, name: str = "text", chunk: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Slices a batch's string column: (first row, last row + 1, bytes, offsets of rows in them); null is empty."""
    steady_heap()
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_string() if pa.types.is_string(col.type) or pa.types.is_string_view(col.type) else pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    data = memoryview(col.buffers()[2] or b"")
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, bytes(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]
        lo = hi


# ---- 64-bit hashing, vectorised; seeded, so every executor has the same tables ----

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(4096, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
with np.errstate(over="ignore"):
    for _i in range(1, len(_POW)):
        _POW[_i] = _POW[_i - 1] * np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of some documents, and each document's first word (length rows + 1)."""
    raw = np.frombuffer(data.translate(LOWER), np.uint8)
    rows = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = ~_IS_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    begin[inner] = word[inner]  # a document's first byte never continues the word before it
    at = np.flatnonzero(word)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    first = np.searchsorted(at, starts)
    which = np.cumsum(begin[at]) - 1
    place = at - starts[which]
    long = place >= len(_POW)
    value = _BYTE[raw[at]] * _POW[np.where(long, place % len(_POW), place)]
    if long.any():
        value = np.where(long, mix(value + _STEP * (place // len(_POW)).astype(np.uint64)), value)
    total = np.add.reduceat(value, first)
    size = np.diff(np.append(first, len(at))).astype(np.uint64)
    return mix(total + size * _STEP), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles document by document; fewer words give one shingle, no words none. Starts as in word_hashes."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(starts[-1]), np.uint64)
    if not len(out):
        return out, starts
    doc = np.repeat(np.arange(len(n)), count)
    base = first[:-1][doc] + (np.arange(len(out)) - starts[:-1][doc])
    last = first[1:][doc]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        w = padded[base + j]
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(base + j < last, w, np.uint64(0)) + np.uint64(j + 1))
    return out, starts


def distinct_sorted(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts and deduplicates each segment."""
    values = values.copy()
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[starts[:-1][starts[:-1] < len(values)]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


# ---- connected components ----


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): the smallest vertex reachable, for each vertex of edges; min-label steps with pointer jumping.

    Each round is written to the shared folder. Labels are aggregated with map-side combining, and
    a hub's many edges only meet in sort-merge joins, whose large partitions Spark splits.
    """
    pairs = materialize(edges.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t").distinct())
    both = pairs.unionByName(pairs.select(F.col("t").alias("s"), F.col("s").alias("t")))
    labels = materialize(both.groupBy(F.col("s").alias("v")).agg(F.min("t").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(labels, both.t == labels.v).groupBy("s").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.v == near.s, "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c"))
        to = labels.select(F.col("v").alias("u"), F.col("c").alias("up"))
        new = materialize(step.join(to, step.c == to.u, "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c")))
        changed = new.where("c <> old").limit(1).count()
        labels = new.select("v", "c")
        if not changed:
            return labels


# ---- a filter of fixed size ----


def bit_map(places: DataFrame, bits: int):
    """A broadcast bitmap of 2**bits bits (64-bit words) over a column place: its size never depends on the data."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = places.select(F.shiftright("place", 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return places.sparkSession.sparkContext.broadcast(out)


def planes(x: np.ndarray) -> bytes:
    """The bytes of x, first all lowest, then all next ...: sorted or small numbers pack well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()

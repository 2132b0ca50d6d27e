"""Near-duplicate groups of documents by SetSketch registers, exact on the links they find.

A document's set is its distinct k-word shingles (64-bit hashes). Its sketch has REGISTERS registers: the minimum
of a hash over the set, read as an exponential variable and kept as floor(1 - log_BASE(minimum)), truncated to 16 bits: exponentially
spaced truncated minima. Registers of unions are register-wise maxima, and two sets agree in a register with a
probability of nearly their Jaccard similarity, so equal bands of ROWS registers make documents meet.

1. Documents with equal sets become one vertex (aggregated before the shuffle).
2. Vertices that share a band are tied to the band's smallest vertex: a star per band, never its pairs. The
   components of the stars are families. No link crosses families unless all BANDS bands miss it, which at a
   similarity of 0.8 happens for 5 pairs in 100 million.
3. Only members of families fetch their texts. A family is cut into blocks of BLOCK members; a block is solved in
   one task, together with the family's hub. Pairs of different components whose joint likelihood estimate of the similarity comes
   near the threshold are verified on full sets, best estimate first, until no untested pair could join components.
4. In families of several blocks, members outside the family's largest component are a query set that meets
   all blocks. So a group of a third of all rows costs its size times its few stragglers, in bounded blocks.
5. Links between blocks are closed by components over the blocks' own components.

Nulls: a null or wordless text has the empty set and is linked with nothing. A null doc_id takes part as text; it is
the component's id only if no member has one. Rows with one doc_id are separate documents. Empty tables give
empty results, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, components, distinct_sorted, documents, drop_held, give_back, materialize, mix, shingle_hashes, texts, word_hashes

REGISTERS, BANDS, ROWS = 128, 32, 4
BASE = 1.001
BLOCK = 512
#: Standard errors below the threshold at which an estimate still counts as near.
MARGIN = 5.0

_rng = np.random.default_rng(8)
_ODD = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of registers for each segment of set elements (repeats do not matter); empty segments get zeros."""
    n = len(starts) - 1
    out = np.zeros((n, REGISTERS), np.uint16)
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return out
    x = (values >> np.uint64(32)).astype(np.uint32)
    at = starts[:-1][some]
    least = np.empty((len(some), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        y = (x ^ _XOR[i]) * _ODD[i]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        least[:, i] = np.minimum.reduceat(y, at)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    out[some] = np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def likelihood_similarity(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of sketch rows, given the set sizes, on a grid of 1/200.

    With u, v the sizes' shares, a register of a exceeds b's with probability p(u - v J), and the other way with
    p(v - u J), where p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    total = np.maximum(na + nb, 1).astype(float)
    u, v = na / total, nb / total
    best = np.full(len(a), -np.inf)
    out = np.zeros(len(a))
    shrink, scale = (BASE - 1) / BASE, math.log(BASE)
    for j in np.linspace(0, 1, 201):
        p = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * shrink) / scale
        q = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * shrink) / scale
        value = more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))
        value = np.where(j <= np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1) + 0.005, value, -np.inf)
        better = value > best
        best, out = np.where(better, value, best), np.where(better, j, out)
    return out


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in texts(batch):
        yield lo, hi, *distinct_sorted(*shingle_hashes(*word_hashes(data, offsets), k))


def _prints(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit fingerprints of sorted distinct sets."""
    if not len(values):
        return [bytes(16)] * (len(starts) - 1)
    sums = np.zeros((len(starts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((0x51, 0xA7)):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ mix(np.array([salt], np.uint64))))])[starts]
            sums[:-1, i] = mix(total[1:] - total[:-1] + np.diff(starts).astype(np.uint64))
    raw = np.ascontiguousarray(sums[:-1]).tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(starts) - 1)]


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for each band of register rows: (rows, BANDS)."""
    packed = rows[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).copy().view(np.uint64)[:, :, 0]
    return mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch_documents(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, th (the text's hash), fp, n, bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for lo, hi, values, starts in _sets(batch, k):
                keys = band_keys(registers(values, starts))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(_prints(values, starts), pa.binary()), pa.array(np.diff(starts), pa.int64()), bands], names=["doc_id", "th", "fp", "n", "bands"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp binary, n long, bands array<long>")


def fetch_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp, set of the vertices in wanted (fp): one scan that keeps what a bitmap of fixed size lets through, then a join."""
    bits = 24
    place = F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long")  # a fingerprint's bytes are uniform
    sent = bit_map(wanted.select(F.shiftright(place, 32 - bits).alias("place")), bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            for _, _, values, starts in _sets(batch, k):
                found: dict[bytes, int] = {}
                for i, fp in enumerate(_prints(values, starts)):
                    at = int.from_bytes(fp[:4], "big") >> (32 - bits)
                    if (int(sent.value[at >> 6]) >> (at & 63)) & 1 and starts[i + 1] > starts[i]:
                        found.setdefault(fp, i)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([values[starts[i] : starts[i + 1]].tobytes() for i in found.values()], pa.binary())], names=["fp", "set"])
        give_back()

    got = docs.select("doc_id", "text").mapInArrow(run, "fp binary, set binary")
    return got.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.first("set").alias("set"))


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _links(fps: list, sets: list[np.ndarray], labels: list[int], left: Iterable[int], right: Iterable[int], percent: int) -> list[tuple]:
    """Verified links that join components of left x right, given components as labels; pairs already joined are skipped."""
    n = len(fps)
    union = _Union(max([*labels, -1]) + 1)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = registers(np.concatenate(sets) if n else np.zeros(0, np.uint64), starts)
    left, right = np.array(list(left)), np.array(list(right))
    t = percent / 100
    near = t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS)
    found: list[tuple] = []
    cand: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lab = np.array(labels)
    for i in left.tolist():
        other = right[(right != i) & (lab[right] != lab[i])]
        other = other[(100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i]))]
        if not len(other):
            continue
        agree = (rows[other] == rows[i]).mean(1)
        other = other[agree >= near - 0.05]
        if len(other):
            cand.append((np.full(len(other), i), other, np.zeros(0)))
    if not cand:
        return found
    a, b = np.concatenate([c[0] for c in cand]), np.concatenate([c[1] for c in cand])
    estimate = np.concatenate([likelihood_similarity(rows[a[i : i + 4096]], sizes[a[i : i + 4096]], rows[b[i : i + 4096]], sizes[b[i : i + 4096]]) for i in range(0, len(a), 4096)])
    order = np.argsort(-estimate, kind="stable")
    order = order[estimate[order] >= near]
    whole: dict[int, frozenset] = {}
    tested: set[tuple[int, int]] = set()
    for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
        x, y = union.find(labels[i]), union.find(labels[j])
        if x == y or (pair := (min(i, j), max(i, j))) in tested:
            continue
        tested.add(pair)
        p = whole.get(i) or whole.setdefault(i, frozenset(sets[i].tolist()))
        q = whole.get(j) or whole.setdefault(j, frozenset(sets[j].tolist()))
        both = len(p & q)
        if 100 * both >= percent * (len(p) + len(q) - both):
            union.up[x] = y
            found.append((fps[i], fps[j]))
    return found


def _solve(percent: int, shape: pa.Schema):
    def block(table: pa.Table) -> pa.Table:
        """One block. inner: every member with its component's least vertex, found among members (part 0) and the hub (part 1).
        Otherwise: links between members and queries of the whole family (part 1), as pairs of their labels.
        """
        fps, part, names = (table.column(x).to_pylist() for x in ("fp", "part", "label"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        ids: dict = {}
        labels = [ids.setdefault(x, len(ids)) for x in names]
        everyone = list(range(len(fps)))
        if table.column("inner")[0].as_py():
            union = _Union(len(fps))
            index = {fp: i for i, fp in enumerate(fps)}
            for a, b in _links(fps, sets, labels, everyone, everyone, percent):
                union.up[union.find(index[a])] = union.find(index[b])
            least: dict[int, bytes] = {}
            for i in everyone:
                root = union.find(i)
                least[root] = min(least.get(root, fps[i]), fps[i])
            out = [{"a": fps[i], "b": least[union.find(i)]} for i in everyone if part[i] == 0]
        else:
            name = dict(zip(fps, names, strict=True))
            found = _links(fps, sets, labels, [i for i in everyone if part[i] == 1], [i for i in everyone if part[i] == 0], percent)
            out = [{"a": name[a], "b": name[b]} for a, b in found]
        return pa.Table.from_pylist(out, schema=shape)

    return block


def near_groups(docs: DataFrame, vertices: DataFrame, percent: int, k: int) -> DataFrame:
    """fp, c: the least vertex reachable by verified links, for each vertex (fp, bands) that shares a band."""
    bands = vertices.select("fp", F.explode("bands").alias("key"))
    stars = materialize(bands.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("most")).where("hub < most").select("key", "hub"))
    ties = bands.join(stars, "key").select("hub", "fp").where("hub <> fp")
    family = components(ties, "hub", "fp").select(F.col("v").alias("fp"), F.col("c").alias("family"))
    sized = family.join(family.groupBy("family").agg(F.count("*").alias("size")), "family")
    sized = sized.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = materialize(sized.join(fetch_sets(docs, family, k), "fp").select("family", "block", "blocks", "fp", "set"))
    shape = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    solve = _solve(percent, shape)
    columns = ["family", "block", "fp", "set"]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = members.select(*columns, F.lit(0).alias("part"), F.col("fp").alias("label"), F.lit(True).alias("inner"))
    hubs = members.where("blocks > 1 and fp = family").select("family", F.col("block").alias("own"), every.alias("block"), "fp", "set", F.lit(1).alias("part"), F.col("fp").alias("label"), F.lit(True).alias("inner"))
    one = one.unionByName(hubs.where("own <> block").drop("own"))
    first = materialize(one.groupBy("family", "block").applyInArrow(solve, "a binary, b binary"))
    label = first.select(F.col("a").alias("fp"), F.col("b").alias("c"))
    # Families of several blocks: whoever is not in the largest component asks all blocks.
    large = members.where("blocks > 1")
    if not large.limit(1).count():
        return label
    joined = large.join(label, "fp")
    across = components(joined.select("fp", "c"), "fp", "c").select(F.col("v").alias("c"), F.col("c").alias("label"))
    large = materialize(joined.join(across, "c", "left").select(*columns, "blocks", F.coalesce("label", "c").alias("label")))
    counts = large.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "label")).alias("m")).select("family", F.col("m.label").alias("main"))
    asks = large.join(main, "family").where("label <> main").withColumn("slot", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")))
    asks = asks.select("family", every.alias("block"), "fp", "set", F.lit(1).alias("part"), "label", F.lit(False).alias("inner"), "slot")
    slots = asks.select("family", "block", "slot").distinct()
    two = large.select(*columns, F.lit(0).alias("part"), "label", F.lit(False).alias("inner")).join(slots, ["family", "block"])
    two = materialize(two.unionByName(asks).groupBy("family", "block", "slot").applyInArrow(solve, "a binary, b binary"))
    last = components(two, "a", "b").select(F.col("v").alias("label"), F.col("c").alias("joined"))
    late = large.join(last, "label", "left").select("fp", F.coalesce("joined", "label").alias("late"))
    return label.join(late, "fp", "left").select("fp", F.coalesce("late", "c").alias("c"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept and group (the component's fingerprint, null for
    the empty set) for each row of docs."""
    slim = materialize(sketch_documents(docs, k))
    vertices = slim.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    label = near_groups(docs, vertices, percent, k)
    named = vertices.select("fp", "least").join(label, "fp", "left").select("fp", "least", F.coalesce("c", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component"))
    named = named.join(least, "c").select("fp", "component", F.col("c").alias("group"))
    out = slim.join(named, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "th", "group")


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs, all columns untouched, with one row of each group: the smallest doc_id's, then the smallest text hash's; empty sets all stay."""
    found = near_duplicates(docs, percent, k)
    best = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("m")).select("m.doc_id", "m.th")
    best = best.unionByName(found.where("group is null").select("doc_id", "th")).distinct()
    best = best.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "th")
    own = F.when(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "     ")) == "", F.monotonically_increasing_id()).otherwise(-1)
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), own.alias("own"))
    return keyed.join(best, ["id", "th"], "left_semi").dropDuplicates(["id", "th", "own"]).select("row.*")


def op1_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85, k=3).drop("th", "group")

"""Scores texts by context-tree weighting over bytes.

A text is its lower-cased tokens, words and then one end, each closed by a space (the end has no bytes of its
own). A byte's context is the DEPTH bytes before it, across words, back to the text's start. Bytes are cut into binary
decisions along a Huffman tree of the training texts' byte counts. Every context of every length up to DEPTH has a
Krichevsky-Trofimov estimate for each decision, and a node's probability of the training texts is the even mixture of
its own estimate's and the product of its children's, so all depths are mixed. A text's probability is the
model's after the training texts, with counts held fixed: on the path of a decision, a node's estimate and the
prediction from below are weighted by what each made of the training texts. A context never seen there ends the path.
Each decision's two probabilities sum to one, so the code lengths are those of a proper code.

Statistics cover all texts and nothing unbounded is broadcast or collected:

1. A scan counts pairs of bytes. Another one counts tokens (64-bit hashes) and grams (context and byte) in each task; sorted runs of keys and counts go, packed, to buckets,
   where they are merged as they come, so that a task holds a bucket's distinct keys and not all its runs. Grams are dealt by their last two context bytes, so a bucket holds whole subtrees; those of the
   SPLIT most frequent pairs at most are dealt by the last three. There are more buckets for longer texts.
2. Buckets solve their subtrees and sum up what the nodes above need: 256 x 255 nodes at depth one and SPLIT x 255 at depth two, whatever
   the corpus. These are mixed on the driver; a second pass over the buckets scores each distinct gram.
3. A third scan looks tokens and grams up in a table of the most frequent ones (HOT at most, broadcast). The others go
   to their buckets, packed with their rows, follow these buckets' values there, piece by piece, and come back as sums per row.

Nulls: a null text is empty, one end token. A null doc_id is never held out. Rows with one doc_id are scored
separately. An empty text is its end alone, texts may be of any length, an empty table gives an empty result. Without training texts every decision is even and all base counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, _POW, _STEP, CHUNK, LOWER, documents, give_back, materialize, mix, planes, steady_heap, texts, unplanes, word_hashes

DEPTH = 6
BUCKETS = 1024
#: Grams for which there is a bucket more.
BUCKET_GRAMS = 1 << 21
#: Pairs of bytes whose subtrees are split further: the most frequent ones, of one gram in SPLIT or more.
SPLIT = 1024
#: Most frequent keys of each kind that are broadcast.
HOT = (1 << 18, 1 << 20)
#: Keys that a task gathers before it merges or passes them on.
GATHER = 1_000_000
#: Grams that a task gathers, each occurrence by itself, before it sorts and counts them.
LOT = 1 << 23
#: Bytes of text whose keys are worked out at once, and keys that are looked up at once.
PIECE, BLOCK = CHUNK // 4, 1 << 16
#: Text bytes for which lookups need one more power of two of buckets.
FINE_BYTES = 1 << 37
TOKEN, GRAM = 0, 1
#: The key of the end token.
END = np.uint64(0x5851F42D4C957F2D)
_LN10 = math.log(10)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


# ---- keys of texts ----


def _normal(data: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each text as a space, its lower-cased words joined by spaces, and the two closing spaces."""
    low = data.translate(LOWER)
    cut = offsets.tolist()
    parts = [b" ".join([b"", *words, b"", b""]) if (words := low[a:b].split()) else b"  " for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_PRIME, _SPAN = int(_POW[1]), 1024
_INVERSE = pow(_PRIME, -1, 2**64)


def _powers(of: int, n: int) -> np.ndarray:
    """of ** 0, of ** 1 ... of ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW, _LOW_INVERSE = _powers(_PRIME, _SPAN), _powers(_INVERSE, _SPAN)


def token_hashes(flat: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What word_hashes gives for texts of _normal's form, from running sums over all bytes."""
    raw = np.frombuffer(flat, np.uint8)
    space = np.flatnonzero(raw == 32)
    size = np.diff(space) - 1
    word = np.flatnonzero(size)
    size, begin = size[word], space[word] + 1
    if not len(word) or int(size.max()) > len(_POW):
        return word_hashes(flat, at)
    spans = len(raw) // _SPAN + 1
    total = np.zeros(spans * _SPAN + 1, np.uint64)
    value = total[1:].reshape(spans, _SPAN)
    value.ravel()[: len(raw)] = _BYTE[raw]
    value *= _LOW
    value *= _powers(_PRIME**_SPAN % 2**64, spans)[:, None]
    np.cumsum(total, out=total)
    back = _powers(_INVERSE**_SPAN % 2**64, spans)[begin // _SPAN] * _LOW_INVERSE[begin % _SPAN]
    return mix((total[begin + size] - total[begin]) * back + size.astype(np.uint64) * _STEP), np.searchsorted(begin, at)


def _gram_keys(flat: bytes, at: np.ndarray) -> np.ndarray:
    """Gram keys of all bytes but each row's first: eight bytes are read at each place, which hold the context in order."""
    raw = np.frombuffer(flat, np.uint8)
    key = np.ndarray(len(raw), "<u8", bytes(DEPTH) + flat + bytes(8), 0, (1,)) << np.uint64(8)
    key &= np.uint64(256 ** (DEPTH + 1) - 256)
    key |= raw
    for place in range(1, DEPTH):
        some = at[:-1] + place
        key[some[some < at[1:]]] &= np.uint64(256 ** (DEPTH + 1) - 256 ** (DEPTH + 1 - place) + 255)
    keep = np.ones(len(raw), bool)
    keep[at[:-1]] = False
    return key[keep]


def text_keys(data: bytes, offsets: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(token keys, starts of each row) and (gram keys, starts of each row); a row has at least its end token.

    A gram key is the context's bytes, the nearest highest, zeros before the start, then the byte.
    """
    flat, at = _normal(data, offsets)
    words, first = token_hashes(flat, at)
    rows = np.arange(1, len(first))
    tokens = np.insert(words, first[1:], END)
    return (tokens, first + np.concatenate([[0], rows])), (_gram_keys(flat, at), at - np.arange(len(at)))


def _giving_back(run):
    """run, after which its worker gives back what it no longer uses: it may lie idle beside those of the next stage."""

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


class Deal:
    """Which bucket a key goes to: whole subtrees of grams, those of split pairs in buckets of their own."""

    def __init__(self, pairs: np.ndarray) -> None:
        total = int(pairs.sum())
        self.buckets = BUCKETS
        while self.buckets * BUCKET_GRAMS < total:
            self.buckets *= 2
        self.pairs = np.flatnonzero((pairs * SPLIT >= total) & (pairs > 0))
        self.split = np.zeros(65536, bool)
        self.split[self.pairs] = True

    def bucket(self, key: np.ndarray, kind: int, fine: int = 1) -> np.ndarray:
        """Coarse bucket, times fine, plus a part by the whole key. Split pairs have buckets from self.buckets on."""
        size = np.uint64(self.buckets)
        if kind == GRAM:
            pair = key >> np.uint64(8 * (DEPTH - 1))
            split = self.split[pair.astype(np.int64)]
            coarse = mix(np.where(split, key >> np.uint64(8 * (DEPTH - 2)), pair)) % size + split * size
        else:
            coarse = mix(key) % size
        if fine > 1:
            coarse = coarse * np.uint64(fine) + mix(key ^ np.uint64(77)) % np.uint64(fine)
        return coarse.astype(np.int64)


def pair_counts(docs: DataFrame) -> np.ndarray:
    """How often each pair of bytes is the nearest context of a byte (65536 counts)."""

    @_giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, _, data, offsets in texts(batch, chunk=PIECE):
                raw = np.frombuffer(_normal(data, offsets)[0], np.uint8).astype(np.uint16)
                total += np.bincount(raw[1:] << 8 | raw[:-1], minlength=65536)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    got = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(65536, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out


def _sorted_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, np.uint64), dtype=np.uint64)


def _key_bytes(key: np.ndarray) -> bytes:
    return planes(np.diff(key, prepend=np.uint64(0)))


def _merged(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[first], *(np.add.reduceat(c[order], first) if len(key) else c for c in counts))


def _counted(lot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts in training and in all, of gram keys doubled, plus one in training; lot is sorted where it is."""
    lot.sort()
    first = np.flatnonzero(np.concatenate([[True], lot[1:] != lot[:-1]]))
    n = np.diff(np.append(first, len(lot)))
    key = lot[first]
    c = np.where(key & np.uint64(1), n, 0)
    key >>= np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(c, first), np.add.reduceat(n, first)


def _dealt(deal: Deal, kind: int, fine: int, key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, key, columns) of each bucket; keys keep their order inside."""
    where = deal.bucket(key, kind, fine)
    if len(where) and where.max() < 65536:
        where = where.astype(np.uint16)  # sorted by radix
    order = np.argsort(where, kind="stable")
    where = where[order]
    ends = np.flatnonzero(np.concatenate([where[1:] != where[:-1], [True]])) + 1 if len(where) else []
    lo = 0
    for hi in ends:
        part = order[lo:hi]
        yield (int(where[lo]), key[part], *(c[part] for c in columns))
        lo = hi


_COUNTS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("key", pa.binary()), ("c", pa.binary()), ("n", pa.binary())])
_COUNTS_SQL = "kind int, bucket long, key binary, c binary, n binary"


def _packed(rows: Iterable[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(tuple(x.tobytes() if isinstance(x, np.ndarray) else x for x in row))
        if len(out) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def count_keys(docs: DataFrame, deal: Deal) -> DataFrame:
    """kind, bucket, key, c, n: sorted distinct keys of a bucket, their counts in training and in all texts, packed."""

    @_giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        held: list[tuple[np.ndarray, ...]] = []
        lot, used = np.zeros(LOT, np.uint64), 0

        def merge() -> None:
            held[:] = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        def out(kind: int, key: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from _packed(((kind, b, _key_bytes(k), planes(x), planes(y)) for b, k, x, y in _dealt(deal, kind, 1, key, c, n)), _COUNTS)

        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, _, data, offsets in texts(batch, chunk=PIECE):
                (key, starts), (gram, places) = text_keys(data, offsets)
                some = train[lo : lo + len(starts) - 1]
                held.append(_merged(key, np.repeat(some, np.diff(starts)), np.ones(len(key), np.int64)))
                if sum(len(x[0]) for x in held) > GATHER:
                    merge()
                    if len(held[0][0]) > GATHER // 2:
                        yield from out(TOKEN, *held.pop())
                gram <<= np.uint64(1)
                gram |= np.repeat(some.astype(np.uint8), np.diff(places))
                while len(gram):
                    fits = min(len(gram), LOT - used)
                    lot[used : used + fits] = gram[:fits]
                    gram, used = gram[fits:], used + fits
                    if used == LOT:
                        yield from out(GRAM, *_counted(lot))
                        used = 0
        if used:
            yield from out(GRAM, *_counted(lot[:used]))
        del lot
        if held:
            merge()
            yield from out(TOKEN, *held.pop())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One bucket's runs, merged as they come: no more than its distinct keys are held."""
        steady_heap()
        held: list[tuple[np.ndarray, ...]] = []
        kind = bucket = fresh = 0
        for batch in batches:
            kind, bucket = batch.column("kind")[0].as_py(), batch.column("bucket")[0].as_py()
            for key, c, n in zip(*(batch.column(x) for x in ("key", "c", "n")), strict=True):
                held.append((_sorted_keys(key.as_py()), unplanes(c.as_py(), np.int64), unplanes(n.as_py(), np.int64)))
                fresh += len(held[-1][0])
                if fresh > max(GATHER // 4, len(held[0][0])):
                    held, fresh = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0
        key, c, n = _merged(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = []
        if len(key) > GATHER // 8:
            give_back()
        yield from _packed([(kind, bucket, _key_bytes(key), planes(c), planes(n))], _COUNTS)

    return docs.select("text", "train").mapInArrow(run, _COUNTS_SQL).groupBy("kind", "bucket").applyInArrow(join, _COUNTS_SQL)


# ---- Krichevsky-Trofimov estimates and their mixture ----

_SMALL = 4096
_LG_HALF = np.array([math.lgamma(x + 0.5) for x in range(_SMALL)])
_LG_ONE = np.array([math.lgamma(x + 1.0) for x in range(_SMALL)])


def _lgamma(x: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(x, _SMALL - 1).astype(np.int64)]
    large = np.flatnonzero(x >= _SMALL)
    if len(large):
        z = x[large] + shift
        out[large] = (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the estimate's probability of a sequence with these counts."""
    return _lgamma(zeros, _LG_HALF, 0.5) + _lgamma(ones, _LG_HALF, 0.5) - 2 * _LG_HALF[0] - _lgamma(zeros + ones, _LG_ONE, 1.0)


class Code:
    """The Huffman tree of 256 byte counts: for each byte its decisions' inner nodes (0..254) and bits."""

    def __init__(self, counts: np.ndarray) -> None:
        heap: list[tuple] = [(float(c) + 0.5, b, (b,)) for b, c in enumerate(counts)]
        heapq.heapify(heap)
        path: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            low, high = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in ((0, low), (1, high)):
                for b in side[2]:
                    path[b].append((node, bit))
            heapq.heappush(heap, (low[0] + high[0], 256 + node, low[2] + high[2]))
        self.length = np.array([len(p) for p in path])
        self.node = np.zeros((256, int(self.length.max())), np.uint8)
        self.bit = np.zeros(self.node.shape, bool)
        for b, p in enumerate(path):
            self.node[b, : len(p)], self.bit[b, : len(p)] = [x for x, _ in p], [x for _, x in p]

    def decisions(self, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which byte, node, bit) of all decisions."""
        size = self.length[bytes_]
        which = np.repeat(np.arange(len(bytes_)), size)
        step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        b = bytes_[which]
        return which, self.node[b, step], self.bit[b, step]


def _blend(own: np.ndarray, below: np.ndarray, p_own: np.ndarray, p_below: np.ndarray) -> np.ndarray:
    """The mixture's prediction; the weights are what either side made of the training texts (ln)."""
    share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    return share * p_own + (1 - share) * p_below


def solve(key: np.ndarray, c: np.ndarray, code: Code, upper: tuple[np.ndarray, ...] | None, split: np.ndarray | None = None):
    """With upper (tables of depths one, zero and, for split pairs, two): ln of each gram's probability. Without: depth one's (node, zeros, ones, ln children).

    split: for grams of split pairs, of each pair its place among them; their subtrees begin at depth three, and without
    upper depth two's nodes come back, from 65536 on.

    Grams are sorted, so after a stable sort by tree node the decisions of each context, at every depth, are a run.
    """
    which, node, bit = code.decisions((key & np.uint64(255)).astype(np.int64))
    order = np.argsort(node, kind="stable")
    which, node, bit = which[order], node[order], bit[order]
    weight = c[which].astype(float)
    w0, w1 = np.where(bit, 0.0, weight), np.where(bit, weight, 0.0)
    edge = np.concatenate([[True], node[1:] != node[:-1]])
    p = np.full(len(which), np.nan)
    log = start = None
    for d in range(DEPTH, 1 if split is None else 2, -1):
        context = (key >> np.uint64(8 * (DEPTH + 1 - d)))[which]
        new = edge.copy()
        new[1:] |= context[1:] != context[:-1]
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        zeros, ones = np.add.reduceat(w0, at), np.add.reduceat(w1, at)
        own = kt_log(zeros, ones)
        k = ((np.where(bit, ones[run], zeros[run])) + 0.5) / ((zeros + ones)[run] + 1)
        if log is None:
            p, log = k, own
        else:
            children = np.add.reduceat(log, np.searchsorted(start, at))
            p = np.where(np.isnan(p), k, _blend(own[run], children[run], k, p))
            log = np.logaddexp(own, children) - math.log(2)
        p = np.where((zeros + ones)[run] > 0, p, np.nan)
        start = at
    last = (key >> np.uint64(8 * DEPTH)).astype(np.int64)[which]
    two = None if split is None else split[(key >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)][which] * 256 + node
    if upper is None:
        ids = last[start] * 256 + node[start] if two is None else 65536 + two[start]
        return ids, zeros, ones, log
    above = [(upper[0], last * 256 + node), (upper[1], node.astype(np.int64))]
    for table, at in above if two is None else [(upper[2], two), *above]:
        zeros, ones, own, children = table[at].T
        k = (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1)
        p = np.where(np.isnan(p), k, _blend(own, children, k, p))
        p = np.where(zeros + ones > 0, p, np.nan)
    return np.bincount(which, np.log(np.where(np.isnan(p), 0.5, p)), len(key))


def _byte_counts(counts: DataFrame) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount((_sorted_keys(k) & np.uint64(255)).astype(np.int64), unplanes(c, np.int64), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["b", "c"])

    got = counts.where(F.col("kind") == GRAM).select("key", "c").mapInArrow(run, "b long, c double").groupBy("b").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(256)
    out[got.column("b").to_numpy()] = got.column("c").to_numpy()
    return out


def _mixed(table: np.ndarray) -> np.ndarray:
    """ln of the weighted probability of nodes (zeros, ones, own, children)."""
    return np.logaddexp(table[:, 2], table[:, 3]) - math.log(2)


def gram_scores(counts: DataFrame, deal: Deal) -> DataFrame:
    """bucket, key, n, value: ln of the probability of each distinct gram's byte (f64), all depths mixed."""
    spark = counts.sparkSession
    grams = counts.where(F.col("kind") == GRAM)
    code = spark.sparkContext.broadcast(Code(_byte_counts(counts)))
    index = np.zeros(65536, np.int64)
    index[deal.pairs] = np.arange(len(deal.pairs))

    @_giving_back
    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for b, k, c in zip(*batch.columns, strict=True):
                ids, *stats = solve(_sorted_keys(k.as_py()), unplanes(c.as_py(), np.int64), code.value, None, index if b.as_py() >= deal.buckets else None)
                distinct, inverse = np.unique(ids, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), *(pa.array(np.bincount(inverse, s, len(distinct))) for s in stats)], names=["node", "zeros", "ones", "ln"])

    got = grams.select("bucket", "key", "c").mapInArrow(sums, "node long, zeros double, ones double, ln double").groupBy("node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "ln"))).toArrow()
    nodes = np.zeros((65536 + 256 * len(deal.pairs), 4))
    at = got.column("node").to_numpy()
    nodes[at, 0], nodes[at, 1], nodes[at, 3] = (got.column(x).to_numpy() for x in ("zeros", "ones", "ln"))
    one, two = nodes[:65536], nodes[65536:]
    two[:, 2] = kt_log(two[:, 0], two[:, 1])
    parent = np.repeat(deal.pairs >> 8, 256) * 256 + np.tile(np.arange(256), len(deal.pairs))
    for column, value in ((0, two[:, 0]), (1, two[:, 1]), (3, _mixed(two))):
        one[:, column] += np.bincount(parent, value, 65536)
    one[:, 2] = kt_log(one[:, 0], one[:, 1])
    zero = np.zeros((256, 4))
    zero[:, 0], zero[:, 1] = one[:, 0].reshape(256, 256).sum(0), one[:, 1].reshape(256, 256).sum(0)
    zero[:, 2] = kt_log(zero[:, 0], zero[:, 1])
    zero[:, 3] = _mixed(one).reshape(256, 256).sum(0)
    upper = spark.sparkContext.broadcast((one, zero, two))

    @_giving_back
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        for batch in batches:
            for i in range(batch.num_rows):
                b, k, c = (batch.column(j)[i].as_py() for j in range(3))
                ln = solve(_sorted_keys(k), unplanes(c, np.int64), code.value, upper.value, index if b >= deal.buckets else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), batch.column(3).slice(i, 1), pa.array([planes(ln)], pa.binary())], names=["bucket", "key", "n", "value"])

    return grams.select("bucket", "key", "c", "n").mapInArrow(score, "bucket long, key binary, n binary, value binary")


# ---- lookups ----


_ENTRY = np.dtype([("key", np.uint64), ("value", np.float64)])


class Lookup:
    """A static hash table of u64 keys with values, probed in rounds. A key lies beside its value; free places hold NaN."""

    def __init__(self, key: np.ndarray, value: np.ndarray) -> None:
        self.rounds: list[tuple[int, np.ndarray]] = []
        while len(key) and len(self.rounds) < 12:
            bits = max(4, int(len(key) * 2).bit_length())
            slot = self._slot(key, bits, len(self.rounds))
            held = np.full(1 << bits, -1, np.int32)
            held[slot] = np.arange(len(key))
            inside = held[slot] == np.arange(len(key))
            table = np.zeros(1 << bits, _ENTRY)
            table["value"] = np.nan
            table["key"][slot[inside]], table["value"][slot[inside]] = key[inside], value[inside]
            self.rounds.append((bits, table))
            key, value = key[~inside], value[~inside]
        if len(key):
            raise ValueError("keys repeat")

    @staticmethod
    def _slot(key: np.ndarray, bits: int, turn: int) -> np.ndarray:
        return ((key ^ (key >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 + 0x5851F42D4C957F2E * turn) % 2**64 | 1) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Values, NaN for keys that are not there."""
        out = np.full(len(key), np.nan)
        for lo in range(0, len(key), BLOCK):
            part, left = key[lo : lo + BLOCK], None
            for turn, (bits, table) in enumerate(self.rounds):
                got = table.take(self._slot(part, bits, turn))
                value = np.where(got["key"] == part, got["value"], np.nan)
                if left is None:
                    out[lo : lo + len(part)] = value
                else:
                    out[left] = value
                miss = np.flatnonzero(np.isnan(value))
                if not len(miss):
                    break
                part, left = part[miss], miss + lo if left is None else left[miss]
        return out


def _hot(scores: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys and their values: all whose count's grade (an eighth of a power of two) fits in room with those above."""

    def grade(n: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(n, 1)) * 8).astype(np.int64)

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(520, np.int64)
        for batch in batches:
            for n in batch.column(0):
                total += np.bincount(grade(unplanes(n.as_py(), np.int64)), minlength=520)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(520)), pa.array(total)], names=["g", "size"])

    got = scores.select("n").mapInArrow(sizes, "g long, size long").groupBy("g").agg(F.sum("size").alias("size")).toArrow()
    size = np.zeros(520, np.int64)
    size[got.column("g").to_numpy()] = got.column("size").to_numpy()
    above = np.cumsum(size[::-1])[::-1]
    least = int(np.argmax(above <= room))

    @_giving_back
    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n, v in zip(*batch.columns, strict=True):
                on = grade(unplanes(n.as_py(), np.int64)) >= least
                yield pa.RecordBatch.from_arrays([pa.array([_sorted_keys(k.as_py())[on].tobytes()], pa.binary()), pa.array([unplanes(v.as_py(), np.float64)[on].tobytes()], pa.binary())], names=["key", "value"])

    rows = scores.select("key", "n", "value").mapInArrow(pick, "key binary, value binary").toArrow()
    return tuple(np.frombuffer(b"".join(rows.column(x).to_pylist()), t) for x, t in (("key", np.uint64), ("value", np.float64)))


_ASKED = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("rows", pa.binary())])
_ASKED_SQL = "row long, key long, train boolean, n_tokens long, n_bytes long, known long, base double, score double, kind int, bucket long, keys binary, rows binary"


def ctw_scores(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score (log10) and bits_per_byte for each row of docs."""
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("key"), "text", train.alias("train"))
    deal = Deal(pair_counts(slim))
    counts = materialize(count_keys(slim, deal))

    @_giving_back
    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, c, n in zip(*batch.columns, strict=True):
                c = unplanes(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind.as_py()], pa.int32()), pa.array([int(c.sum())]), pa.array([int((c > 0).sum())]), pa.array([int(unplanes(n.as_py(), np.int64).sum())])], names=["kind", "c", "v", "n"])

    total = {r["kind"]: r for r in counts.select("kind", "c", "n").mapInArrow(totals, "kind int, c long, v long, n long").groupBy("kind").agg(*(F.sum(x).alias(x) for x in "cvn")).collect()}
    n_train, v = (int(total[TOKEN]["c"]), int(total[TOKEN]["v"])) if total else (0, 0)
    fine = 1
    while total and total[GRAM]["n"] > FINE_BYTES * fine:
        fine *= 2

    def as_value(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [planes(unplanes(c.as_py(), np.int64).astype(np.float64)) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(value, pa.binary())], names=["bucket", "key", "n", "value"])

    tokens = counts.where(F.col("kind") == TOKEN).select("bucket", "key", "c", "n").mapInArrow(as_value, "bucket long, key binary, n binary, value binary")
    grams = materialize(gram_scores(counts, deal))
    sent = spark.sparkContext.broadcast([_hot(tokens, HOT[TOKEN]), _hot(grams, HOT[GRAM])])
    denominator = n_train + 0.5 * (v + 1)
    tables: list[Lookup] = []

    def base_of(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / denominator)

    @_giving_back
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        if not tables:
            tables.extend(Lookup(*x) for x in sent.value)
        asked: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {TOKEN: [], GRAM: []}

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if asked[kind]:
                keys, rows = (np.concatenate(x) for x in zip(*asked[kind], strict=True))
                order = np.argsort(keys)
                blank = (None,) * 7
                made = ((int(r[0]), *blank, kind, b, _key_bytes(k), planes((r - r[0]).astype(np.int32))) for b, k, r in _dealt(deal, kind, fine, keys[order], rows[order]))
                yield from _packed(made, _ASKED)
                asked[kind] = []

        for batch in batches:
            row = batch.column(2).to_numpy()
            for lo, hi, data, offsets in texts(batch, chunk=PIECE):
                sums = []
                for kind, (keys, starts) in enumerate(text_keys(data, offsets)):
                    value = tables[kind].find(keys)
                    rare = np.flatnonzero(np.isnan(value))
                    if len(rare):
                        asked[kind].append((keys[rare], row[lo + np.searchsorted(starts, rare, "right") - 1]))
                    add = lambda x, s=starts: np.add.reduceat(x, s[:-1])  # noqa: E731  every row has a token and a gram
                    if kind == TOKEN:
                        n_tokens = np.diff(starts)
                        sums.append(add((value > 0).astype(np.int64)))
                        value = base_of(value)
                    value[rare] = 0
                    sums.append(add(value))
                m = hi - lo
                blank = [pa.nulls(m, t) for t in _ASKED.types[8:]]
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, m), batch.column(0).slice(lo, m), batch.column(3).slice(lo, m), pa.array(n_tokens), pa.array(np.diff(offsets)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), *blank], schema=_ASKED)
                for kind in (TOKEN, GRAM):
                    if sum(len(k) for k, _ in asked[kind]) > GATHER:
                        yield from out(kind)
        for kind in (TOKEN, GRAM):
            yield from out(kind)

    first = materialize(slim.withColumn("row", F.monotonically_increasing_id()).select("key", "text", "row", "train").mapInArrow(run, _ASKED_SQL))

    def split(kind: int):
        def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("value", pa.binary())])
            for batch in batches:
                for k, x in zip(*batch.columns, strict=True):
                    dealt = _dealt(deal, kind, fine, _sorted_keys(k.as_py()), unplanes(x.as_py(), np.float64))
                    yield from _packed(((b, _key_bytes(k), planes(x)) for b, k, x in dealt), shape)

        return parts

    @_giving_back
    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per row of the keys asked of each bucket, piece by piece; a bucket's values come before what is asked of it."""
        steady_heap()
        own, known, value, size = None, np.zeros(0, np.uint64), np.zeros(0), 0
        out: list[tuple[np.ndarray, ...]] = []

        def sums() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["row", "k", "b", "s"])

        for batch in batches:
            for kind, bucket, k, x, r, z in zip(*(batch.column(x) for x in ("kind", "bucket", "keys", "value", "rows", "row")), strict=True):
                here = kind.as_py(), bucket.as_py()
                if not r.is_valid:
                    own, known, value = here, _sorted_keys(k.as_py()), unplanes(x.as_py(), np.float64)
                    continue
                if here != own:
                    raise ValueError("a bucket without values is asked")
                got = value[np.searchsorted(known, _sorted_keys(k.as_py()))]
                ids, inverse = np.unique(unplanes(r.as_py(), np.int32) + np.int64(z.as_py()), return_inverse=True)
                zero = np.zeros(len(got))
                each = ((got > 0).astype(float), base_of(got), zero) if here[0] == TOKEN else (zero, zero, got)
                out.append((ids, *(np.bincount(inverse, e, len(ids)) for e in each)))
                size += len(ids)
                if size > GATHER // 4:
                    yield sums()
                    size = 0
        if out:
            yield sums()

    kept = tokens.select("key", "value").mapInArrow(split(TOKEN), "bucket long, keys binary, value binary").withColumn("kind", F.lit(TOKEN))
    kept = kept.unionByName(grams.select("key", "value").mapInArrow(split(GRAM), "bucket long, keys binary, value binary").withColumn("kind", F.lit(GRAM)))
    both = kept.select("kind", "bucket", "keys", "value", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("long").alias("row"))
    both = both.unionByName(first.where("kind is not null").select("kind", "bucket", "keys", F.lit(None).cast("binary").alias("value"), "rows", "row"))
    both = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("rows").isNotNull())
    rest = both.mapInArrow(answer, "row long, k double, b double, s double")
    rest = rest.groupBy("row").agg(*(F.sum(x).alias(x) for x in "kbs"))
    out = first.where("kind is null").join(rest, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = (F.col("score") + zero("s")) / F.lit(_LN10)
    return out.select(
        F.col("key").alias(key), "train", "n_tokens", (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), score.alias("score"), F.try_divide(-score * F.lit(math.log2(10)), F.col("n_bytes")).alias("bits_per_byte"),
    )


def op3_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ctw_scores(documents(spark, sf_dir), ~held_out())
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")

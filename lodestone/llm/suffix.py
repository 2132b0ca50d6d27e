"""Removes passages that repeat an earlier document, byte-exact, by suffix sorting.

Every byte covered by a SPAN-byte string that also starts in a document with a smaller doc_id is removed. Strings are
judged on the input, overlaps count, matches never cross documents.

A suffix array of a whole corpus does not fit one task, so candidate text is cut into pieces first, without losing a match:

1. Anchors. Each SPAN-byte window picks the GRAM-byte substrings in it whose hash is least (ties: all). Equal windows pick
   equal anchors at equal places, wherever they occur. One scan sends each anchor's hash with its document, packed, to
   buckets by hash. Hashes seen in two documents are marked in a bitmap of fixed size.
2. Pieces. A second scan takes, for each marked anchor, the text of the windows that picked it (under 2 SPAN bytes). A task
   sends each distinct piece of a lot once to the anchor's bucket, with its occurrences; of a piece with more than LOCAL of them only
   the least doc_id goes there, and the occurrences to buckets of their own. False positives of the bitmap cost time, nothing else.
3. Suffix arrays. A bucket's distinct pieces are sorted in two stages: suffixes smaller than their
   successors are sorted directly, all others are induced by one scan over the first-byte buckets. Neighbours
   with a common prefix of SPAN bytes are equal windows; the least doc_id of each run decides. Pieces are merged after a comparison of their
   bytes, and the only distinct piece of an anchor has no windows to be compared with.
4. Verdicts on pieces with many occurrences are joined to these, which Spark can split. All spans go back to their rows, are united and cut out. A row is known by its doc_id and, where rows share one, the hash of its text, which no
   split of a scan changes; rows that are equal in both have the same spans. Rows without a span are told by a bitmap of fixed size and do not travel.

The bitmap and the shuffle of anchors see every document. Bucket counts grow with the text, so a bucket's
pieces stay near a fixed size, whatever a passage's share of the rows.

Nulls: a null or empty text has no bytes and nothing removed; a null doc_id sorts before all others. Texts may be of any length. Rows with one doc_id do not remove
each other's text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, documents, give_back, materialize, mix, planes, steady_heap, texts, unplanes

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
PIECE = 2 * SPAN - GRAM
FILTER_BITS = 27
#: Bits of the map of rows that lose something.
ROW_BITS = 24
#: Text bytes that are searched for anchors at once.
CHUNK = 1 << 19
#: Text bytes for each bucket.
BUCKET_BYTES = 1 << 19
#: Pieces that a task gathers before it passes them on, and anchors.
GATHER, GATHER_ANCHORS = 400_000, 1_500_000
#: Occurrences of one distinct piece that a task sends along with it; beyond, they travel apart.
LOCAL = 64
_NONE = np.uint64(2**64 - 1)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xD6E8FEB86659FD93)


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as an unaligned view; raw is padded."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))


def _least(x: np.ndarray, width: int, f=np.minimum) -> np.ndarray:
    """f over x[i:i + width], for each i where that fits."""
    have = 1
    while have * 2 <= width:
        x = f(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def gram_hash(*words: np.ndarray) -> np.ndarray:
    """The hash of GRAM bytes, given as words of eight; odd and below _NONE, so neither mark for places without one can be a hash."""
    g = words[0] * np.uint64(_MULTIPLIERS[0])
    for word, by in zip(words[1:], _MULTIPLIERS[1:], strict=False):
        g ^= word * np.uint64(by) + (g >> np.uint64(29))
    g *= np.uint64(0x94D049BB133111EB)
    g ^= g >> np.uint64(32)
    return np.minimum(g | np.uint64(1), _NONE - np.uint64(2))


class Anchors:
    """The anchors of some documents' bytes: place at, hash, and the windows that picked each."""

    def __init__(self, data: bytes, offsets: np.ndarray) -> None:
        n = len(data)
        self.raw = np.frombuffer(data + bytes(PIECE + 8), np.uint8)
        w = _words(self.raw)
        g = gram_hash(*(w[i : n + i] for i in range(0, GRAM, 8)))
        ends = offsets[1:]
        inside = np.zeros(n + 1, np.int32)  # places whose window does not fit its document
        np.add.at(inside, np.maximum(ends - SPAN + 1, offsets[:-1]), 1)
        np.add.at(inside, ends, -1)
        off = np.cumsum(inside[:-1]) > 0
        tail = np.zeros(n + 1, np.int32)
        np.add.at(tail, np.maximum(ends - GRAM + 1, offsets[:-1]), 1)
        np.add.at(tail, ends, -1)
        g[np.cumsum(tail[:-1]) > 0] = _NONE
        self.g = g
        if n < SPAN:
            self.at, self.low = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        low = np.zeros(n, np.uint64)
        low[: n - WINDOW + 1] = _least(g, WINDOW)
        low[off] = 0
        padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low])
        self.at = np.flatnonzero((_least(padded, WINDOW, np.maximum) == g) & (g != _NONE))
        self.low = padded

    def keys(self, which: np.ndarray) -> np.ndarray:
        """The anchors' keys. Their hashes are least ones, so most of them are small: taken as keys they would crowd the first buckets and bits."""
        return mix(self.g[which])

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of the anchors at these places."""
        same = self.low[which[:, None] + np.arange(WINDOW)] == self.g[which][:, None]
        first = which - (WINDOW - 1) + same.argmax(1)
        return first, which - same[:, ::-1].argmax(1)


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]])) if len(bucket) else []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[lo]]), order[lo:hi]


def _batches(rows: Iterable[tuple], shape: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), shape.types, strict=True)], schema=shape)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), shape.types, strict=True)], schema=shape)


def _bucket(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def shared_anchors(docs: DataFrame, bits: int) -> np.ndarray:
    """The bitmap, as bytes, over the highest FILTER_BITS bits of anchor keys that two documents have."""
    shape = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("doc", pa.binary()), ("many", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, doc = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            key, doc = key[first], doc[first]
            where = _bucket(key, bits)
            edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
            made = ((int(where[lo]), planes(np.diff(key[lo:hi], prepend=np.uint64(0))), planes(doc[lo:hi]), np.packbits(many[lo:hi]).tobytes()) for lo, hi in zip(edges[:-1], edges[1:], strict=True))
            yield from _batches(made, shape)
            keys.clear()
            owners.clear()

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, _, data, offsets in texts(batch, chunk=CHUNK):
                found = Anchors(data, offsets)
                if len(found.at):
                    keys.append(found.keys(found.at))
                    owners.append(ids[lo + np.searchsorted(offsets, found.at, "right") - 1])
                if sum(map(len, keys)) > GATHER_ANCHORS:
                    yield from out()
        if keys:
            yield from out()
        give_back()

    def marks(table: pa.Table) -> pa.Table:
        key = np.concatenate([np.cumsum(unplanes(k, np.uint64), dtype=np.uint64) for k in table.column("key").to_pylist()])
        doc = np.concatenate([unplanes(d, np.int64) for d in table.column("doc").to_pylist()])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(d) // 8] for m, d in zip(table.column("many").to_pylist(), table.column("doc").to_pylist(), strict=True)]).astype(bool)
        order = np.argsort(key)
        key, doc, many = key[order], doc[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared = np.logical_or.reduceat(many, first) | (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
        place = np.unique((key[first][shared] >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
        words, inverse = np.unique(place >> 3, return_inverse=True)
        value = np.bincount(inverse, 1 << (place & 7), len(words)).astype(np.int32) if len(words) else np.zeros(0, np.int32)
        return pa.table([pa.array([words.tobytes()], pa.binary()), pa.array([value.astype(np.uint8).tobytes()], pa.binary())], names=["at", "value"])

    packed = docs.select("doc", "text").mapInArrow(run, "bucket long, key binary, doc binary, many binary")
    got = packed.groupBy("bucket").applyInArrow(marks, "at binary, value binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in got.toLocalIterator():
        np.bitwise_or.at(out, np.frombuffer(row["at"], np.int64), np.frombuffer(row["value"], np.uint8))
    return out


# ---- two-stage suffix sorting ----


def two_stage(s: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The places of s in the order of their suffixes, as far as depth bytes decide.

    Suffixes smaller than their successors are sorted directly. Going through the first-byte buckets in order, each
    suffix puts its predecessor, where that is larger, at the end of the predecessors seen so far in its bucket.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(s[1:] != s[:-1])
    run_end = np.concatenate([change, [n - 1]])
    rise = np.concatenate([s[change] < s[change + 1], [False]])  # the last run is larger than what follows: nothing
    lengths = np.diff(np.concatenate([[-1], run_end]))
    small = np.repeat(rise, lengths)
    padded = np.concatenate([s, np.zeros(depth + 16, np.uint8)])
    word = _words(padded)
    at = np.flatnonzero(small)
    order = np.argsort(word[at].byteswap(), kind="stable")
    at = at[order]
    key = word[at].byteswap()
    tie = np.concatenate([[False], key[1:] == key[:-1]]) if len(at) else np.zeros(0, bool)
    for step in range(8, depth, 8):
        group = np.cumsum(~tie)
        open_ = tie.copy()
        open_[:-1] |= tie[1:]
        idx = np.flatnonzero(open_)
        if not len(idx):
            break
        key = word[at[idx] + step].byteswap()
        sub = np.lexsort((key, group[idx]))
        at[idx] = at[idx[sub]]
        key, g = key[sub], group[idx][sub]
        tie[idx] = np.concatenate([[False], (key[1:] == key[:-1]) & (g[1:] == g[:-1])])
    first = s[at]
    ends = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[s[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        direct = at[ends[c] : ends[c + 1]]
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        if not len(front) and not len(direct):
            continue
        parts = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[(s[front] == c) & ~small[front]]
            parts.append(front)
        whole = np.concatenate([*parts, direct])
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[~small[before] & (s[before] != c)]
        to = s[before]
        by = np.argsort(to, kind="stable")
        before, to = before[by], to[by]
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, int)), strict=True):
            waiting[to[lo]].append(before[lo:hi])
    return np.concatenate(out)


def common_prefix(s: np.ndarray, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Of each neighbouring pair in order, the length of the common prefix, depth at most (bytes past the end are zeros)."""
    padded = np.concatenate([s, np.zeros(depth + 16, np.uint8)])
    word = _words(padded)
    out = np.zeros(max(0, len(order) - 1), np.int64)
    idx = np.arange(len(out))
    for step in range(0, depth, 8):
        x = word[order[idx] + step] ^ word[order[idx + 1] + step]
        differ = x != 0
        low = x & (~x + np.uint64(1))  # the lowest bit that differs is in the first byte that does
        out[idx] = step + np.where(differ, (np.log2(np.where(differ, low, 1).astype(float)).astype(np.int64)) // 8, 8)
        idx = idx[~differ]
    return np.minimum(out, depth)


def least_documents(text: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window of each piece (pieces end to end in text), the least doc of all windows equal to it."""
    start = np.cumsum(size) - size
    windows = size - SPAN + 1
    piece = np.repeat(np.arange(len(size)), windows)
    place = start[piece] + np.arange(len(piece)) - (np.cumsum(windows) - windows)[piece]
    owner = np.full(len(text), -1, np.int64)
    owner[place] = np.arange(len(place))
    order = two_stage(text)
    order = order[owner[order] >= 0]
    same = common_prefix(text, order) >= SPAN
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    who = owner[order]
    best = np.minimum.reduceat(doc[piece[who]], first)
    out = np.empty(len(place), np.int64)
    out[who] = np.repeat(best, np.diff(np.append(first, len(order))))
    return out


# ---- pieces and spans ----

_PIECES = pa.schema([("bucket", pa.int64()), ("size", pa.binary()), ("off", pa.binary()), ("text", pa.binary()), ("n", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("start", pa.binary())])
#: size and place of the anchor are bytes, texts are packed end to end, numbers are differences by byte planes. From bucket
#: _APART on a row has the occurrences of one piece, and text its print.
_PIECES_SQL = "bucket long, size binary, off binary, text binary, n binary, doc binary, row binary, start binary"
_APART = 1 << 40
_SPANS, _VERDICT, _OCCURRENCES = range(3)
_JUDGED = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("print", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("start", pa.binary()), ("end", pa.binary())])
_JUDGED_SQL = "kind int, bucket long, print binary, doc binary, row binary, start binary, end binary"


def _row_bucket(row: np.ndarray, bits: int) -> np.ndarray:
    return (mix(row.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _table(rows: list[tuple], shape: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * len(shape), shape.types, strict=True)], schema=shape)


def _gather(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The given stretches of text, end to end."""
    return text[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


_PAD = np.zeros(PIECE + 16, np.uint8)


class Prints:
    """64-bit prints of pieces (begin, size) of text, and their words, for the comparison of pieces of one print; text ends with _PAD."""

    def __init__(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray, off: np.ndarray) -> None:
        self.word = _words(text)
        self.begin, self.size = begin, size
        anchor = begin + off
        self.key = mix(gram_hash(*(self.word[anchor + i] for i in range(0, GRAM, 8))))  # as Anchors.keys
        self.value = self.key ^ size.astype(np.uint64)
        for step in range(0, PIECE, 8):
            self.value = mix(self.value ^ self.words(np.arange(len(size)), step))

    def groups(self, high: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, first, n): pieces in an order that puts equal ones together, and in that of the key's `high` highest bits; each distinct one's first place and its count."""
        low = np.uint64(2 ** (64 - high) - 1)
        code = (self.key & ~low) | (self.value & low)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.diff(np.append(first, len(order)))
        again = np.ones(len(order), bool)
        again[first] = False
        if not self.equal(order[again], np.repeat(order[first], n - 1)):  # two pieces of one print
            return order, np.arange(len(order)), np.ones(len(order), np.int64)
        return order, first, n

    def words(self, which: np.ndarray, step: int) -> np.ndarray:
        left = np.clip(self.size[which] - step, 0, 8)
        mask = np.where(left >= 8, _NONE, (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1))
        return np.where(left > 0, self.word[np.minimum(self.begin[which] + step, len(self.word) - 1)] & mask, np.uint64(0))

    def equal(self, a: np.ndarray, b: np.ndarray) -> bool:
        return bool((self.size[a] == self.size[b]).all()) and all((self.words(a, step) == self.words(b, step)).all() for step in range(0, PIECE, 8))


def _runs(which: np.ndarray, dup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of marked windows of one occurrence."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.concatenate([[True], which[1:] != which[:-1]])
    before = np.concatenate([[False], dup[:-1]])
    after = np.concatenate([fresh[1:] | ~dup[1:], [True]])
    return np.flatnonzero(dup & (fresh | ~before)), np.flatnonzero(dup & after)


def _on(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def row_marks(batch: pa.RecordBatch, twice: np.ndarray) -> np.ndarray:
    """What tells rows of one doc apart: the text's hash where the map of repeated docs says so, else 0."""
    at = batch.column(batch.schema.get_field_index("place")).to_numpy()
    return np.where(_on(twice, at), batch.column(batch.schema.get_field_index("row")).to_numpy(), 0)


def repeated_spans(docs: DataFrame, bits: int, twice) -> DataFrame:
    """doc, row, start, end (packed): windows' spans that are to go. docs: doc, text, row (the text's hash), place (the doc's in bitmaps)."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(shared_anchors(docs, bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            off, size, text, doc, row, start = zip(*held, strict=True)
            held.clear()
            text = np.concatenate([*text, _PAD])
            off, size, doc, row, start = (np.concatenate(x) for x in (off, size, doc, row, start))
            size = size.astype(np.int64)
            begin = np.cumsum(size) - size
            found = Prints(text, begin, size, off)
            order, first, n = found.groups(bits)
            key, flat, earliest = found.key[order], text.data, np.minimum.reduceat(doc[order], first)

            def made() -> Iterator[tuple]:
                where = _bucket(key[first], bits)
                edges = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]]))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    many = n[lo:hi] > LOCAL
                    for i in np.flatnonzero(many) + lo:
                        at = order[first[i] : first[i] + n[i]]
                        label = np.array([found.key[at[0]], found.value[at[0]]]).tobytes()
                        yield _APART + int(mix(found.value[at[:1]] ^ doc[at[:1]].astype(np.uint64))[0] >> np.uint64(64 - bits)), b"", b"", label, b"", planes(doc[at]), planes(row[at]), planes(start[at])
                    least = order[first[lo:hi]]
                    inside = order[first[lo] : first[hi - 1] + n[hi - 1]]
                    kept = np.ones(len(inside), bool) & ~np.repeat(many, n[lo:hi])
                    kept[first[lo:hi] - first[lo]] = True
                    at = inside[kept]
                    count = np.where(many, 1, n[lo:hi])
                    shown, owner = start[at].copy(), doc[at].copy()
                    wanted = (np.cumsum(count) - count)[many]
                    shown[wanted] = -1  # a verdict is wanted
                    owner[wanted] = earliest[lo:hi][many]
                    body = b"".join([flat[b : b + m] for b, m in zip(begin[least].tolist(), size[least].tolist(), strict=True)])
                    packed = pa.compress(body, codec="zstd", asbytes=True)
                    yield int(where[lo]), size[least].astype(np.uint8).tobytes(), off[least].tobytes(), packed, count.astype(np.uint8).tobytes(), planes(owner), planes(row[at]), planes(shown)

            yield from _batches(made(), _PIECES)

        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), row_marks(batch, twice.value)
            for lo, _, data, offsets in texts(batch, chunk=CHUNK):
                found = Anchors(data, offsets)
                if not len(found.at):
                    continue
                place = (found.keys(found.at) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                at = found.at[(bitmap.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    continue
                first, last = found.windows(at)
                size = last - first + SPAN
                inside = np.searchsorted(offsets, first, "right") - 1
                held.append(((at - first).astype(np.uint8), size.astype(np.uint8), _gather(found.raw, first, size), ids[lo + inside], rows[lo + inside], (first - offsets[inside]).astype(np.int32)))
                if sum(len(h[0]) for h in held) > GATHER:
                    yield from out()
        if held:
            yield from out()
        give_back()

    pieces = docs.select("doc", "text", "row", "place").mapInArrow(run, _PIECES_SQL)

    def spans_of(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
        return [(_SPANS, where, None, planes(doc[at]), planes(row[at]), planes(start[at]), planes(end[at])) for where, at in _groups(_row_bucket(row, bits >> 1))]

    def judge(table: pa.Table) -> pa.Table:
        steady_heap()
        col = lambda name: table.column(name).to_pylist()
        bucket = table.column("bucket")[0].as_py()
        if bucket >= _APART:
            return _table([(_OCCURRENCES, bucket, p, d, r, s, None) for p, d, r, s in zip(col("text"), col("doc"), col("row"), col("start"), strict=True)], _JUDGED)
        sizes = [np.frombuffer(x, np.uint8).astype(np.int64) for x in col("size")]
        size = np.concatenate(sizes)
        text = np.frombuffer(b"".join([*(pa.decompress(x, int(n.sum()), codec="zstd", asbytes=True) for x, n in zip(col("text"), sizes, strict=True)), _PAD.tobytes()]), np.uint8)
        n = np.concatenate([np.frombuffer(x, np.uint8) for x in col("n")]).astype(np.int64)
        doc, row = (np.concatenate([unplanes(x, np.int64) for x in col(name)]) for name in ("doc", "row"))
        start = np.concatenate([unplanes(x, np.int32) for x in col("start")])
        off = np.concatenate([np.frombuffer(x, np.uint8) for x in col("off")])
        # Distinct pieces of all lots.
        begin = np.cumsum(size) - size
        found = Prints(text, begin, size, off)
        order, first, copies = found.groups()
        sample = order[first]
        distinct = np.empty(len(size), np.int64)
        distinct[order] = np.repeat(np.arange(len(first)), copies)
        at_first = np.cumsum(n) - n
        least = np.minimum.reduceat(np.minimum.reduceat(doc, at_first)[order], first)
        windows = size[sample] - SPAN + 1
        offset = np.cumsum(windows) - windows
        # Windows of an anchor's only piece have no equals elsewhere; the others are sorted.
        best = np.repeat(least, windows)
        by_key = np.argsort(found.key[sample], kind="stable")
        owner = found.key[sample][by_key]
        alone = np.concatenate([[True], owner[1:] != owner[:-1]]) & np.concatenate([owner[1:] != owner[:-1], [True]])
        several = np.sort(by_key[~alone])
        if len(several):
            s, w = sample[several], windows[several]
            got = least_documents(_gather(text, begin[s], size[s]), size[s], least[several])
            best[np.repeat(offset[several] - (np.cumsum(w) - w), w) + np.arange(len(got))] = got
        out: list[tuple] = []
        for i in np.unique(distinct[np.flatnonzero(start[at_first] < 0)]):
            label = np.array([found.key[sample[i]], found.value[sample[i]]]).tobytes()
            out.append((_VERDICT, bucket, label, planes(best[offset[i] : offset[i] + windows[i]]), None, None, None))
        piece = np.repeat(distinct, n)
        spans: list[tuple] = []
        for lo in range(0, len(piece), GATHER):
            part = np.arange(lo, min(lo + GATHER, len(piece)))
            part = part[start[part] >= 0]
            w = windows[piece[part]]
            which = np.repeat(part, w)
            step = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w)
            o, e = _runs(which, best[offset[piece[which]] + step] < doc[which])
            spans.append((doc[which[o]], row[which[o]], (start[which[o]] + step[o]).astype(np.int32), (start[which[e]] + step[e] + SPAN).astype(np.int32)))
        return _table(out + spans_of(*(np.concatenate(x) for x in zip(*spans, strict=True))), _JUDGED)

    judged = materialize(pieces.groupBy("bucket").applyInArrow(judge, _JUDGED_SQL))

    def late(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for best, d, r, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, doc, row, start = unplanes(best, np.int64), unplanes(d, np.int64), unplanes(r, np.int64), unplanes(s, np.int32)
                which, step = np.repeat(np.arange(len(doc)), len(best)), np.tile(np.arange(len(best)), len(doc))
                o, e = _runs(which, best[step] < doc[which])
                yield _table(spans_of(doc[which[o]], row[which[o]], (start[which[o]] + step[o]).astype(np.int32), (start[which[e]] + step[e] + SPAN).astype(np.int32)), _JUDGED).combine_chunks().to_batches(max_chunksize=None)[0] if len(o) else pa.RecordBatch.from_pylist([], schema=_JUDGED)

    verdicts = judged.where(F.col("kind") == _VERDICT).select("print", F.col("doc").alias("best"))
    apart = judged.where(F.col("kind") == _OCCURRENCES).select("print", "doc", "row", "start").join(verdicts, "print")
    columns = ["doc", "row", "start", "end"]
    return judged.where(F.col("kind") == _SPANS).select(*columns).unionByName(apart.select("best", *columns[:3]).mapInArrow(late, _JUDGED_SQL).select(*columns))


def cut_spans(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what is left."""
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def dedup_passages(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (the remaining bytes) for each row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, int(total // BUCKET_BYTES).bit_length())
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(doc.alias("doc"), text.alias("text"), F.xxhash64(text).alias("row"), F.shiftrightunsigned(F.xxhash64(doc), 64 - ROW_BITS).alias("place"), F.col("doc_id").cast("long").alias("doc_id"))
    twice = bit_map(slim.groupBy("doc", "place").agg(F.count("*").alias("n")).where("n > 1").select("place"), ROW_BITS)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, r, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(unplanes(d, np.int64)), pa.array(unplanes(r, np.int64)), pa.array(unplanes(s, np.int32)), pa.array(unplanes(e, np.int32))], names=["doc", "row", "start", "end"])

    flat = repeated_spans(slim.drop("doc_id"), bits, twice).mapInArrow(unpack, "doc long, row long, start int, end int")
    per_row = materialize(flat.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("s")).select("doc", "row", F.col("s.start").alias("start"), F.col("s.end").alias("end")))
    touched = bit_map(per_row.select(F.shiftrightunsigned(F.xxhash64("doc"), 64 - ROW_BITS).alias("place")), ROW_BITS)
    shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    shape_sql = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def row_of(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        removed, runs, kept = cut_spans(data, start, end) if len(start) else (0, 0, data)
        return len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 5, shape.types[1:], strict=True))], schema=shape)

    def hits(batch: pa.RecordBatch) -> pa.Array:
        return pa.array(_on(touched.value, batch.column(4).to_numpy()), pa.bool_())

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            own = batch.filter(pc.invert(hits(batch)))
            yield batch_of(own.column(0), [row_of(x.as_py().encode("utf-8", "surrogatepass"), none, none) for x in own.column(1)])
        give_back()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.filter(hits(batch))
            raw = [x.as_py().encode("utf-8", "surrogatepass") for x in own.column(1)]
            packed = pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), packed, pa.array([len(x) for x in raw], pa.int64()), pa.array(row_marks(own, twice.value)), own.column(3)], names=["doc_id", "packed", "n_bytes", "row", "doc"])
        give_back()

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for text, s, e, size in zip(*batch.columns[1:], strict=True):
                data = pa.decompress(text.as_py(), size.as_py(), codec="zstd", asbytes=True)
                out.append(row_of(data, s.values.to_numpy() if s.is_valid else none, e.values.to_numpy() if s.is_valid else none))
            yield batch_of(batch.column(0), out)
        give_back()

    source = slim.select("doc_id", "text", "row", "doc", "place")
    packed = source.mapInArrow(pack, "doc_id long, packed binary, n_bytes long, row long, doc long")
    joined = packed.join(per_row, ["doc", "row"], "left").select("doc_id", "packed", "start", "end", "n_bytes")
    out = source.mapInArrow(whole, shape_sql).unionByName(joined.mapInArrow(finish, shape_sql))
    return out if keep_text else out.drop("kept")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(documents(spark, sf_dir), keep_text=False)

r"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled, gadget by gadget, into a deterministic automaton over tokens that accepts exactly the
token sequences BPE produces. Start: one state before any token and one after each, with arcs for all base symbols. All arcs with a label lead to the label's
state, so the automaton is a table of bits, a row for each state and a column for each label. The gadget of merge ``u v -> w``, where u may be followed by v,

    makes w's state, a copy of v's,
    takes the arc v off u's state,
    adds the arc w to all states that then have the arc u.

The driver compiles the table once; it is sent packed, and has at most a bit for each pair of tokens of the vocabulary. A word is
encoded in one pass from left to right: a finder of all tokens names those that end at each place, and of these exactly one
has an arc from the state of the place where it begins. That state is the place's, and no place is visited again. Decoding emits the labels of the arcs taken.

Normalising and cutting texts into words follows the tokenizer file (NFC, lower case, its split pattern); texts
are cut at white space first, so that each distinct piece is worked out once per worker, as far as its table of pieces has room.

Nulls: a null or empty text has no tokens; an empty table gives an empty result. Texts may be of any length; rows are encoded one by one, so ties and
repeated rows need no rule. Other columns are ignored, or passed through untouched by encode and decode.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, held

#: Distinct white-space pieces, and their tokens, that a worker remembers; when full, the table starts anew.
REMEMBER = 400_000
REMEMBER_TOKENS = 2_000_000
#: What a word ends with for the finder of tokens; no byte.
_END = "\u0100"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class TokenAutomaton:
    """The automaton of one vocabulary and merge list: compiled, or read from what packed() gave."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str, packed: bytes | None = None) -> None:
        import ahocorasick

        self.label = {i: t for t, i in vocab.items()}
        symbols = byte_symbols()
        base = [vocab[x] for x in symbols]
        base_end = [vocab[x + word_end] for x in symbols]
        rules = [(vocab[u], vocab[v], vocab[u + v], not v.endswith(word_end) or v == word_end) for u, v in merges]
        made = set(base) | set(base_end)
        for a, b, w, _ in rules:
            if a not in made or b not in made:
                raise ValueError(f"the merge into token {w} uses one that is not there yet")
            made.add(w)
        # Rows of the table: the start, then tokens that do not end a word, in the order they come up.
        inside = list(dict.fromkeys([*base, *(w for *_, w, inner in rules if inner)]))
        self.row = {x: i + 1 for i, x in enumerate(inside)}
        width = (max(vocab.values()) >> 3) + 1
        shape = (len(inside) + 1, width)
        table = self._compiled(shape, base, base_end, rules) if packed is None else np.frombuffer(pa.decompress(packed, shape[0] * width, codec="zstd", asbytes=True), np.uint8).reshape(shape)
        self.table = np.ascontiguousarray(table)
        self.rows = {x: memoryview(self.table[i]) for x, i in self.row.items()} | {-1: memoryview(self.table[0])}
        back = {c: chr(b) for b, c in enumerate(symbols)}
        self.finder = ahocorasick.Automaton()
        for t, i in vocab.items():
            end = t.endswith(word_end) and len(t) > len(word_end)
            body = t[: -len(word_end)] if end else t
            if i in made and all(c in back for c in body):
                spelling = "".join(back[c] for c in body) + (_END if end else "")
                self.finder.add_word(spelling, (i, len(spelling)))
        self.finder.make_automaton()

    def _compiled(self, shape: tuple[int, int], base: list[int], base_end: list[int], rules: list[tuple[int, int, int, bool]]) -> np.ndarray:
        table = np.zeros(shape, np.uint8)
        there = len(base) + 1
        for x in (*base, *base_end):
            table[:there, x >> 3] |= np.uint8(1 << (x & 7))
        known = set(base)
        for u, v, w, inner in rules:
            at = self.row[u]
            if not table[at, v >> 3] >> (v & 7) & 1:
                continue  # u is never followed by v any more
            if inner and w not in known:
                known.add(w)
                table[self.row[w]] = table[self.row[v]]
                there = max(there, self.row[w] + 1)
            table[at, v >> 3] &= np.uint8(~(1 << (v & 7)) & 255)
            table[:there, w >> 3] |= (table[:there, u >> 3] >> np.uint8(u & 7) & np.uint8(1)) << np.uint8(w & 7)
        return table

    def packed(self) -> bytes:
        return pa.compress(self.table.tobytes(), codec="zstd", asbytes=True)

    def arc(self, t: int, x: int) -> bool:
        """Whether x may follow t (-1: the start) in a tokenization."""
        return t in self.rows and bool(self.rows[t][x >> 3] >> (x & 7) & 1)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The tokens of a word, from the token that ends at each of its places."""
        n = len(word) + 1
        rows = self.rows
        last, size = [-2] * (n + 1), [0] * (n + 1)
        state: list = [None] * (n + 1)
        state[0] = rows[-1]
        for end, (x, m) in self.finder.iter(word.decode("latin-1") + _END):
            at = end + 1
            if last[at] == -2 and (row := state[at - m]) is not None and row[x >> 3] >> (x & 7) & 1:
                last[at], size[at] = x, m
                state[at] = rows.get(x)
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return tuple(out[::-1])


#: White space of the split pattern; str.split() also cuts at \x1c-\x1f, which the pattern does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


class Tokenizer:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, spec: dict, packed: bytes | None = None) -> None:
        import regex
        import tokenizers

        model = spec["model"]
        library = tokenizers.Tokenizer.from_str(json.dumps(spec))
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.bytes_of = {s: b for b, s in enumerate(byte_symbols())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"], packed)
        self.names = {**self.automaton.label, **{i: t for t, i in self.added.items()}}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.held = 0

    def piece(self, piece: str) -> tuple[int, ...]:
        """Token ids of a piece without white space."""
        out: list[int] = []
        if max(piece) < "\u0250":
            words = [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", piece).lower())]
        else:  # character classes beyond Latin differ between Unicode versions: the library's own hold
            words = [bytes(self.bytes_of[c] for c in w) for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(piece))]
        for word in words:
            out.extend(self.automaton.encode_word(word))
        got = tuple(out)
        if len(piece) <= 64:
            if len(self.pieces) >= REMEMBER or self.held >= REMEMBER_TOKENS:
                self.pieces.clear()
                self.held = 0
            self.pieces[piece] = got
            self.held += len(got)
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces, add = self.pieces, out.extend
        parts = self.special.split(text) if self.special and "<|" in text else (text,)
        for part in parts:
            if part in self.added and len(parts) > 1:
                out.append(self.added[part])
                continue
            for piece in _SPACE.split(part) if _ODD_SPACE.search(part) else part.split():
                if piece:
                    ids = pieces.get(piece)
                    add(self.piece(piece) if ids is None else ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs taken; this file names no decoder, so they are joined by spaces."""
        names = self.names
        return " ".join([names[i] for i in ids])


#: Tokenizers of this worker (over 100 MB each, and the pieces that they remember), until a task of another operator runs in it.
_loaded: dict[str, Tokenizer] = held("bpe")


def load(spec: str, packed: bytes | None = None) -> Tokenizer:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Tokenizer(json.loads(spec), packed)
        give_back()
    return _loaded[key]


def sent(spark: SparkSession, path: str):
    """The tokenizer file and the compiled table, read and made on the driver, for the workers (a vocabulary has a fixed size)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _tables:
        model = json.loads(spec)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        _tables[key] = TokenAutomaton(model["vocab"], merges, model["end_of_word_suffix"]).packed()
    return spark.sparkContext.broadcast((spec, _tables[key]))


_tables: dict[str, bytes] = {}


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids, an array of token ids."""
    spec = sent(df.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(*spec.value)
        for batch in batches:
            yield pd.Series([tokenizer.encode(t or "") for t in batch])

    return df.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of an array of token ids."""
    spec = sent(df.sparkSession, path)

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load(*spec.value)
        for batch in batches:
            yield pd.Series([tokenizer.decode(x if x is not None else ()) for x in batch])

    return df.withColumn("decoded", back(F.col(ids)))


def token_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, without the ids leaving the worker."""
    spec = sent(df.sparkSession, path)
    shape = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("a", pa.string()), ("b", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(*spec.value)
        for batch in batches:
            n, a, b = [], [], []
            for value in batch.column(1):
                ids = tokenizer.encode(value.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
                b.append(hashlib.sha256(tokenizer.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((n, a, b), shape.types[1:], strict=True))], schema=shape)
        give_back()

    out = df.select(F.col(key).cast("long").alias("k"), text).mapInArrow(run, "k long, n long, a string, b string")
    return out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")


def word_bpe_path() -> str:
    """Where the installed package of public vocabularies keeps the file."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir), word_bpe_path())

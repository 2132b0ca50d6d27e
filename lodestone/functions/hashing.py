"""Content hashes: SHA-256 checksums, tagged fact hashes, 64-bit FNV ids and the hashed embedding."""

from __future__ import annotations

import hashlib
import struct
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def checksum(payload: Column) -> Column:
    return F.sha2(payload, 256)


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & (2**64 - 1)
    return h


def fnv1a_all(values: list[bytes]) -> np.ndarray:
    """The hashes of many byte strings, a place of all of them at a time."""
    size = np.array([len(v) for v in values], np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    h = np.full(len(values), FNV_OFFSET, np.uint64)
    longer = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # how many have a byte at each place
    for i, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ data[start[:n] + i]) * np.uint64(FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def fold(text: str) -> str:
    """The canonical form of an alias: NFKC, case and accents folded, white space collapsed."""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(unicodedata.normalize("NFC", "".join(c for c in plain if not unicodedata.combining(c))).split())


@F.pandas_udf(T.StringType())
def alias_norm(alias: pd.Series) -> pd.Series:
    return alias.map(lambda a: None if a is None else fold(a))


@F.pandas_udf(T.StringType())
def fnv_hex(text: pd.Series) -> pd.Series:
    got = fnv1a_all([b"" if t is None else t.encode() for t in text])
    return pd.Series([None if t is None else f"{h:016x}" for t, h in zip(text, got.tolist(), strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def fact_hash(subject: pd.Series, predicate: pd.Series, kind: pd.Series, value: pd.Series) -> pd.Series:
    """SHA-256 over length-prefixed normalised parts: facts that differ in case or accents only are one fact."""

    def one(s: str, p: str, k: int, v: str) -> str:
        parts = [fold(s or ""), fold(p or ""), fold(v or "") if k == 1 else v or ""]
        body = b"".join(struct.pack("<I", len(x.encode())) + x.encode() for x in parts)
        return hashlib.sha256(struct.pack("<B", int(k)) + body).hexdigest()

    return pd.Series([one(*row) for row in zip(subject, predicate, kind, value, strict=True)])


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """A model-free embedding: each token adds or subtracts 1 at a hashed place; unit length."""
    out = np.zeros(dims)
    for token in "".join(c.lower() if c.isalnum() else " " for c in text).split():
        h = fnv1a(token.encode())
        out[h % dims] += -1.0 if h >> 63 else 1.0
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_vector(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hash_embedding(t or ""))

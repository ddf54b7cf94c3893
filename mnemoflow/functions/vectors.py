"""Vector arithmetic and the feature-hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .wordlists import STOPWORDS

_MASK = (1 << 64) - 1


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; 0 for vectors of different length or none."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def fnv1a(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as struct(hi, lo) of 32-bit halves, which stays within a long at every step."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.conv(h, 16, 10).cast("long"))

    def step(s: Column, b: Column) -> Column:
        lo = s["lo"].bitwiseXOR(b)
        f = lo * 435
        hi = (s["hi"] * 435 + F.shiftright(f, 32) + F.shiftleft(lo, 8)).bitwiseAND(0xFFFFFFFF)
        return F.struct(hi.alias("hi"), f.bitwiseAND(0xFFFFFFFF).alias("lo"))

    return F.aggregate(codes, F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo")), step)


def fnv1a_py(raw: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 & _MASK
    return h


@lru_cache(maxsize=1 << 15)
def _cells(token: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and signed weights of a token and its character trigrams."""
    weight = 0.2 if token in _STOP else 1.0
    padded = f"^{token}$"
    features = [(token, weight)] + [(padded[i : i + 3], 0.4 * weight) for i in range(len(padded) - 2)]
    hashed = [(fnv1a_py(f.encode()), w) for f, w in features]
    return np.array([h % dim for h, _ in hashed]), np.array([-w if h >> 32 & 1 else w for h, w in hashed])


_STOP = frozenset(STOPWORDS)


def hash_vector(tokens, dim: int) -> np.ndarray:
    v = np.zeros(dim)
    for t in tokens:
        at, w = _cells(t, dim)
        np.add.at(v, at, w)
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


class HashEmbedder:
    """Signed feature hashing of tokens and character trigrams. Tokens come as one string a text and vectors leave in
    pieces of ``piece`` rows, so a worker holds no batch of boxed numbers; the cache of tokens is bounded."""

    def __init__(self, dim: int = 256, piece: int = 256):
        self.dim, self.piece = dim, piece
        self.id = f"hash-v1-{dim}"

    def embed(self, text: Column) -> Column:
        dim, piece = self.dim, self.piece

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                for at in range(0, len(b), piece):
                    yield pd.Series([hash_vector(t.split(" ") if t else (), dim) for t in b.iloc[at : at + piece]])

        return run(F.array_join(T.tokens(text), " "))

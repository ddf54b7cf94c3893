"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

The documents are read once and never shuffled. The benchmark is broadcast in blocks of at most ``block_bytes`` of text;
a benchmark within one block (the usual case) takes a single pass, a larger one a pass a block, whose hits add up row by
row. A window's hash is looked up first; a hit counts only if its words are equal.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes to lower case, and all that is not a letter, digit or part of a non-ASCII character to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FIELDS = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"


def words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(NORMAL).split()


class NGrams:
    """Windows of benchmark items by length: the hash set, the word ids to verify with, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, raw in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(raw)]
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                found.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), set()).add(item)
        self.by_length = []
        for k, windows in sorted(found.items()):
            ids = np.array(list(windows), np.uint64).reshape(-1, k)
            hashes = self.hash(ids.T)
            order = np.argsort(hashes, kind="stable")
            names = [sorted(x for x in s if x is not None) for s in windows.values()]
            self.by_length.append((k, hashes[order], ids[order], [names[i] for i in order]))

    @staticmethod
    def hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c) * _PRIME
            h ^= h >> np.uint64(29)
        return h

    def scan(self, tokens: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a window, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, tokens, itertools.repeat(0)), np.uint64, len(tokens))
        hit, items = np.zeros(len(tokens) + 1, np.int32), set()
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        for k, hashes, own, names in self.by_length:
            if len(tokens) < k:
                continue
            start = np.flatnonzero(strange[k:] == strange[:-k])
            if not len(start):
                continue
            h = self.hash([ids[start + i] for i in range(k)])
            at = np.searchsorted(hashes, h)
            maybe = np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == h)
            for s, a in zip(start[maybe], at[maybe]):
                while a < len(hashes) and hashes[a] == h[np.searchsorted(start, s)]:
                    if (own[a] == ids[s : s + k]).all():
                        hit[s] += 1
                        hit[s + k] -= 1
                        items.update(names[a])
                        break
                    a += 1
        return np.cumsum(hit[:-1]) > 0, items


def _runs(flag: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _pass(grams, text_at: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = grams.value
        for b in batches:
            names = b.schema.names if first else b.schema.names[:-3]
            old_hits, old_items = (None, None) if first else (b.column("hits").to_pylist(), b.column("items").to_pylist())
            n_words, hits, items = [], [], []
            for i, raw in enumerate(common.utf8(b.column(text_at))):
                w = words(raw)
                flag, found = index.scan(w)
                if not first:
                    found |= set(old_items[i])
                    for h in old_hits[i]:
                        flag[h["start"] : h["end"]] = True
                n_words.append(len(w))
                hits.append(_runs(flag))
                items.append(sorted(found))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            new = [pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + new, names=[*names, "n_words", "hits", "items"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 10, block_bytes: int = 16 << 20, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, hits (runs of word positions inside a benchmark window), items (ids as
    strings, sorted), and the columns named in ``carry`` as c0, c1, ....

    A null or empty text has no words and no hits; nor has any document if the benchmark is empty. An item of fewer
    than ``n`` words is one window. Hits of an item with a null id count, but it isn't listed. Repeated rows, items and
    ids are allowed; other columns are ignored.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("words"))
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry or [])])
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", " + _FIELDS
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k)
        grams = NGrams([(r.item, None if r.words is None else r.words.encode()) for r in part.toLocalIterator()], n)
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(grams), 1, k == 0), kind)
        if k < blocks - 1:
            out = common.materialize(out, "decontaminate")
    return out.drop("text")


_WORD = re.compile(rb"[^ ]+")


def remove_spans(raw: bytes | None, hits: list[dict]) -> bytes | None:
    """The text without the bytes from the first to the last word of each run of hit words."""
    if not hits:
        return raw
    at = [m.span() for m in _WORD.finditer(raw.translate(NORMAL))]
    kept, pos = [], 0
    for h in hits:
        kept.append(raw[pos : at[h["start"]][0]])
        pos = at[h["end"] - 1][1]
    return b"".join([*kept, raw[pos:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", **options) -> DataFrame:
    """The columns of ``docs`` without the hit documents, or (``remove="spans"``) all rows without the hit spans of their texts."""
    names = docs.columns
    found = find(docs, benchmark, text_col=text_col, carry=names, **options)
    if remove == "documents":
        return found.filter(F.size("hits") == 0).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    at = names.index(text_col)

    def run(batches):
        for b in batches:
            raw = [remove_spans(t, h) for t, h in zip(common.utf8(b.column(at)), b.column(len(names)).to_pylist())]
            cols = [b.column(i) if i != at else pa.array([None if x is None else x.decode() for x in raw], pa.string()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return found.select(*[f"c{i}" for i in range(len(names))], "hits").mapInArrow(run, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest of ``find``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h.end - h.start)
    return find(docs, benchmark, **options).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

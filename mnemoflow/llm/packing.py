"""Lexical retrieval packing of token windows.

Texts are tokenised once, and their pieces are kept as a table. A document fills as many whole windows as it can; the
rest of it (shorter than a window) is packed with other rests. These are dealt to shards of about ``shard_units`` by
ranges of a minimum hash of their token pairs, so texts that share much meet, while a hot group splits over shards by
id. BM25 counts units, lengths and terms over the rests of all shards; each shard is an inverted index of its own rests: a seed takes its best unused neighbours, by all its terms, until the window is full,
the last one cut; what is left of that is the next seed. Only a shard's very last window can need padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .tokens import Encoder

_FULL = 1 << 61


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _signature(ids: np.ndarray) -> int:
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64) if len(ids) > 1 else ids.astype(np.uint64)
    h = pairs * np.uint64(0x9E3779B97F4A7C15)
    return int(((h ^ (h >> np.uint64(31))) >> np.uint64(1)).min())


def _tokenize(path: str, window: int, end: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("sig", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        number = _FULL | TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.array([end], encoder.dtype))
                full = len(ids) // window
                for k in range(full):
                    part = ids[k * window : (k + 1) * window]
                    rows.append((doc.as_py(), k * window, window, len(ids), part.tobytes(), ids_crc32(part), number, None))
                    number += 1
                part = ids[full * window :]
                if len(part):
                    rows.append((doc.as_py(), full * window, len(part), len(ids), part.tobytes(), 0, None, _signature(part)))
                held += 2 * len(ids) + 64
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    return run


@dataclass
class Statistics:
    """What BM25 knows of all units: how many there are, their mean length, and the units with each token id."""

    units: int
    mean: float
    df: np.ndarray


def _count_terms(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    df, units, tokens = np.zeros(0, np.int64), 0, 0
    for b in batches:
        for raw in b.column(0).to_pylist():
            ids = np.frombuffer(raw, dtype)
            found = np.unique(ids)
            if found[-1] >= len(df):
                df = np.append(df, np.zeros(found[-1] + 1 - len(df), np.int64))
            df[found] += 1
            units, tokens = units + 1, tokens + len(ids)
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [units, tokens]))], names=["term", "n"])


def count_terms(units: DataFrame, dtype: np.dtype) -> Statistics:
    """Statistics of the column ``ids`` over all rows; their size is the vocabulary's, whatever the number of rows."""
    made = units.select("ids").mapInArrow(lambda batches: _count_terms(batches, dtype), "term long, n long")
    n = {r.term: r.n for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(max(n, default=-1) + 1, np.int64)
    for term, k in n.items():
        if term >= 0:
            df[term] = k
    return Statistics(n.get(-1, 0), n.get(-2, 0) / max(1, n.get(-1, 0)), df)


class Index:
    """BM25 over the units of a shard, whose terms are token ids, with the statistics of all units (without them, the shard's)."""

    def __init__(self, units: list[np.ndarray], whole: Statistics | None = None, k1: float = 1.2, b: float = 0.75):
        n = np.array([len(u) for u in units])
        unit = np.repeat(np.arange(len(units), dtype=np.int64), n)
        term = np.concatenate(units).astype(np.int64)
        pair, tf = np.unique(unit << 32 | term, return_counts=True)
        unit, term = pair >> 32, pair & 0xFFFFFFFF
        self.first = np.searchsorted(unit, np.arange(len(units) + 1))
        terms, place, df = np.unique(term, return_inverse=True, return_counts=True)
        count, mean = len(units), n.mean()
        if whole is not None:
            count, mean, df = whole.units, whole.mean, whole.df[terms]
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n[unit] / mean))
        self.place, self.weight = place, weight
        self.size = len(units)
        # Terms in many units are multiplied out for all pairs of units, in blocks of terms; of the others the places are kept.
        local = np.bincount(place, minlength=len(terms))
        often = local * 32 >= len(units)
        row, dense = np.where(often, np.cumsum(often) - 1, -1)[place], often[place]
        self.common = np.zeros((len(units), len(units)), np.float32)
        for at in range(0, int(often.sum()), 1024):
            own = np.flatnonzero((row >= at) & (row < at + 1024))
            has, gives = np.zeros((len(units), 1024), np.float32), np.zeros((1024, len(units)), np.float32)
            has[unit[own], row[own] - at] = 1
            gives[row[own] - at, unit[own]] = weight[own]
            self.common += has @ gives
        order = np.flatnonzero(~dense)
        order = order[np.argsort(place[order], kind="stable")]
        self.unit_of, self.weight_of = unit[order], weight[order]
        self.start = np.searchsorted(place[order], np.arange(len(terms) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Each unit's BM25 score for all distinct terms of the seed."""
        place = self.place[self.first[seed] : self.first[seed + 1]]
        start = self.start[place]
        n = self.start[place + 1] - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.common[seed] + np.bincount(self.unit_of[at], weights=self.weight_of[at], minlength=len(self.common))


def pack_shard(units: list[np.ndarray], window: int, whole: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows of a shard as lists of (unit, from, to): a seed, then its best unused neighbours, the last one cut."""
    index = Index(units, whole)
    used = np.zeros(len(units), bool)
    seed, begin, next_free = 0, 0, 0
    while True:
        if begin == 0:
            while next_free < len(units) and used[next_free]:
                next_free += 1
            if next_free == len(units):
                return
            seed = next_free
            used[seed] = True
        row = [(seed, begin, len(units[seed]))]
        room = window - (len(units[seed]) - begin)
        begin = 0
        if room:
            score = index.scores(seed)
            score[used] = -1
            few = min(len(units), 64)
            while room:
                best = np.argpartition(-score, few - 1)[:few] if few < len(units) else np.arange(len(units))
                best = best[np.lexsort((best, -score[best]))]
                best = best[score[best] >= 0]
                for u in best:
                    used[u], score[u] = True, -1
                    take = min(room, len(units[u]))
                    row.append((int(u), 0, take))
                    room -= take
                    if not room:
                        seed, begin = int(u), take if take < len(units[u]) else 0
                        break
                if not len(best):
                    break
        yield row


def _pack(window: int, shard_units: int, dtype, id_type: pa.DataType, whole):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def solve(t: pa.Table, number: int):
        docs, starts, totals = t.column("doc_id").to_pylist(), t.column("start").to_numpy(), t.column("doc_tokens").to_numpy()
        units = [np.frombuffer(x, dtype) for x in t.column("ids").to_pylist()]
        rows = []
        for row in pack_shard(units, window, whole.value):
            offset = 0
            for u, a, b in row:
                part = units[u][a:b]
                rows.append((docs[u], int(starts[u]) + a, b - a, int(totals[u]), part.tobytes(), ids_crc32(part), number, offset))
                offset += b - a
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 36, []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= 2 * shard_units:
                t = pa.Table.from_batches(held).combine_chunks()
                yield from solve(t.slice(0, shard_units), number)
                number += shard_units
                held = t.slice(shard_units).to_batches()
        if sum(x.num_rows for x in held):
            yield from solve(pa.Table.from_batches(held).combine_chunks(), number)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_units: int = 2048) -> DataFrame:
    """Pieces of all documents, each of whose ids (text, then ``end``) lies in exactly one: doc_id, start, length,
    doc_tokens, ids (little-endian, 2 bytes an id if the vocabulary allows, else 4), ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat are documents of their own. A sequence holds at most
    ``window`` ids, gapless from offset 0. Whole windows of a long document are sequences of their own; retrieval packs
    what is left of each, shorter than a window. An empty table gives no pieces; other columns are ignored, ids may be of
    any type and null; a text must fit a task's memory some ten times over.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    encoder = Encoder(tokenizer)
    if not 0 < window < 1 << 30:
        raise ValueError("the window must be positive")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_tokenize(tokenizer, window, end, id_type), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, ids_crc32 long, sequence_id long, sig long")
    made = common.materialize(made, "packing-pieces")
    rest = made.filter("sequence_id is null").select("sig", "doc_id", "start", "doc_tokens", "ids")
    whole = count_terms(rest, encoder.dtype)
    shards = max(1, -(-whole.units // (4 * shard_units)))
    rest = rest.repartitionByRange(shards, "sig", "doc_id", "start").sortWithinPartitions("sig", "doc_id", "start", "ids")
    fields = f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, ids_crc32 long, sequence_id long, offset long"
    packed = rest.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(window, shard_units, encoder.dtype, id_type, docs.sparkSession.sparkContext.broadcast(whole)), fields)
    full = made.filter("sequence_id is not null").drop("sig").withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(packed)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids) with the pieces' ids joined in order; a sequence's pieces fit in its window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), joined.alias("ids"))

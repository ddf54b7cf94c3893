"""Language-model scoring from a log-frequency Bloom filter.

Counts of words, word pairs and word triples over all training texts are quantised to levels (powers of ``BASE``), and
an n-gram of level 3 is in the filter three times, as items 1 to 3. A probe asks for item 1, 2, ... until one is missing;
the last one found is the level.

The filter grows with the corpus, so it is cut into segments by hash range, and what travels is not the filter but the
probes, each distinct n-gram of a block of texts once:

1. Texts are written once in blocks. Each block sends every segment its distinct n-grams of that range with their
   training counts, and its distinct words likewise.
2. A segment's task adds the counts up, sets the segment's bits from them, probes its filter for all n-grams it was
   sent, and returns a byte an n-gram, and exact counts for words.
3. Each block looks the levels up for its tokens: one row a document, with the levels of each token.

So texts are read three times and n-grams shuffled once, whatever the size of the corpus; no table has to fit on a worker.

Triple, pair and word probabilities are interpolated; the weight for each level of a context comes from expectation
maximisation over all training texts with their own occurrence left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BASE, TOP = 1.5, 60
BITS_PER_ITEM, HASHES = 8, 4
_END = xxhash.xxh3_64_intdigest(b"\n")  # no word contains white space
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW32 = np.uint64((1 << 32) - 1)
_EDGES = BASE ** np.arange(TOP + 1)


def level_of(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, growing with its logarithm; 0 for none."""
    return np.minimum(np.searchsorted(_EDGES, np.asarray(count, float) * (1 + 1e-12), "right"), TOP).astype(np.int64)


def _values() -> np.ndarray:
    """The count that each level stands for: the mean of the whole numbers in its range."""
    out = np.zeros(TOP + 1)
    for k in range(1, TOP + 1):
        lo, hi = math.ceil(_EDGES[k - 1] - 1e-9), math.ceil(_EDGES[k] - 1e-9) - 1
        out[k] = (lo + hi) / 2 if hi >= lo else _EDGES[k - 1]
    return out


VALUE = _values()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens one after another (a text's words, then the end), and how many each text has."""
    parts, sizes = [], np.ones(len(texts), np.int64)
    end = np.array([_END], np.uint64)
    for i, raw in enumerate(texts):
        for words in common.word_blocks((raw or b"").lower()):
            sizes[i] += len(words)
            parts.append(words)
        parts.append(end)
    lists = [p for p in parts if p is not end]
    flat = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))
    out = np.empty(len(flat) + len(texts), np.uint64)
    last = np.cumsum(sizes) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = flat, _END
    return out, sizes


def gram_keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pair and the triple that end at each token; before a text's first token stand two ends."""
    first = np.cumsum(sizes) - sizes
    before = np.empty_like(h)
    before[1:], before[first] = h[:-1], _END
    pair = _mix(_mix(before) * np.uint64(3) + h)
    context = np.empty_like(h)
    context[1:], context[first] = pair[:-1], _GOLD
    return pair, _mix(_mix(context) * np.uint64(5) + h)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int64)


def _routed(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segment and the key within it: 32 bits, as a segment holds far fewer keys."""
    return segment_of(keys, segments).astype(np.uint64) << np.uint64(32) | keys & _LOW32


def _bits(keys: np.ndarray, item: np.ndarray | int, size: np.uint64):
    """The bits of a key's item in a segment of ``size`` bits, fewer than 2^32."""
    with np.errstate(over="ignore"):
        x = _mix(keys + np.uint64(1) + np.asarray(item, np.uint64) * _GOLD)
    a, b = x & _LOW32, (x >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((((a + np.uint64(i) * b) & _LOW32) * size) >> np.uint64(32)).astype(np.int64)


class Segment:
    """A segment of the filter: 32-bit keys, each in it as often as its count's level says."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits_per_item: int = BITS_PER_ITEM):
        level = level_of(counts)
        self.size = np.uint64(max(64, int(level.sum()) * bits_per_item))
        bits = np.zeros(int(self.size), bool)
        item = 1
        while len(keys):
            for at in _bits(keys, item, self.size):
                bits[at] = True
            item += 1
            go = level >= item
            keys, level = keys[go], level[go]
        self.data = np.packbits(bits, bitorder="little")

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; of one that is not in the segment 0, but for a false positive."""
        out = np.zeros(len(keys), np.uint8)
        at = np.arange(len(keys))
        for item in range(1, TOP + 1):
            alive = np.arange(len(at))
            x = _mix(keys[at] + np.uint64(1) + np.uint64(item * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            a, b = x & _LOW32, (x >> np.uint64(32)) | np.uint64(1)
            for i in range(HASHES):  # most misses show at the first bit
                p = ((((a[alive] + np.uint64(i) * b[alive]) & _LOW32) * self.size) >> np.uint64(32)).astype(np.int64)
                alive = alive[(self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
            at = at[alive]
            if not len(at):
                break
            out[at] = item
        return out


def _word_key(h: np.ndarray) -> np.ndarray:
    return _mix(h ^ _GOLD) & _LOW32


def _pack_counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """A byte a count, and in full those that a byte cannot hold."""
    return np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<u8").tobytes()


def _unpack_counts(small: bytes, big: bytes) -> np.ndarray:
    c = np.frombuffer(small, np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(big, "<u8")
    return c


class _Block:
    """The tokens of a block file and their distinct words and n-grams, in the order in which segments get them."""

    def __init__(self, path: str, root: str, segments: int):
        self.table = common.read_block(path, root)
        texts = [x for c in self.table.column("text").chunks for x in common.utf8(c)]
        self.train = self.table.column("train").to_numpy()
        self.h, self.sizes = token_hashes(texts)
        self.grams = [_routed(k, segments) for k in gram_keys(self.h, self.sizes)]
        self.segments = segments

    def counted(self) -> Iterator[tuple[int, tuple]]:
        """For each segment its words (64-bit hashes) and n-gram keys with their counts in training texts."""
        own = np.repeat(self.train, self.sizes)
        words, w = _distinct(self.h, own)
        grams, n = _distinct(np.concatenate(self.grams), np.concatenate([own, own]))
        cut = _bounds(segment_of(words, self.segments), self.segments)
        gut = _bounds((grams >> np.uint64(32)).astype(np.int64), self.segments)
        for s in np.flatnonzero(np.diff(cut) + np.diff(gut)):
            a, b = slice(cut[s], cut[s + 1]), slice(gut[s], gut[s + 1])
            yield int(s), (words[a].astype("<u8").tobytes(), *_pack_counts(w[a]), (grams[b] & _LOW32).astype("<u4").tobytes(), *_pack_counts(n[b]))

    def levels(self, counts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's exact count, and the levels of its word, pair and triple, from those of the distinct ones."""
        words, place = np.unique(self.h, return_inverse=True)
        flat = np.concatenate(self.grams)
        grams, where = np.unique(flat, return_inverse=True)
        if len(words) != len(counts) or len(grams) + len(words) != len(levels):
            raise RuntimeError("a block's levels are not all there")
        n = len(self.h)
        return counts[place], np.stack([levels[: len(words)][place], levels[len(words) :][where[:n]], levels[len(words) :][where[n:]]], axis=1)


def _bounds(segment: np.ndarray, segments: int) -> np.ndarray:
    return np.searchsorted(segment, np.arange(segments + 1))


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each are ``counted``."""
    if counted.all():
        u, n = np.unique(keys, return_counts=True)
        return u, n
    u, place = np.unique(keys, return_inverse=True)
    return u, np.bincount(place, counted, len(u)).astype(np.int64)


_SENT = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("block", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("words", "w", "w_big", "grams", "n", "n_big"))])
_BACK = T.StructType([T.StructField("block", T.LongType()), T.StructField("segment", T.IntegerType()), T.StructField("path", T.StringType()), *(T.StructField(n, T.BinaryType()) for n in ("counts", "word_levels", "levels")), *(T.StructField(n, T.LongType()) for n in ("distinct", "tokens"))])


def _send(root: str, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, path in zip(b.column("block").to_pylist(), b.column("path").to_pylist()):
                rows, size = [], 0
                for s, parts in _Block(path, root, segments).counted():
                    rows.append((s, block, *parts))
                    size += sum(map(len, parts))
                    if size > 8 << 20:
                        yield common.rows_batch(rows, _SENT)
                        rows, size = [], 0
                if rows:
                    yield common.rows_batch(rows, _SENT)

    return run


def _answer(bits_per_item: int):
    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        segment = rows[0][0]
        words = np.concatenate([np.frombuffer(r[2], "<u8") for r in rows])
        grams = np.concatenate([np.frombuffer(r[5], "<u4") for r in rows]).astype(np.uint64)
        w = np.concatenate([_unpack_counts(r[3], r[4]) for r in rows])
        n = np.concatenate([_unpack_counts(r[6], r[7]) for r in rows])
        words, w_place = np.unique(words, return_inverse=True)
        grams, n_place = np.unique(grams, return_inverse=True)
        w = np.bincount(w_place, w, len(words)).astype(np.int64)
        n = np.bincount(n_place, n, len(grams)).astype(np.int64)
        keys = np.concatenate([_word_key(words), grams])
        total = np.concatenate([w, n])
        level = Segment(keys[total > 0], total[total > 0], bits_per_item).probe(keys)
        word_level, gram_level = level[: len(words)][w_place], level[len(words) :][n_place]
        count = w[w_place]
        yield common.rows_batch([(-1, segment, None, None, None, None, int((w > 0).sum()), int(w.sum()))], _BACK)
        a = b = size = 0
        out = []
        for r in rows:
            c, d = a + len(r[3]), b + len(r[6])
            out.append((r[1], segment, None, count[a:c].astype("<u8").tobytes(), word_level[a:c].tobytes(), gram_level[b:d].tobytes(), None, None))
            size += 9 * (c - a) + d - b
            a, b = c, d
            if size > 4 << 20:
                yield common.rows_batch(out, _BACK)
                out, size = [], 0
        if out:
            yield common.rows_batch(out, _BACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and r[0] != held[0][0]:
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    return run


def _look_up(root: str, segments: int):
    names = ["doc_id", "train", "n_tokens", "n_known", "logs", "levels"]

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block = _Block(rows[0][2], root, segments)
        rows = rows[1:]
        counts = np.concatenate([np.frombuffer(r[3], "<u8") for r in rows]).astype(np.int64)
        levels = np.concatenate([np.frombuffer(r[k], np.uint8) for k in (4, 5) for r in rows])
        count, level = block.levels(counts, levels)
        first = np.cumsum(block.sizes) - block.sizes
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        logs = np.add.reduceat(np.log10(count + 0.1), first)
        ends = np.append(first, len(count))
        ids = block.table.column("doc_id").combine_chunks()
        for at in range(0, len(first), 1000):
            to = min(at + 1000, len(first))
            some = [pa.array(x[at:to]) for x in (block.train, block.sizes, known, logs)]
            raw = pa.array([level[ends[i] : ends[i + 1]].T.tobytes() for i in range(at, to)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *some, raw], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if held and r[0] != held[0][0]:
                    yield from solve(held)
                    held = []
                held.append(r)
        if held:
            yield from solve(held)

    return run


def _unpack_levels(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """(first token of each text, word level, word level before, pair level, pair level before, triple level) of texts one after another."""
    parts = [np.frombuffer(x, np.uint8).reshape(3, -1) for x in raw]
    sizes = np.array([p.shape[1] for p in parts])
    first = np.cumsum(sizes) - sizes
    word, pair, triple = np.concatenate(parts, axis=1)
    last = np.cumsum(sizes) - 1
    before, pair_before = np.empty_like(word), np.empty_like(pair)
    before[1:], pair_before[1:] = word[:-1], pair[:-1]
    before[first], pair_before[first] = word[last], word[last]  # a text begins after an end, and two ends occur as often as one
    return first, word, before, pair, pair_before, triple


def _slices(b: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes in a binary column, or one row."""
    size = np.cumsum([len(x) for x in b.column(column).to_pylist()])
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


_P_STEPS = 8  # bins a decade of pair probabilities
_P_BINS = 255


def _p_bin(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * _P_STEPS), 0, _P_BINS).astype(np.int64)


def _pair_tables(weight: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 is taken later: probability of a token by (word level before, pair level, word level), flat."""
    p_word = np.minimum((VALUE + 0.1) / (n + 0.1 * (v + 1)), 1)
    pair = np.minimum(VALUE[None, :] / np.maximum(VALUE[:, None], 1), 1)
    p = weight[:, None, None] * pair[:, :, None] + (1 - weight)[:, None, None] * p_word[None, None, :]
    out = np.ones((64, 64, 64))
    out[: TOP + 1, : TOP + 1, : TOP + 1] = p
    return out.ravel()


def _pair_cells(word, before, pair) -> np.ndarray:
    return before.astype(np.int64) << 12 | pair.astype(np.int64) << 6 | word


def _histogram(cells_of, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, np.int64)
        for b in batches:
            raw = b.column(0).to_pylist()
            for at, to in _slices(b, 0):
                cells += np.bincount(cells_of(*_unpack_levels(raw[at:to])[1:]), minlength=size)
        own = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(cells[own])], names=["cell", "n"])

    return run


def interpolation(context: np.ndarray, gram: np.ndarray, lower: np.ndarray, count: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weight of the n-gram estimate for each level of its context, by expectation maximisation over levels of context
    and n-gram in the training texts, whose own occurrence is taken out of each count, against the ``lower`` order's probability."""
    p = np.clip((VALUE[gram] - 1) / np.maximum(VALUE[context] - 1, 1), 0, 1)
    weight = np.full(TOP + 1, 0.5)
    total = np.bincount(context, count, TOP + 1)
    for _ in range(rounds):
        a, b = weight[context] * p, (1 - weight[context]) * lower
        weight = np.where(total > 0, np.bincount(context, count * a / (a + b), TOP + 1) / np.maximum(total, 1), 0.0)
    weight[0] = 0
    return np.clip(weight, 0, 0.999)


def _evaluate(pair_p: np.ndarray, weight: np.ndarray):
    top = np.minimum(VALUE[None, :] / np.maximum(VALUE[:, None], 1), 1) * weight[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, out = b.column("levels").to_pylist(), []
            for at, to in _slices(b, b.schema.get_field_index("levels")):
                first, word, before, pair, pair_before, triple = _unpack_levels(raw[at:to])
                p = top[pair_before, triple] + (1 - weight)[pair_before] * pair_p[_pair_cells(word, before, pair)]
                out.append(np.add.reduceat(np.log10(p), first))
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(out))], names=[*b.schema.names[:-1], "score"])

    return run


def _cells(rows: DataFrame, cells_of, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = rows.mapInArrow(_histogram(cells_of, size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return np.array([r.cell for r in found], np.int64), np.array([r.n for r in found], float)


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, segment_bytes: int = 8 << 20, bits_per_item: int = BITS_PER_ITEM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``is_training`` chooses the rows whose texts are learnt from. Null and empty texts are the end token alone; a text
    has to fit a task's memory some ten times over. Repeated rows count and score as often as they occur. Without
    training rows every token is unknown, both scores are finite and n_known is 0; an empty table gives no rows. Ids may
    be of any type and null; other columns are ignored. Counts of words are exact as far as their 64-bit hashes differ.
    ``block_bytes`` and ``segment_bytes`` of text make a block and a segment of the filter; results do not depend on
    them but for the filter's false positives.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_training, F.lit(False)).alias("train"))
    root = common.scratch_path(spark, "lm-blocks")
    blocks = common.write_blocks(rows, root, "text", block_bytes)
    many, volume = blocks.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    segments = max(16, min(1 << 24, -(-(volume or 0) // segment_bytes)))
    tasks = max(1, min(many, 20_000))
    sent = blocks.select("block", "path").repartition(tasks, "block").mapInArrow(_send(root, segments), _SENT)
    back = sent.repartition(min(segments, 20_000), "segment").sortWithinPartitions("segment", "block").mapInArrow(_answer(bits_per_item), _BACK)
    back = common.materialize(back, "lm-answers")
    v, n = back.filter("block = -1").agg(F.sum("distinct"), F.sum("tokens")).first()
    v, n = v or 0, n or 0
    head = blocks.select("block", F.lit(-1).alias("segment"), "path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in _BACK.fields[3:]))
    every = head.unionByName(back.filter("block >= 0")).repartition(tasks, "block").sortWithinPartitions("block", "segment")
    kinds = [("doc_id", kind), ("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("logs", T.DoubleType()), ("levels", T.BinaryType())]
    levels = common.materialize(every.mapInArrow(_look_up(root, segments), T.StructType([T.StructField(*k) for k in kinds])), "lm-levels")
    common.release(back, blocks)
    common.delete(spark, root)
    known = levels.filter("train").select("levels")
    none = np.zeros(TOP + 1)
    cell, count = _cells(known, lambda word, before, pair, pair_before, triple: _pair_cells(word, before, pair), 1 << 18)
    p_word = (np.maximum(VALUE - 1, 0) + 0.1) / (n + 0.1 * (v + 1))
    pairs = interpolation(cell >> 12, cell >> 6 & 63, p_word[cell & 63], count) if len(cell) else none
    left_out = np.maximum(VALUE - 1, 0)
    lower = np.ones((64, 64, 64))
    share = np.clip(left_out[None, :] / np.maximum(left_out[:, None], 1), 0, 1)
    lower[: TOP + 1, : TOP + 1, : TOP + 1] = pairs[:, None, None] * share[:, :, None] + (1 - pairs)[:, None, None] * p_word[None, None, :]
    bins = _p_bin(lower.ravel())
    cell, count = _cells(known, lambda word, before, pair, pair_before, triple: pair_before.astype(np.int64) << 14 | triple.astype(np.int64) << 8 | bins[_pair_cells(word, before, pair)], 1 << 20)
    triples = interpolation(cell >> 14, cell >> 8 & 63, 10.0 ** -((cell & 255) / _P_STEPS), count) if len(cell) else none
    out = T.StructType([*(T.StructField(*k) for k in kinds[:-1]), T.StructField("score", T.DoubleType())])
    made = levels.mapInArrow(_evaluate(_pair_tables(pairs, n, v), triples), out)
    base = F.col("logs") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
    return made.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

"""Removal of byte strings that an earlier document holds, with suffix arrays built by the difference-cover algorithm.

A suffix array of the whole corpus would need tens of bytes of shuffle a byte of text. Two exact steps come first, after
which only what may repeat is sorted:

1. Documents are written once in blocks, and from then on a task takes a block; text is never shuffled. Documents with
   equal texts are found by digest: all but the first are covered whole, and leave the rest of the work.
2. Every ``length``-byte window chooses the least hash of its ``GRAM``-byte strings (a minimiser), so equal windows choose
   equal strings at equal places. Blocks send the distinct hashes they chose, split by hash range; a window can only
   repeat if its hash was chosen by two documents. Only those windows go on, as the byte context of their minimiser,
   equal contexts of a block sent once with the least doc_id.
3. Contexts meet by hash range. Contexts of one hash that differ are concatenated, their suffix array is built (sampled
   triples, recursion on names, merge), and neighbours with ``length`` equal bytes get the least doc_id of all.
4. Each block gets these back and marks the windows whose least doc_id is smaller than their document's.

A passage or hash that a third of all documents share costs one entry a block and range, so it stays spread out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .suffix_array import equal_prefixes, suffix_array

GRAM = 24
NEVER = np.iinfo(np.int64).max
_SLICE = 1 << 16
_PIECES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW24 = np.uint64((1 << 24) - 1)
_LOW40 = np.uint64((1 << 40) - 1)
_SPREAD = np.uint64(0x9E3779B97F)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, _P, np.uint64), dtype=np.uint64), np.cumprod(np.full(n, _PINV, np.uint64), dtype=np.uint64)


def least_grams(b: np.ndarray, length: int) -> np.ndarray:
    """For each window of the bytes ``b`` the least of its strings: 40 bits of hash, then 24 of place; at most a slice of windows."""
    up, down = _powers(_SLICE + length)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * down[: len(b)], dtype=np.uint64, out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * up[: len(b) - GRAM + 1]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    h &= ~_LOW24
    h |= np.arange(len(h), dtype=np.uint64)  # ties go to the leftmost
    width, have = length - GRAM + 1, 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


def _words(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The strings of ``raw`` (followed by 8 further bytes) eight bytes at a time, zero beyond their ends."""
    word = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    for at in range(0, int(sizes.max(initial=0)), 8):
        yield word[np.minimum(start + at, len(word) - 1)] & _KEEP[np.clip(sizes - at, 0, 8)]


def grouped(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which strings of one hash ``h`` that are equal are neighbours, hashes rising, and where each group begins
    in it. Strings are sorted by a fingerprint; were two different ones to share theirs, by all their bytes instead."""
    mix = sizes.astype(np.uint64) * _P
    for w in _words(raw, start, sizes):
        mix ^= w
        mix *= _MIX
        mix ^= mix >> np.uint64(32)
    order = np.lexsort((mix, h))
    new = np.ones(len(order), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (mix[order[1:]] != mix[order[:-1]])
    differ = np.zeros(len(order), bool)
    differ[1:] = sizes[order[1:]] != sizes[order[:-1]]
    for w in _words(raw, start[order], sizes[order]):
        differ[1:] |= w[1:] != w[:-1]
    if (differ & ~new).any():
        keys = [sizes, *_words(raw, start, sizes)]
        order = np.lexsort((*keys, h))
        new[1:] = h[order[1:]] != h[order[:-1]]
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h * np.uint64(segments)) >> np.uint64(40)).astype(np.int64)


def _five(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _unfive(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _ids(t: pa.Table, id_col: str) -> np.ndarray:
    return t.column(id_col).cast(pa.int64()).combine_chunks().fill_null(NEVER).to_numpy()


class Block:
    """A block file with its rows' bytes one after another, and the windows that matter; places are of all bytes."""

    def __init__(self, path: str, fs, id_col: str, text_col: str, length: int, copies: set[int]):
        with fs.open_input_file(path) as f:
            self.table = pq.read_table(f)
        self.ids, self.length = _ids(self.table, id_col), length
        raw = [x or b"" for c in self.table.column(text_col).chunks for x in common.utf8(c)]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.base = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])
        self.whole = b"".join([*raw, bytes(8)])
        self.copy = np.zeros(len(raw), bool)
        self.copy[list(copies)] = True

    def occurrences(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with a common minimiser of all rows that are no copies: (row, first start, last start, 40-bit hash)."""
        raw, n = np.frombuffer(self.whole, np.uint8), int(self.base[-1])
        used = np.flatnonzero(~self.copy & (self.sizes >= self.length))
        step = np.zeros(n + 1, np.int8)
        step[self.base[used]] = 1
        step[self.base[used + 1] - self.length + 1] -= 1
        inside = np.cumsum(step, dtype=np.int8, out=step).view(bool)
        first, last, hashes = [], [], []
        for at in range(0, n - self.length + 1, _SLICE):
            h = least_grams(raw[at : min(n, at + _SLICE + self.length - 1)], self.length)
            own = inside[at : at + len(h)]
            other = h[1:] != h[:-1]
            new = own.copy()
            new[1:] &= other | ~own[:-1]
            end = own.copy()
            end[:-1] &= other | ~own[1:]
            new = np.flatnonzero(new)
            first.append(new + at)
            last.append(np.flatnonzero(end) + at)
            # least hashes lie near 0; an odd factor spreads them over the hash ranges, one to one
            hashes.append(((h[new] >> np.uint64(24)) * _SPREAD) & _LOW40)
        first, last, hashes = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((first, np.int64), (last, np.int64), (hashes, np.uint64)))
        return np.searchsorted(self.base, first, "right") - 1, first, last, hashes

    def entries(self, shared: np.ndarray, segments: int):
        """Occurrences of shared hashes, and the distinct (hash, context) among them: (row, first, last, entry of each
        occurrence), (segment, hash, context's start, its size, least id, whether of several documents) of each entry, in
        segment order."""
        row, first, last, h = self.occurrences()
        at = np.searchsorted(shared, h)
        own = shared[np.minimum(at, len(shared) - 1)] == h if len(shared) else np.zeros(len(h), bool)
        row, first, last, h = row[own], first[own], last[own], h[own]
        sizes = last - first + self.length
        order, begin = grouped(np.frombuffer(self.whole, np.uint8), first, sizes, h)
        entry = np.empty(len(h), np.int64)
        entry[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
        ids, one = self.ids[row[order]], order[begin]
        least = np.minimum.reduceat(ids, begin) if len(h) else ids
        several = (np.maximum.reduceat(ids, begin) if len(h) else ids) != least
        return (row, first, last, entry), (segment_of(h[one], segments), h[one], first[one], sizes[one], least, several)


def _write_blocks(root: str, id_col: str, text_col: str, block_bytes: int):
    schema = pa.schema([("block", pa.string()), ("row", pa.int32()), ("id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        task, number = TaskContext.get(), 0

        def done(held):
            nonlocal number
            t = pa.Table.from_batches(held)
            path = f"{base}/block-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.parquet"
            number += 1
            with fs.open_output_stream(path) as f:
                pq.write_table(t, f, compression="zstd", use_dictionary=False, write_statistics=False)
            raw = [x or b"" for c in t.column(text_col).chunks for x in common.utf8(c)]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            n = len(raw)
            return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), pa.array(_ids(t, id_col)), pa.array(digests, pa.binary()), pa.array([len(x) for x in raw], pa.int64())], schema=schema)

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                more = sum(len(x) for x in common.utf8(b.column(text_col)) if x)
                if held and size + more > block_bytes:
                    yield done(held)
                    held, size = [], 0
                held.append(b)
                size += more
        if held:
            yield done(held)

    return run


def _by_block(work, id_col: str, text_col: str, length: int, root: str):
    """Runs ``work(block path, Block, rows of that block)`` for rows sorted by block: (block, kind, segment, a, b, c, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(root)

        def solve(path, rows):
            copies = {int(i) for kind, _, a, *_ in rows if kind == 0 for i in np.frombuffer(a, "<i4")}
            return work(path, Block(path, fs, id_col, text_col, length, copies), [r for r in rows if r[0]])

        current, rows = None, []
        for b in batches:
            for path, *r in zip(*(c.to_pylist() for c in b.columns)):
                if path != current:
                    if current is not None:
                        yield from solve(current, rows)
                    current, rows = path, []
                rows.append(r)
        if current is not None:
            yield from solve(current, rows)

    return run


_ROW = "block string, kind int, segment int, a binary, b binary, c binary, d binary"
_SCHEMA = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("segment", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def _send_hashes(segments: int):
    """Kind 1: a block's distinct minimiser hashes of a segment (a), and which of them two documents chose (b)."""

    def work(path: str, block: Block, _):
        row, _, _, h = block.occurrences()
        order = np.argsort(h)
        h, ids = h[order], block.ids[row[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(h) else np.zeros(0, bool)
        h = h[first]
        cut = np.searchsorted(segment_of(h, segments), np.arange(segments + 1))
        rows = [(path, 1, int(s), _five(h[cut[s] : cut[s + 1]]).tobytes(), np.packbits(several[cut[s] : cut[s + 1]]).tobytes(), None, None) for s in np.flatnonzero(np.diff(cut))]
        if rows:
            yield _batch(rows)

    return work


def _by_segment(solve):
    """Runs ``solve(rows of a segment)`` for rows sorted by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[2] != current:
                    if rows:
                        yield from solve(rows)
                    current, rows = r[2], []
                rows.append(r)
        if rows:
            yield from solve(rows)

    return run


def _shared_hashes(rows: list[tuple]):
    """Kind 1 back to each block: those of its hashes that another document chose too."""
    each = [_unfive(r[3]) for r in rows]
    h = np.concatenate(each)
    several = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=len(k)).astype(bool) for r, k in zip(rows, each)])
    keys, place, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = count > 1
    keep[place[several]] = True
    out, at = [], 0
    for r, k in zip(rows, each):
        own = keep[place[at : at + len(k)]]
        at += len(k)
        if own.any():
            out.append((r[0], 1, r[2], _five(k[own]).tobytes(), None, None, None))
    if out:
        yield _batch(out)


def _shared_of(rows) -> np.ndarray:
    parts = [_unfive(r[2]) for r in rows if r[0] == 1]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _send_contexts(segments: int):
    """Kind 2: a block's entries of a segment: hashes (a), context lengths with a bit for several documents (b), contexts (c), least ids (d)."""

    def work(path: str, block: Block, rows):
        _, (segment, hashes, start, sizes, least, several) = block.entries(_shared_of(rows), segments)
        cut = np.searchsorted(segment, np.arange(segments + 1))
        fives, lengths, least = _five(hashes), (sizes.astype("<u2") | (several.astype("<u2") << 15)).astype("<u2"), least.astype("<i8")
        whole, start, end = block.whole, start.tolist(), (start + sizes).tolist()
        out, size = [], 0
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[s], cut[s + 1])
            contexts = b"".join([whole[a:z] for a, z in zip(start[own], end[own])])
            out.append((path, 2, s, fives[own].tobytes(), lengths[own].tobytes(), contexts, least[own].tobytes()))
            size += len(contexts)
            if size > _PIECES:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return work


def least_ids(raw: np.ndarray, start: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of each context for which the least id of the contexts that hold them anywhere is one, by a suffix
    array of them all: (context, first window, last window, least id), in order."""
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    offset = np.arange(ends[-1]) - begin[owner]
    own = raw[np.minimum(start[owner] + offset, len(raw) - 1)]
    s = own.astype(np.int64) + 1
    s[ends - 1] = 257 + np.arange(len(sizes))  # an end of its own for each
    sa = suffix_array(s)
    window = offset + length <= sizes[owner]
    sa = sa[window[sa]]
    new = np.flatnonzero(np.concatenate([[True], ~equal_prefixes(own, sa, length)]))
    by_start = np.empty(len(own), np.int64)
    by_start[sa] = np.repeat(np.minimum.reduceat(ids[owner[sa]], new), np.diff(np.append(new, len(sa))))
    at = np.flatnonzero(window)
    owner, offset, value = owner[at], offset[at], by_start[at]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]))
    return owner[new], offset[new], offset[np.append(new[1:], len(at)) - 1], value[new]


def _solve_contexts(length: int, most: int = 1 << 20):
    """Kind 2 back to each block: runs of an entry's windows with one least id: entry (a), first and last window (b), id (c)."""

    def solve(rows: list[tuple]):
        h, lengths = _unfive(b"".join([r[3] for r in rows])), np.frombuffer(b"".join([r[4] for r in rows]), "<u2")
        docs = np.frombuffer(b"".join([r[6] for r in rows]), "<i8")
        raw = np.frombuffer(b"".join([*(r[5] for r in rows), bytes(8)]), np.uint8)
        several, sizes = lengths >> 15 > 0, (lengths & 0x7FFF).astype(np.int64)
        start = np.cumsum(sizes) - sizes
        order, begin = grouped(raw, start, sizes, h)
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(h))))
        ids, one = np.minimum.reduceat(docs[order], begin), order[begin]
        start, sizes, h = start[one], sizes[one], h[one]
        new = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
        alone = np.repeat(np.diff(new) == 1, np.diff(new))
        runs = [(np.flatnonzero(alone), np.zeros(alone.sum(), np.int64), (sizes - length)[alone], ids[alone])]
        differ = np.flatnonzero(~alone)  # contexts of one hash that differ
        if len(differ):
            volume, edge = np.cumsum(sizes[differ] + 1), np.append(np.flatnonzero(np.concatenate([[True], h[differ[1:]] != h[differ[:-1]]])), len(differ))
            at = 0
            while at < len(edge) - 1:
                done = volume[edge[at] - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(volume[edge[1:] - 1], done + most, "right")))
                own = differ[edge[at] : edge[to]]
                context, *rest = least_ids(raw, start[own], sizes[own], ids[own], length)
                runs.append((own[context], *rest))
                at = to
        of, first, last, value = (np.concatenate(x) for x in zip(*runs))
        order = np.argsort(of, kind="stable")
        first, last, value = first[order], last[order], value[order]
        cut = np.searchsorted(of[order], np.arange(len(h) + 1))
        times = cut[group + 1] - cut[group]
        entry = np.repeat(np.arange(len(group)), times)
        run = np.repeat(cut[group], times) + np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
        keep = (value[run] < docs[entry]) | several[entry]
        entry, run = entry[keep], run[keep]
        ends = np.cumsum([len(r[6]) // 8 for r in rows])
        begins = np.append(0, ends[:-1])
        cut = np.searchsorted(entry, np.append(begins, ends[-1]))
        entry = (entry - np.repeat(begins, np.diff(cut))).astype("<i4")
        span, value = np.stack([first[run], last[run]], 1).astype("<u2"), value[run].astype("<i8")
        out, size = [], 0
        for r, a, z in zip(rows, cut[:-1].tolist(), cut[1:].tolist()):
            if z > a:
                out.append((r[0], 2, r[2], entry[a:z].tobytes(), span[a:z].tobytes(), value[a:z].tobytes(), None))
                size += z - a
            if size > _PIECES >> 4:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    return solve


def _apply(segments: int, length: int, columns: list[str], id_col: str, text_col: str, mode: str):
    def work(path: str, block: Block, rows):
        back = sorted((r for r in rows if r[0] == 2), key=lambda r: r[1])
        whole, base = np.frombuffer(block.whole, np.uint8)[:-8], block.base
        step = np.zeros(len(whole) + 1, np.int32)
        own = np.flatnonzero(block.copy & (block.sizes >= length))
        np.add.at(step, base[own], 1)
        np.add.at(step, base[own + 1], -1)
        if back:
            (row, first, _, entry), (segment, *_) = block.entries(_shared_of(rows), segments)
            order = np.argsort(entry, kind="stable")
            cut = np.searchsorted(entry[order], np.arange(len(segment) + 1))
            start = np.searchsorted(segment, np.arange(segments))
            e = np.frombuffer(b"".join([r[2] for r in back]), "<i4") + np.repeat(start[[r[1] for r in back]], [len(r[2]) // 4 for r in back])
            span = np.frombuffer(b"".join([r[3] for r in back]), "<u2").reshape(-1, 2).astype(np.int64)
            value = np.frombuffer(b"".join([r[4] for r in back]), "<i8")
            times = cut[e + 1] - cut[e]
            occ = order[np.repeat(cut[e], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            a, z, value = np.repeat(span[:, 0], times), np.repeat(span[:, 1], times), np.repeat(value, times)
            hit = value < block.ids[row[occ]]
            occ, a, z = occ[hit], a[hit], z[hit]
            np.add.at(step, first[occ] + a, 1)
            np.add.at(step, first[occ] + z + length, -1)
        gone = np.cumsum(step, dtype=np.int32, out=step)[:-1] > 0
        stays = whole[~gone].tobytes()
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        edge = base[:-1][block.sizes > 0]
        new[edge] = gone[edge]
        del step
        removed, spans = (np.diff(np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])[base]).astype(np.int64) for x in (gone, new))
        left = np.concatenate([[0], np.cumsum(block.sizes - removed)]).tolist()
        shas, kept = [], []
        for a, z in zip(left, left[1:]):
            rest = stays[a:z]
            if mode == "report":
                shas.append(hashlib.sha256(rest).hexdigest())
            else:
                kept.append(rest if mode == "bytes" else rest.decode("utf-8", "ignore"))
        t = block.table
        new = [pa.array(block.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())]
        names = ["n_bytes", "n_removed", "n_spans"]
        if mode == "report":
            cols, own_names = [t.column(id_col).combine_chunks(), *new, pa.array(shas)], ["doc_id", *names, "kept_sha256"]
        else:
            cols = [pa.array(kept, pa.binary() if mode == "bytes" else pa.string()) if c == text_col else t.column(c).combine_chunks() for c in columns]
            cols, own_names = [*cols, *new], [*columns, *names]
        whole = pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=own_names)
        for at in range(0, whole.num_rows, 1000):
            yield whole.slice(at, 1000)

    return work


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, mode: str = "report", block_bytes: int = 8 << 20, segment_bytes: int = 8 << 20) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are their UTF-8 bytes, a null text is empty, strings never cross documents and are judged on the input. Returns
    one row per row: with mode ``report`` doc_id, n_bytes, n_removed, n_spans (maximal runs), kept_sha256; with mode
    ``bytes`` the columns of ``docs``, the text as its remaining bytes (binary, as a cut may split a character), n_bytes,
    n_removed and n_spans; with mode ``text`` the same, but the text as a string without the bytes of split characters. Rows of one id do not affect each other, repeated or not; a null id comes after all others.
    An empty table gives no rows. Ids must be whole numbers. Columns may have any names, but those of the counts are replaced.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must hold whole numbers")
    if length < 2 * GRAM or length > 4096:
        raise ValueError(f"length must be {2 * GRAM} to 4096")
    spark = docs.sparkSession
    if mode == "report":
        docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    else:
        docs = docs.drop("n_bytes", "n_removed", "n_spans")
    root = common.scratch_path(spark, "repeats-blocks")
    fs, base = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(base)
    rows = common.materialize(docs.mapInArrow(_write_blocks(root, id_col, text_col, block_bytes), "block string, row int, id long, digest binary, n long"), "repeats-rows")
    total, volume = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    segments = max(16, -(-(volume or 0) // segment_bytes))
    groups = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    heavy = groups.filter(F.col("copies") * 256 > (total or 0))
    copies = common.join_unique(rows, groups.select("digest", "first"), "digest", heavy).filter("id > first").select("block", "row")

    def pack_rows(batches):
        current, held = None, []

        def out():
            return _batch([(current, 0, -1, np.array(held, "<i4").tobytes(), None, None, None)])

        for b in batches:
            for path, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if path != current:
                    if current is not None:
                        yield out()
                    current, held = path, []
                if row is not None:
                    held.append(row)
        if current is not None:
            yield out()

    every = rows.select("block").distinct().withColumn("row", F.lit(None).cast("int"))
    start = common.materialize(copies.unionByName(every).repartition("block").sortWithinPartitions("block").mapInArrow(pack_rows, _ROW), "repeats-copies")
    blocks = start.count()

    def each_block(parts: list[DataFrame], work, kind: str) -> DataFrame:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        n = max(1, min(blocks, 20_000))
        return union.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_by_block(work, id_col, text_col, length, root), kind)

    def each_segment(part: DataFrame, solve) -> DataFrame:
        return part.repartition(max(1, min(segments, 4 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))), "segment").sortWithinPartitions("segment").mapInArrow(_by_segment(solve), _ROW)

    shared = common.materialize(each_segment(each_block([start], _send_hashes(segments), _ROW), _shared_hashes), "repeats-hashes")
    back = common.materialize(each_segment(each_block([start, shared], _send_contexts(segments), _ROW), _solve_contexts(length)), "repeats-windows")
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema]
    if mode == "report":
        kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    else:
        own = "binary" if mode == "bytes" else "string"
        kind = ", ".join(f"`{n}` {own if n == text_col else t}" for n, t in fields) + ", n_bytes long, n_removed long, n_spans long"
    return each_block([start, shared, back], _apply(segments, length, [n for n, _ in fields], id_col, text_col, mode), kind)

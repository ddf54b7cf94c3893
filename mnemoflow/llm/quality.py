"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

One pass over the texts turns each into a few statistics (kept as a small table); random Fourier features of them
approximate a Gaussian kernel. Each partition sums its part of the normal equations, the sums are added by a map-side
combined aggregate over matrix cells, and the driver solves one system whose size doesn't depend on the data. Scores of
a fifth of the labelled rows, kept from the regression, are averaged in bins, and pool-adjacent-violators turns the bins
into a monotone calibration. All labelled rows are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:!?", b"|", b"#$%&*@<>{}[]\\/^~_=+", b"\"'()-`"), 1):
    _CLASS[list(_chars)] = _k
N_CLASSES = 11
N_STATS = N_CLASSES + 16


class _Tally:
    """How many distinct items there are and how often the most frequent one occurs, of items by their 64-bit hashes:
    8 bytes an item between merges, which come when the new ones outnumber the distinct ones."""

    def __init__(self, least: int = 1 << 20):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.size, self.least = 0, least

    def add(self, items: list[bytes]) -> None:
        self.new.append(np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items)))
        self.size += len(items)
        if self.size > max(self.least, len(self.hashes)):
            self._merge()

    def _merge(self) -> None:
        h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.new]), return_counts=True)
        self.new, self.size = [], 0
        if not len(self.hashes):
            self.hashes, self.counts = h, n
            return
        h, n = np.concatenate([self.hashes, h]), np.concatenate([self.counts, n])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.hashes, self.counts = h[first], np.add.reduceat(n, first)

    def result(self) -> tuple[int, int]:
        self._merge()
        return len(self.hashes), int(self.counts.max(initial=0))


def _line_blocks(raw: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lines of a text, split at line feeds, in lists from slices of about ``block`` bytes."""
    at = 0
    while (to := raw.find(b"\n", at + block)) >= 0:
        yield raw[at:to].split(b"\n")
        at = to + 1
    yield raw[at:].split(b"\n")


def statistics(raw: bytes | None) -> np.ndarray:
    """Shares of character classes, word, line and repetition statistics of a text; all zero for an empty one."""
    raw = raw or b""
    out = np.zeros(N_STATS)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    hist = np.bincount(b, minlength=256)
    out[:N_CLASSES] = np.bincount(_CLASS, weights=hist, minlength=N_CLASSES) / len(b)
    p = hist[hist > 0] / len(b)
    gap = np.flatnonzero((b == 32) | ((b >= 9) & (b <= 13)))
    length = np.diff(np.concatenate([[-1], gap, [len(b)]])) - 1
    length = length[length > 0]
    lines = np.diff(np.concatenate([[-1], np.flatnonzero(b == 10), [len(b)]])) - 1
    n = distinct = most = runs = 0
    seen = _Tally()
    last = None
    for words in common.word_blocks(raw):
        n += len(words)
        seen.add(words)
        runs += sum(map(bytes.__eq__, words, words[1:])) + (bool(words) and words[0] == last)
        last = words[-1] if words else last
    distinct, most = seen.result()
    parts = _Tally()
    for block in _line_blocks(raw):
        parts.add(block)
    again = 1 - parts.result()[0] / len(lines)
    words = max(n, 1)
    out[N_CLASSES:] = (
        np.log1p(len(b)),
        np.log1p(n),
        length.mean() if len(length) else 0.0,
        length.std() if len(length) else 0.0,
        (length <= 2).mean() if len(length) else 0.0,
        (length > 12).mean() if len(length) else 0.0,
        -(p * np.log2(p)).sum(),
        distinct / words,
        np.log(words) - np.log(max(distinct, 1)),
        most / words,
        runs / words,
        np.log1p(len(lines)),
        np.log1p(lines.mean()),
        (lines < 20).mean(),
        again,
        np.log1p(len(length) / max(1, len(lines))),
    )
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row, over the whole of its text. Null and empty texts have zeros, repeated
    rows are rows of their own, an empty table gives none; ids may be of any type, other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in common.utf8(b.column(1))]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_STATS, pa.int32()), flat)], names=["doc_id", "stats"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def expand(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features, the standardised statistics themselves and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases), 0.1 * z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights if self.weights is not None else np.full(len(stats), 0.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.knots, self.values) if self.knots is not None else raw, 0, 1)


def _stats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), N_STATS)


def pool_adjacent(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of means y with weights n at increasing x: knots and values to interpolate between."""
    blocks: list[list[float]] = []
    for xi, yi, ni in zip(x, y, n):
        blocks.append([xi * ni, yi * ni, ni])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = 192, ridge: float = 1e-3, bins: int = 512, seed: int = 5) -> Model:
    """Fit on every labelled row of the statistics table. Null labels and labels without a document are ignored; of
    repeated labels of an id the smallest counts. Without labels all scores are 0.5."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = common.materialize(stats.join(known, "doc_id").withColumn("kept", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0), "quality-labelled")
    sums = rows.select(*[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    mean, scale = (np.array([sums[f"{f}{i}"] or 0.0 for i in range(N_STATS)]) for f in ("avg", "stddev_pop"))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(N_STATS, features)) * np.sqrt(1.0 / N_STATS), rng.uniform(0, 2 * np.pi, features))
    if sums["avg0"] is None:
        return model
    size = features + N_STATS + 1
    upper = np.triu_indices(size)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z, y = model.expand(_stats(part.column(0))), part.column(1).to_numpy()
                a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        if n:
            cells = np.concatenate([a[upper], b, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "v"])

    def solve(part: DataFrame) -> None:
        cells = {r.cell: r.v for r in part.select("stats", "y").mapInArrow(normal_equations, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
        if not cells:
            return
        flat = np.array([cells[i] for i in range(len(cells))])
        a = np.zeros((size, size))
        a[upper] = flat[: len(upper[0])]
        a = a + np.triu(a, 1).T
        model.weights = np.linalg.solve(a + ridge * flat[-1] * np.eye(size) + 1e-9 * np.eye(size), flat[len(upper[0]) : -1])

    solve(rows.filter("not kept"))
    if model.weights is None:
        solve(rows)

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_stats(b.column(0)))), b.column(1)], names=["raw", "y"])

    held = rows.filter("kept") if not rows.filter("kept").isEmpty() else rows
    raw = held.select("stats", "y").mapInArrow(raw_scores, "raw double, y double")
    place = F.floor(F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) * (bins / 2))
    found = raw.groupBy(place.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    model.knots, model.values = pool_adjacent(*(np.array([r[k] for r in found], float) for k in ("x", "y", "n")))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score between 0 and 1) for every row of the statistics table; null and empty texts score like zero statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_stats(b.column(1))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")

"""Toxicity by compression distance.

Two Zstandard dictionaries are trained apart: one on windows of ordinary text, one on the words that mark toxic text.
Each window of a document (a few words) is compressed with the ordinary dictionary and with both together; the bytes
that the toxic part saves are the window's distance. How many windows save how much goes through a calibrated logistic
threshold to a score. A window is led by a preamble that both dictionaries hold, so that even a short one becomes a
compressed block and its length tells matches from literals.

Fitting uses a bounded sample of labelled documents, their texts whole; scoring reads every text whole, in one pass
without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PREAMBLE = bytes(range(128, 192))
STEPS = (1, 2, 3, 4, 5, 6, 7, 9)
_SHARES = (3, 5, 7)
_STRIP = b".,;:!?#$%&*|\"'()[]{}"


def windows(raw: bytes | None, size: int) -> Iterator[bytes]:
    """Lower-cased runs of whole words of ``size`` bytes or a little more."""
    held, n = [], 0
    for words in common.word_blocks((raw or b"").lower()):
        for w in words:
            held.append(w)
            n += len(w) + 1
            if n >= size:
                yield b" ".join(held)
                held, n = [], 0
    if held:
        yield b" ".join(held)


def _train(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary
        return b" ".join(samples)[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    window: int
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float = 0.0
    _zip: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_zip": []}

    def _open(self) -> list:
        if not self._zip:
            for raw in (self.ordinary, self.toxic + self.ordinary):
                d = zstandard.ZstdCompressionDict(raw + PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters(window_log=15, hash_log=14, chain_log=14, search_log=5, min_match=5, target_length=64, strategy=5, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                self._zip.append(zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress)
        return self._zip

    def distances(self, raw: bytes | None) -> np.ndarray:
        plain, toxic = self._open()
        lead = PREAMBLE + b" "
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in (lead + x + b" " for x in windows(raw, self.window))), np.int64)

    def features(self, raw: bytes | None) -> np.ndarray:
        d = self.distances(raw)
        n = [math.log1p(int((d >= k).sum())) for k in STEPS]
        total = math.log1p(len(d))
        return np.array([*n, *(n[STEPS.index(k)] / total if total else 0.0 for k in _SHARES), total])

    def score(self, raw: bytes | None) -> float:
        if self.weights is None:
            return self.constant
        z = float(((self.features(raw) - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _pieces(word: bytes) -> set[bytes]:
    w = word.strip(_STRIP)
    return {w[:k] for k in (4, 6, 8, 10) if len(w) >= k} | ({w} if len(w) >= 4 else set())


def _marks(texts: list[bytes], toxic: np.ndarray) -> set[bytes]:
    """Words and word beginnings whose document frequency in toxic text stands out by eight standard errors and eightfold."""
    bad, all_ = Counter(), Counter()
    for t, y in zip(texts, toxic):
        if y:
            bad.update(set().union(*map(_pieces, set(t.lower().split()))))
    bad = Counter({k: v for k, v in bad.items() if v >= 4})
    for t, y in zip(texts, toxic):
        if not y:
            all_.update(x for x in set().union(*map(_pieces, set(t.lower().split()))) if x in bad)
    nt, no = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))

    def stands_out(w, zs):
        a, b = bad[w], all_[w]
        p = (a + b) / (nt + no)
        return a / nt > 8 * b / no and (a / nt - b / no) / math.sqrt(p * (1 - p) * (1 / nt + 1 / no) + 1e-12) > zs

    for zs in (8, 5, 3):  # few labels: a lower bar
        if found := {w for w in bad if stands_out(w, zs)}:
            return found
    return set()


def train_dictionaries(texts: list[bytes], toxic: np.ndarray, window: int = 16, toxic_bytes: int = 2048, ordinary_bytes: int = 8192) -> Model:
    marks = _marks(texts, toxic)
    bad = [b" " + w + b" " for t, y in zip(texts, toxic) if y for w in t.lower().split() if _pieces(w) & marks]
    good = [w for t, y in zip(texts, toxic) if not y for w in windows(t, 64)]
    return Model(_train(good, ordinary_bytes), _train(bad, toxic_bytes), window)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[bytes], toxic: np.ndarray, share: float, window: int = 16) -> Model:
    """Dictionaries from all texts; thresholds from distances under dictionaries that a text had no part in (four folds).
    ``share`` is the toxic share of the labels, to which scores are calibrated whatever the sample's is."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return Model(b"", b"", window, constant=float(toxic.any()) if len(toxic) else share)
    x = np.zeros((len(texts), len(STEPS) + len(_SHARES) + 1))
    fold = np.zeros(len(texts), int)
    for y in (False, True):
        own = np.flatnonzero(toxic == y)
        fold[own] = np.arange(len(own)) % 4
    for k in range(4):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(rest):
            part = train_dictionaries([texts[i] for i in rest], toxic[rest], window)
            for i in own:
                x[i] = part.features(texts[i])
    model = train_dictionaries(texts, toxic, window)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    here = toxic.mean()
    weight = np.where(toxic, share / here, (1 - share) / (1 - here))
    model.weights = _logistic((x - model.mean) / model.scale, toxic.astype(float), weight)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_docs: int = 1000, sample_bytes: int = 24 << 20) -> Model:
    """Fit on at most ``sample_docs`` toxic and three times as many other labelled documents, in the order of a hash of
    the id, and of these on as many as have ``sample_bytes`` of text together (a third of it toxic); texts are used whole.

    Labels that are null or without a document are ignored, as are null ids; of repeated labels of an id the largest
    counts, and so does each row of a repeated id. A labelled text longer than its share of ``sample_bytes`` is left out
    of the sample. Null and empty texts teach nothing. Without labels of both kinds (or an empty table) scores are constant.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("doc_id").agg((F.max("y") > 0).alias("y"))
    known = common.materialize(known, "toxicity-labels")
    sizes = {r.y: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    some, most = None, {}
    for y in sizes:
        most[y] = sample_docs if y else 3 * sample_docs
        part = known.filter(F.col("y") == y).filter(place < math.ceil((1 << 20) * min(1, 1.2 * most[y] / sizes[y]))).withColumn("place", F.xxhash64("doc_id", F.lit(12))).orderBy("place", "doc_id").limit(most[y])
        some = part if some is None else some.unionByName(part)
    chosen = []
    if some is not None:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") > 0)
        texts = common.materialize(texts.join(F.broadcast(some), "doc_id"), "toxicity-sample")
        for y in sizes:
            room = sample_bytes // 3 if y else 2 * sample_bytes // 3
            rows = texts.filter((F.col("y") == y) & (F.octet_length("text") <= room)).select("doc_id", "place", F.octet_length("text").alias("size"), F.xxhash64("text").alias("h"))
            rows = rows.orderBy("place", "doc_id", "h").limit(2 * most[y]).collect()
            fits = np.cumsum([r["size"] for r in rows]) <= room
            last = int(fits.sum())
            if last:
                chosen += texts.filter((F.col("y") == y) & (F.octet_length("text") <= room)).orderBy("place", "doc_id", F.xxhash64("text")).limit(last).collect()
        common.release(texts)
    common.release(known)
    total = sum(sizes.values())
    return fit([r.text.encode() for r in chosen], np.array([r.y for r in chosen], bool), sizes.get(True, 0) / total if total else 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its text alone: between 0 and 1, higher for likelier toxic. Null and empty
    texts have no windows and get the score that says; repeated rows are scored alike; texts of any length are read whole,
    a megabyte of words at a time; an empty table gives no rows; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t) for t in common.utf8(b.column(1))], pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in common.utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

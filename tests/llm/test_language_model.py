import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import language_model as lm
from mnemoflow.llm.queries import QUERIES


def tokens(t):
    return (t or "").encode().lower().split() + [None]


def base(rows, training):
    c = Counter(w for i, t in rows if training(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    log = math.log10(n + 0.1 * (v + 1))
    return sorted(((i, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10(c[w] + 0.1) - log for w in tokens(t)), 5)) for i, t in rows), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect()), key=repr)


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op5_language_model"](spark, sf_dir)
    assert result(got) == base(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def slow_scores(rows, training):
    """Scores by dictionaries of exact counts, one token at a time."""
    copies = [tokens(t) for i, t in rows if training(i)]
    uni, bi, tri = Counter(), Counter(), Counter()

    def grams(t):
        for k, w in enumerate(t):
            b = t[k - 1] if k else None
            yield w, (b, w), (("start",) if k == 0 else (t[k - 2] if k > 1 else None, b), w)

    for t in copies:
        for w, p, q in grams(t):
            uni[w] += 1
            bi[p] += 1
            tri[q] += 1
    starts = len(copies)
    n, v = sum(uni.values()), len(uni)
    level = lambda c: int(lm.level_of(np.array([c]))[0])
    value = lambda c: float(lm.VALUE[level(c)])
    context_of = lambda q: starts if q[0] == ("start",) else bi[q[0]]

    def fit(cells):
        weight = [0.5] * (lm.TOP + 1)
        for _ in range(30):
            top, all_ = Counter(), Counter()
            for (c, p, low), k in cells.items():
                top[c] += k * weight[c] * p / (weight[c] * p + (1 - weight[c]) * low)
                all_[c] += k
            weight = [top[c] / all_[c] if all_[c] else 0 for c in range(lm.TOP + 1)]
        return [0] + [min(w, 0.999) for w in weight[1:]]

    less = lambda c: max(value(c) - 1, 0)
    share = lambda c, of: min(max(less(c) / max(less(of), 1), 0), 1)
    word = lambda w: (less(uni[w]) + 0.1) / (n + 0.1 * (v + 1))
    w2 = fit(Counter((level(uni[p[0]]), share(bi[p], uni[p[0]]), word(w)) for t in copies for w, p, _ in grams(t)))
    lower = lambda w, p: w2[level(uni[p[0]])] * share(bi[p], uni[p[0]]) + (1 - w2[level(uni[p[0]])]) * word(w)
    rounded = lambda x: 10 ** (-min(max(round(-math.log10(x) * 8), 0), 255) / 8)
    w3 = fit(Counter((level(context_of(q)), share(tri[q], context_of(q)), rounded(lower(w, p))) for t in copies for w, p, q in grams(t)))
    out = []
    for i, t in rows:
        total = 0.0
        for w, p, q in grams(tokens(t)):
            a = min(value(bi[p]) / max(value(uni[p[0]]), 1), 1)
            b = w2[level(uni[p[0]])] * a + (1 - w2[level(uni[p[0]])]) * min((value(uni[w]) + 0.1) / (n + 0.1 * (v + 1)), 1)
            c = context_of(q)
            total += math.log10(w3[level(c)] * min(value(tri[q]) / max(value(c), 1), 1) + (1 - w3[level(c)]) * b)
        out.append((i, round(total, 4)))
    return sorted(out, key=repr)


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=np.arange(40, 0, -1) / 820))) for i in range(60)]
    rows += [(100, rows[7][1]), (101, None), (102, ""), (103, "never seen at all"), (104, "w1 " * 400), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(docs, F.col("doc_id") % 10 != 0, bits_per_item=96, block_bytes=500, segment_bytes=700)
    assert sorted(((r.doc_id, round(r.score, 4)) for r in got.collect()), key=repr) == slow_scores(rows, lambda i: i % 10 != 0)


def test_documents_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 120)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.lit(True)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 400))


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40}, {"segment_bytes": 7_000}])
def test_edge_cases_and_blocks(spark, options):
    rows = [(1, "the cat sat"), (2, "the cat ran"), (2, "the cat ran"), (3, None), (4, ""), (5, "the Cat sat on the mat unknown"), (6, "w " * 300_000), (0, "zebra the cat"), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, 1, 0.0, "x") for i, t in rows], "doc_id long, text string, n_known int, score double, block string")
    train = F.col("doc_id").isin(1, 2, 3, 6)
    got = lm.score(docs, train, bits_per_item=64, **options)
    assert result(got) == base(rows, lambda i: i in (1, 2, 3, 6))
    want = {(r.doc_id, round(r.score, 6)) for r in lm.score(docs, train, bits_per_item=64).collect()}
    assert {(r.doc_id, round(r.score, 6)) for r in got.collect()} == want
    assert all(math.isfinite(s) and s <= 0 for _, s in want)
    none = lm.score(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in none)
    assert lm.score(docs.limit(0), train).collect() == []
    named = lm.score(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), F.lit(True))
    assert {r.doc_id for r in named.collect()} == {None if i is None else f"d{i}" for i, _ in rows}


def test_levels_survive_the_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 32, 20_000).astype(np.uint64))
    counts = np.maximum(1, rng.pareto(1, len(keys))).astype(np.int64)
    segment = lm.Segment(keys, counts)
    level, want = segment.probe(keys), lm.level_of(counts)
    assert (level >= want).all() and (level == want).mean() > 0.95
    other = segment.probe(rng.integers(0, 1 << 32, 5000).astype(np.uint64))
    assert (other > 0).mean() < 0.05


def test_level_values():
    for c in (1, 2, 3, 4, 7, 50, 1234, 10**7):
        assert 0.6 < lm.VALUE[lm.level_of(np.array([c]))[0]] / c < 1.6

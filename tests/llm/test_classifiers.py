import numpy as np
import pytest

from mnemoflow.llm import quality, toxicity
from mnemoflow.llm.queries import QUERIES


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.array(score)[order]
    first, last = np.searchsorted(s, s), np.searchsorted(s, s, "right") - 1
    rank[order] = (first + last) / 2
    y = np.array(y, bool)
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


@pytest.mark.parametrize("name,label,cut,least", [("op2_toxicity", "toxic", 0.5, 0.9), ("op3_quality", "quality", 0.7, 0.8)])
def test_held_out_documents(spark, name, label, cut, least):
    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(got) == docs and got.doc_id.is_unique
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= cut)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    y = both[label] == 1
    print(name, len(both), auc(both.score, y), "accuracy", (both.predicted == y).mean(), "base", max(y.mean(), 1 - y.mean()), "precision", y[both.predicted == 1].mean(), "recall", both.predicted[y].mean())
    assert auc(both.score, y) > least
    assert (both.predicted == y).mean() >= max(y.mean(), 1 - y.mean()) - 0.02


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (None, "you idiot"), (4, "x " * 2_000_000)]
    docs = spark.createDataFrame([(i, t, "a", 0.5) for i, t in rows], "doc_id long, text string, stats string, score double")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, None, 0), (None, 1, 1), (99, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0 and quality = 0")):
        t = {(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, toxicity.train(docs, known)).collect()}
        s = quality.statistics_table(docs)
        q = {(r.doc_id, round(r.score, 9)) for r in quality.score(s, quality.train(s, known)).collect()}
        assert len(t) == len(q) == 5 and all(0 <= x[1] <= 1 for x in t | q)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []
    empty = quality.statistics_table(docs.limit(0))
    assert quality.score(empty, quality.train(empty, labels)).collect() == []


def test_pool_adjacent():
    x, y = quality.pool_adjacent(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.9, 0.8]), np.ones(5))
    assert np.allclose(y, [0.1, 0.4, 0.85]) and np.allclose(x, [0, 1.5, 3.5])


def test_toxic_words_save_bytes():
    rng = np.random.default_rng(0)
    parts = [a + b + c for a in ("ta", "lo", "mi", "re") for b in ("ne", "so", "ku") for c in ("th", "ra", "li")]
    texts, y = [], []
    for i in range(200):
        w = list(rng.choice(parts, 80))
        if i % 4 == 0:
            for k in (5, 30, 60):
                w[k] = "blockhead"
        texts.append(" ".join(w).encode())
        y.append(i % 4 == 0)
    model = toxicity.fit(texts[:120], np.array(y[:120]), 0.25)
    got = np.array([model.score(t) for t in texts[120:]])
    assert auc(got, y[120:]) > 0.98


@pytest.mark.parametrize("size", [3 << 20, 9 << 20])
def test_statistics_count_the_whole_of_a_long_text(size):
    page = b"the same line again\n" * (size // 20)
    shares = quality.statistics(page)[quality.N_CLASSES :]
    assert shares[14] == pytest.approx(1 - 2 / (size // 20 + 1)) and shares[7] == pytest.approx(4 / (size // 20 * 4))
    n = size // 6
    words = b" ".join([b"%x" % i for i in range(n)] + [b"again"] * n)
    shares = quality.statistics(words)[quality.N_CLASSES :]
    assert shares[7] == pytest.approx((n + 1) / (2 * n)) and shares[9] == pytest.approx(0.5)


def test_tally_merges():
    tally = quality._Tally(least=3)
    for k in range(7):
        tally.add([b"%d" % (i % 11) for i in range(k * 5)])
    tally.add([])
    assert tally.result() == (11, sum(i % 11 == 0 for k in range(7) for i in range(k * 5))) and quality._Tally().result() == (0, 0)

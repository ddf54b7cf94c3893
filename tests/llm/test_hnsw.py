import numpy as np
import pytest

from mnemoflow.llm import hnsw
from mnemoflow.llm.queries import QUERIES


def exact(rows, k):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids if i % 20 == 0}):
        s = v @ v[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def check(got, want, least):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert found.keys() == want.keys()
    hits = total = 0
    for q, rows in found.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(want[q]) + 1))
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(rows, rows[1:]))
        low = want[q][-1][1]
        hits += sum(r.score >= low - 1e-9 for r in rows)
        total += len(rows)
    assert hits / total >= least, hits / total


@pytest.mark.parametrize("sf,shard_rows", [("sf0.01", 16384), ("sf0.1", 16384), ("sf0.1", 500)])
def test_recall_on_the_whole_table(spark, sf, shard_rows):
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    got = QUERIES["op10_hnsw"](spark, f"/root/testdata/{sf}") if shard_rows == 16384 else hnsw.nearest(hnsw.build_index(t, shard_rows=shard_rows), t.filter("vec_id % 20 = 0"), 20)
    want = exact(rows, 20)
    got = got.collect()
    byid = dict(rows)
    for r in got[:200]:
        assert abs(r.score - float(np.dot(np.array(byid[r.query_id], np.float64), np.array(byid[r.vec_id], np.float64)))) < 1e-12
    check(got, want, 0.9)


def test_lengths_copies_and_query_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8)) * rng.lognormal(size=(600, 1))
    v[200:400] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = hnsw.nearest(hnsw.build_index(df, shard_rows=150), df.filter("vec_id % 20 = 0"), 20, query_block=7).collect()
    check(got, exact(rows, 20), 0.9)


@pytest.mark.parametrize("jitter,shard_rows", [(0.0, 16384), (1e-3, 16384), (1e-3, 700), (None, 1000)])
def test_copies_and_tight_clusters(spark, jitter, shard_rows):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(4000, 64)) if jitter is None else np.repeat(rng.normal(size=(20, 64)), 200, axis=0) + jitter * rng.normal(size=(4000, 64))
    rows = [(int(i), [float(x) for x in r]) for i, r in zip(rng.permutation(4000), v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(hnsw.build_index(df, shard_rows=shard_rows), df.filter("vec_id % 20 = 0"), 20).collect()
    check(got, exact(rows, 20), 0.95)


def test_links_come_from_insertion():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    g = hnsw.build(v)
    tops = [len(g[k]) for k in sorted(g) if k.startswith("nodes")]
    assert tops[0] == 3000 and tops == sorted(tops, reverse=True) and len(tops) > 1
    for l in range(len(tops)):
        links = g[f"links{l}"]
        assert links.max() < tops[l] and not (links == np.arange(tops[l])[:, None]).any()
        assert all(len(set(r[r >= 0])) == (r >= 0).sum() for r in links)
    reached, edge = {int(g["entry"][0])}, [int(g["entry"][0])]
    while edge:
        edge = list({int(i) for n in edge for i in g["links0"][n] if i >= 0} - reached)
        reached |= set(edge)
    assert len(reached) == 3000


def test_vectors_of_several_dimensions(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [3.0]), (2, [5.0]), (3, [-1.0]), (4, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in hnsw.nearest(hnsw.build_index(df), df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 4, 9.0), (0, 2, 1, 2.0), (20, 1, 2, 15.0), (20, 2, 3, -3.0)]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (20, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (40, [0.0, 1.0]), (0, [1.0, 0.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in hnsw.nearest(hnsw.build_index(df), df.filter("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 40, 0.0), (40, 1, 0, 0.0), (40, 2, 0, 0.0), (40, 3, 1, 0.0), (40, 4, 2, 0.0)]
    empty = df.limit(0)
    assert hnsw.nearest(hnsw.build_index(empty), empty, 20).collect() == []
    assert hnsw.nearest(hnsw.build_index(df.filter("vec_id = 40")), df.filter("vec_id = 40"), 20).collect() == []

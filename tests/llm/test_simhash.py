import numpy as np
import pytest
import xxhash

from mnemoflow.llm import simhash
from mnemoflow.llm.components import connected_components
from mnemoflow.llm.queries import QUERIES


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 2]) for i in range(len(words) - 1)] if len(words) > 1 else words
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(grams))


def brute(rows, distance=6):
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    comp = np.arange(len(rows))
    ids = [r[0] for r in rows]
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for k in np.flatnonzero(near[todo.pop()]):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        comp[i] = min(ids[k] for k in seen)
    return sorted((ids[i], format(int(fps[i]), "016x"), int(near[i].sum()) - 1, int(comp[i])) for i in range(len(rows)))


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "fingerprint", "n_near", "component_id").collect())


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op1_simhash"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("tile_rows,levels,local_edges", [(4, 1, 0), (1 << 15, 2, 10**6), (7, 3, 0)])
def test_close_random_fingerprints(spark, tile_rows, levels, local_edges):
    rng = np.random.default_rng(tile_rows)
    base = rng.integers(0, 2**63, 12)
    v = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 9), replace=False)) for b in base for _ in range(25)]))
    groups = spark.createDataFrame([(int(x), i % 3 + 1) for i, x in enumerate(v)], "fp long, cnt long")
    links = simhash.link_table(groups, 6, tile_rows, levels)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 6
    cnt = np.arange(len(v)) % 3 + 1
    got = {r.a: r.n for r in links.filter("n > 0").groupBy("a").sum("n").toDF("a", "n").collect()}
    assert got == {int(v[i]): int(cnt[near[i]].sum() - cnt[i]) for i in range(len(v)) if near[i].sum() > 1}
    roots = {r.node: r.root for r in connected_components(links.filter("n = 0").select("a", "b"), local_edges).collect()}
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.array([label[near[i]].min() for i in range(len(v))])
    assert roots == {int(v[i]): int(v[label[i]]) for i in range(len(v)) if near[i].sum() > 1}


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Alone"), (5, "alone"), (6, "A b c"), (6, "A b c"), (7, long), (8, long + " x"), (9, "Ünï cödé Ünï"), (10, "a b c")]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, fp string, cnt int")
    assert result(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    null = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "q r s t u v w")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.n_near) for r in simhash.near_duplicates(null).collect()}
    assert got == {(None, 3, 1), (3, 3, 1), (None, None, 0)}


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    from mnemoflow.llm import common

    text = ("one two  three\nfour \t" * 300).encode()
    whole = simhash.fingerprint(text)
    blocks = common.word_blocks
    monkeypatch.setattr(common, "word_blocks", lambda raw, block=64: blocks(raw, 64))
    assert simhash.fingerprint(text) == whole == slow_fingerprint(text.decode())


def test_groups_that_share_an_id_each_keep_a_row(spark):
    rows = [(None, "a b c d"), (None, "q w e r t y"), (None, "q w e r t y"), (5, "one two three"), (5, "z x c v b n m"), (7, "k j h g"), (7, "near to two"), (2, "near to two"), (None, "k j h g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()), key=repr)
    assert got == sorted([(None, "a b c d"), (None, "q w e r t y"), (5, "one two three"), (5, "z x c v b n m"), (7, "k j h g"), (2, "near to two")], key=repr)

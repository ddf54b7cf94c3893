import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mnemoflow.llm import packing
from mnemoflow.llm.queries import QUERIES, tokenizer_path
from mnemoflow.llm.tokens import Encoder

TOKENIZER = Tokenizer.from_file(tokenizer_path())
ENCODER = Encoder(tokenizer_path())


def check(pieces, texts, window=1024):
    ids = {d: TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts.items()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
    assert by_doc.keys() == texts.keys()
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[d])
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        pad += window - at
    return pad / (window * len(by_seq)), by_seq


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    padding, _ = check(QUERIES["op7_packing"](spark, sf_dir).collect(), texts)
    assert padding < 0.01


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "x " * 5000, 4: "a<|endoftext|>b", 5: "tab\t and  two", 6: "same words here", 7: "same words here"}
    docs = spark.createDataFrame([(i, t, 0, "q") for i, t in texts.items()], "doc_id long, text string, start int, ids string")
    for window in (1024, 8):
        made = packing.pack(docs, tokenizer_path(), window, shard_units=3)
        check(made.collect(), texts, window)
        whole = packing.sequences(made).collect()
        assert all(len(s.ids) == 2 * s.tokens for s in whole)
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []
    twice = packing.pack(docs.filter("doc_id > 5").unionAll(docs.filter("doc_id > 5")), tokenizer_path()).collect()
    assert sorted(p.doc_id for p in twice) == [6, 6, 7, 7]


def test_neighbours_share_words():
    rng = np.random.default_rng(0)
    units = [rng.integers(1000 * (i % 4), 1000 * (i % 4) + 60, 200).astype("<u2") for i in range(80)]
    rows = list(packing.pack_shard(units, 1000))
    alike = [len({u % 4 for u, _, _ in r}) for r in rows[:12]]
    assert np.mean(alike) < 1.5
    assert sum(b - a for r in rows for _, a, b in r) == 80 * 200


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t 'sabé1|.<>")), max_size=60))
def test_ids_equal_the_tokenizer(text):
    assert ENCODER.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_statistics_are_those_of_all_units(spark):
    texts = [(i, f"{'common ' * (i % 7)}words number {i % 13} and {'rare' if i == 3 else 'more'}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    units = [np.array(TOKENIZER.encode(t, add_special_tokens=False).ids + [0]) for _, t in texts]
    df = np.zeros(max(u.max() for u in units) + 1, np.int64)
    for u in units:
        df[np.unique(u)] += 1
    seen = []
    count = packing.count_terms
    try:
        packing.count_terms = lambda *a: seen.append(count(*a)) or seen[-1]
        packing.pack(docs, tokenizer_path(), shard_units=8).collect()
    finally:
        packing.count_terms = count
    assert len(seen) == 1 and seen[0].units == 60 and np.array_equal(seen[0].df, df)
    assert np.isclose(seen[0].mean, np.mean([len(u) for u in units]))


def test_a_shard_weighs_terms_as_all_units_do():
    rng = np.random.default_rng(1)
    units = [rng.integers(0, 50, rng.integers(5, 40)).astype("<u2") for _ in range(40)]
    df = np.zeros(50, np.int64)
    for u in units:
        df[np.unique(u)] += 1
    index = packing.Index(units[:10], packing.Statistics(40, np.mean([len(u) for u in units]), df))
    alone = packing.Index(units)
    few = int(index.first[10])
    assert np.allclose(index.weight, alone.weight[:few])


def test_all_terms_of_a_seed_count():
    rng = np.random.default_rng(2)
    units = [np.concatenate([rng.integers(0, 30, 40), rng.integers(30, 2000, 60)]).astype("<u2") for _ in range(90)]
    n, sets = np.array([len(u) for u in units]), [set(u.tolist()) for u in units]
    df = {t: sum(t in s for s in sets) for t in set().union(*sets)}
    index = packing.Index(units)
    for seed in (0, 17, 89):
        expected = np.zeros(90)
        for u, unit in enumerate(units):
            for t in sets[seed] & sets[u]:
                tf = int((unit == t).sum())
                expected[u] += np.log1p((90 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n[u] / n.mean()))
        assert np.allclose(index.scores(seed), expected, rtol=1e-5)


def test_terms_beyond_the_heaviest_decide():
    # the seed's 40 rarest terms are its own; the unit that shares the other 40 comes before those that share none
    seed = np.arange(100, 180)
    units = [seed, *(np.arange(1000 + 50 * i, 1050 + 50 * i) for i in range(70)), np.concatenate([seed[40:], np.arange(5000, 5010)]), *(np.repeat(seed[40 + i], 50) for i in range(40))]
    rows = next(iter(packing.pack_shard([u.astype("<u2") for u in units], 130)))
    assert rows[1][0] == 71

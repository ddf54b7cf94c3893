import cProfile
import hashlib
import pstats

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import pytest

from mnemoflow.llm import substring_dedup
from mnemoflow.llm.queries import QUERIES
from mnemoflow.llm.substring_dedup import remove_repeats
from mnemoflow.llm.suffix_array import suffix_array


def brute(rows, length=50):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            if g not in first or key(i) < first[g]:
                first[g] = key(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < key(i):
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in [*range(0, 12), 100, 101, 102]:
        for top in (1, 2, 5):
            s = rng.integers(0, top, n)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    s = np.tile([3, 1, 2], 40)
    assert suffix_array(s).tolist() == sorted(range(120), key=lambda i: s[i:].tolist())


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op8_suffix_array"](spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("block", [1 << 23, 3000])
def test_edges_and_mixed_passages(spark, block):
    rng = np.random.default_rng(2)
    word = ["alpha", "beta", "gamma", "delta", "eps", "é"]
    passage = [" ".join(rng.choice(word, 30)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 300), (5, "x" * 50), (5, "x" * 60), (None, "x" * 55), (7, passage[0]), (7, passage[0])]
    for i in range(10, 60):
        rows.append((i, " ".join(str(rng.choice(passage))[rng.integers(0, 40) :][: rng.integers(30, 150)] for _ in range(rng.integers(1, 5)))))
    rows += [(100 + i, passage[1] + passage[2]) for i in range(5)] + [(90, passage[1] + passage[2] + "!")]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, block string, n_bytes int")
    assert result(remove_repeats(df, block_bytes=block, segment_bytes=500)) == brute(rows)
    plain = df.select("doc_id", "text")
    kept = remove_repeats(plain, mode="bytes", block_bytes=block).collect()
    assert sorted(((r.doc_id, len(bytes(r.text))) for r in kept), key=repr) == sorted(((r[0], r[1] - r[2]) for r in brute(rows)), key=repr)
    assert remove_repeats(plain.limit(0)).collect() == []


def test_no_python_call_for_each_passage(tmp_path):
    """A block's and a segment's passages are handled in arrays, and a segment's pieces go back in few batches."""
    rng = np.random.default_rng(5)
    lines = ["".join(rng.choice(list("abcdefgh "), 120)) for _ in range(1500)]
    texts = [" ".join(rng.choice(lines, 10)) for _ in range(600)]
    work, solve = substring_dedup._send_contexts(1), substring_dedup._solve_contexts(50)
    given, sent, n, profile = [], [], 0, cProfile.Profile()
    for k in range(10):
        path = str(tmp_path / f"{k}.parquet")
        pq.write_table(pa.table({"doc_id": range(k * 60, k * 60 + 60), "text": texts[k * 60 : k * 60 + 60]}), path)
        block = substring_dedup.Block(path, pa.fs.LocalFileSystem(), "doc_id", "text", 50, set())
        hashes = np.unique(block.occurrences()[-1])
        n += len(hashes)
        given.append((path, block, [(1, 0, substring_dedup._five(hashes).tobytes(), None, None, None)]))
    for g in given:
        made = profile.runcall(lambda g=g: list(work(*g)))
        sent += [tuple(r.values()) for b in made for r in b.to_pylist()]
    batches = profile.runcall(lambda: list(solve(sent)))
    assert len(sent) == 10 and n > 30_000
    assert sum(b.num_rows for b in batches) == 10 and len(batches) == 1
    assert pstats.Stats(profile).total_calls < n


def test_strings_that_share_a_fingerprint_are_told_apart(spark, monkeypatch):
    raw = np.frombuffer(b"abcdefghijabcdefghiXabcdefghijabc" + bytes(8), np.uint8)
    start, sizes, h = np.array([0, 10, 20, 30, 0]), np.array([10, 10, 10, 3, 3]), np.array([7, 7, 7, 7, 3], np.uint64)
    for mix in (substring_dedup._MIX, np.uint64(0)):
        monkeypatch.setattr(substring_dedup, "_MIX", mix)
        order, begin = substring_dedup.grouped(raw, start, sizes, h)
        groups = sorted(sorted(g.tolist()) for g in np.split(order, begin[1:]))
        assert groups == [[0, 2], [1], [3], [4]] and order[0] == 4

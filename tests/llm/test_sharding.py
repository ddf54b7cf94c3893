import zlib
from collections import Counter

import numpy as np
import pytest

from mnemoflow.llm import common, sharding
from mnemoflow.llm.queries import QUERIES


def laws(rows, shards, n):
    sizes = Counter(r.shard for r in rows)
    assert sum(sizes.values()) == len(rows) == n and all(0 <= s < shards for s in sizes)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_whole_table(spark, sf_dir):
    rows = QUERIES["op4_sharding"](spark, sf_dir).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    laws(rows, 24, len(docs))
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1
    again = {r.doc_id: (r.shard, r.slot) for r in QUERIES["op4_sharding"](spark, sf_dir).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2000])
def test_edges(spark, bucket_bytes):
    rows = [(None, None, 1), (None, "a", 1), (1, "", 2), (1, "", 2), (2, "x" * 500_000, 3)] + [(7, "same", 4)] * 3000 + [(i, f"t{i}", 5) for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    made = sharding.shuffled(df, 5, bucket_bytes=bucket_bytes)
    got = made.collect()
    laws(got, 5, len(rows))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    laws(sharding.shuffled(df.limit(3), 24).collect(), 24, 3)
    assert sharding.shuffled(df.limit(0), 4).collect() == []


def test_written_shards_hold_the_texts(spark):
    df = spark.createDataFrame([(i, f"text {i}", "x") for i in range(100)], "doc_id long, text string, source string")
    path = common.scratch_path(spark, "shards-test")
    sharding.write_shards(df, path, 3)
    back = spark.read.parquet(path)
    assert set(back.columns) == {"doc_id", "text", "source", "shard", "slot"}
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, f"text {i}") for i in range(100)]

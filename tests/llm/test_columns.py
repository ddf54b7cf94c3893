"""Clashing columns, ids of other types, nulls and empty tables, for operators that carry rows and for the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemoflow.llm import common, packing, sharding, simhash, substring_dedup
from mnemoflow.llm.queries import tokenizer_path

PASSAGE = "a passage of well over fifty bytes that stands in more than one document of this table"
ROWS = [(1, f"one {PASSAGE} end"), (2, f"two words more {PASSAGE}"), (3, "the very same short text"), (4, "the very same short text"), (5, None), (6, ""), (None, "no id here"), (7, "x " * 3000), (2, f"two words more {PASSAGE}")]
CLASHING = ["_bucket", "_rank", "_tie", "_place", "_kept", "_fp", "_id", "_least", "root", "fp", "n_bytes", "n_removed", "n_spans", "n_chars", "c0", "doc", "kind", "block", "segment", "part"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select(*(F.lit(f"own {c}").alias(c) for c in CLASHING if c != "n_chars"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", F.lit(1).alias("c1"))


def carried(rows, names):
    return all(r[c] == f"own {c}" for r in rows for c in names if c in CLASHING and c != "n_chars")


def test_sharding_carries_any_columns(docs):
    made = sharding.shuffled(docs, 4)
    rows = made.collect()
    assert made.columns == [*docs.columns, "shard", "slot"] and len(rows) == len(ROWS) and carried(rows, docs.columns)
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(ROWS, key=repr)
    assert sharding.shuffled(docs.limit(0), 4).collect() == []


def test_deduplicate_carries_any_columns(docs):
    made = simhash.deduplicate(docs)
    rows = made.collect()
    assert made.columns == docs.columns and carried(rows, docs.columns)
    assert sorted(((r.doc_id, (r.text or "")[:8]) for r in rows), key=repr) == sorted([(1, "one a pa"), (2, "two word"), (3, "the very"), (5, ""), (None, "no id he"), (7, "x x x x ")], key=repr)
    assert simhash.deduplicate(docs.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["string", "int", "smallint", "decimal(20,0)"])
def test_ids_of_any_type(spark, docs, kind):
    typed = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    near = simhash.near_duplicates(typed)
    whole = kind in ("int", "smallint")
    assert {str(r.component_id) for r in near.filter("doc_id = 4").collect()} == {"3"}
    assert near.schema["doc_id"].dataType.simpleString() == ("bigint" if whole else kind)
    pieces = packing.pack(typed, tokenizer_path())
    assert pieces.schema["doc_id"].dataType == typed.schema["doc_id"].dataType
    assert {str(r.doc_id) for r in pieces.collect()} == {str(i) for i, _ in ROWS}
    assert len(sharding.shuffled(typed, 3).collect()) == len(ROWS)
    if whole:
        assert substring_dedup.remove_repeats(typed).count() == len(ROWS)
    else:
        with pytest.raises(ValueError):
            substring_dedup.remove_repeats(typed)


def test_counts_replace_columns_of_their_names(docs):
    made = substring_dedup.remove_repeats(docs, mode="text")
    got = {(r.doc_id, r.text, r.n_removed) for r in made.collect()}
    assert made.columns.count("n_removed") == 1 and carried(made.collect(), set(docs.columns) - {"n_bytes", "n_removed", "n_spans"})
    cut = f"e {PASSAGE}"
    assert (2, "two words mor", len(cut)) in got and (1, f"one {PASSAGE} end", 0) in got


def test_pipeline_stages_take_any_rows_and_columns(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
        assert empty.collect() == []
        made = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "packing":
            assert {r.doc_id for r in made.collect()} <= {i for i, _ in ROWS}
            continue
        docs = common.materialize(made, f"test-{name}")
        rows = docs.collect()
        assert rows and carried(rows, docs.columns) and docs.columns[-4:] == ["doc_id", "n_chars", "text", "c1"]
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)

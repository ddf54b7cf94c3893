import corpus_pipeline
from mnemoflow.llm import common, decontaminate

from .test_packing import check
from .test_simhash import brute as near
from .test_substring_dedup import brute as repeats


def remaining(t, rows_before):
    """Texts with the repeated bytes cut, by the definition."""
    first = {}
    for i, x in rows_before:
        b = (x or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(first.get(b[s : s + 50], i), i)
    out = {}
    for i, x in rows_before:
        b = (x or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not (b and all(gone)):
            out[i] = kept
    return out


def slow_hits(text, items):
    w = decontaminate.words((text or "").encode())
    for item in items:
        k = decontaminate.words(item.encode())
        n = min(10, len(k))
        grams = {tuple(k[i : i + n]) for i in range(len(k) - n + 1)} if n else set()
        if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1)):
            return True
    return False


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert got.items() <= rows.items() and 0.7 * len(rows) < len(got)
        elif name == "simhash":
            keep = {i for i, _, _, c in near(list(rows.items())) if i == c}
            assert got == {i: rows[i] for i in keep}
        elif name == "suffix_array":
            assert got == remaining(None, list(rows.items()))
        else:
            assert got == {i: t for i, t in rows.items() if not slow_hits(t, items)}
        rows = got
    padding, _ = check(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect(), rows)
    assert padding < 0.02
    assert repeats([(1, "a")])


def test_run_is_its_stages(spark):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and "sequence_id" in made.columns


def test_near_duplicates_with_repeated_rows(spark):
    from mnemoflow.llm import simhash

    rows = [(3, "a b c"), (3, "a b c"), (4, "a b c"), (None, "q w e r t y"), (None, "q w e r t y"), (9, "z x c v b n m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicate(df).collect()), key=repr)
    assert got == sorted([(3, "a b c"), (None, "q w e r t y"), (9, "z x c v b n m")], key=repr)


def test_spans_can_go_instead_of_documents(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {passage}! after", 5), (2, "clean text", 6), (3, None, 7)], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([(7, passage), (8, "short item"), (9, None), (10, "")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.hits) for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert got == {1: ("Before, ! after", 5), 2: ("clean text", 6), 3: (None, 7)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 3}
    several = decontaminate.report(docs, bench, block_bytes=16).collect()
    assert sorted(tuple(r) for r in several) == sorted(tuple(r) for r in decontaminate.report(docs, bench).collect())
    assert decontaminate.report(docs.limit(0), bench).collect() == [] and decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0

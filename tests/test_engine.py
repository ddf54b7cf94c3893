"""Behaviour of the engine's steps on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoflow import rpc
from mnemoflow.api import MemoryEngine
from mnemoflow.config import Config
from mnemoflow.errors import InvalidInput
from mnemoflow.functions import text as T
from mnemoflow.functions.entities import with_entities
from mnemoflow.functions.vectors import fnv1a, fnv1a_py, hash_vector
from mnemoflow.operators import calibration, fusion, graph, hierarchy
from mnemoflow.operators.profile import profiles
from mnemoflow.sources.tail import complete_end
from mnemoflow.storage import dense_index


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def canons(spark, text, kind=None):
    found = with_entities(spark.createDataFrame([(text,)], "text string")).first().entities
    return [e.canon for e in found if kind is None or e.kind == kind]


@pytest.mark.parametrize(
    "text,want",
    [("Carrie's dog -- 'quoted' v2.5", ["carrie's", "dog", "quoted", "v2", "5"]), ("", []), ("…  ", []), ("Ünï ΣΑΣ 42", ["ünï", "σας", "42"])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, T.tokens(F.col("text"))) == want


def test_content_tokens_drop_stop_words_and_single_bytes(spark):
    assert one(spark, "The x cat and é sat", T.content_tokens(F.col("text"))) == ["cat", "é", "sat"]


def test_sentences(spark):
    assert one(spark, "One v2.5 here. Two?  Three\nFour!", T.sentences(F.col("text"))) == ["One v2.5 here.", "Two?", "Three", "Four!"]


def test_names(spark):
    assert canons(spark, "We met Maria Lopez's sister in San Juan de Puerto.", "Named") == ["maria lopez", "san juan de puerto"]
    assert canons(spark, "Hello friend. Thanks for that. Paris was fine.", "Named") == ["paris"]
    assert canons(spark, "Carrie and I are late", "Named") == ["carrie and i"]


def test_dates_numbers_and_quotes(spark):
    text = 'On February 14, 2022 and 2023-01-05 she paid $1,200.50 for 7 in 1999; "the red door" "--flag x" `Code 55` 1'
    assert canons(spark, text, "Date") == ["2023-01-05", "february 14, 2022", "1999"]
    assert canons(spark, text, "Number") == ["$1,200.50", "7"]
    assert canons(spark, text, "Quote") == ["the red door"]


def test_links_and_addresses(spark):
    assert canons(spark, "see https://a.b/c?d=1 or me.x@mail.example.org", "Url") == ["https://a.b/c?d=1"]
    assert canons(spark, "see https://a.b/c?d=1 or me.x@mail.example.org", "Email") == ["me.x@mail.example.org"]


def test_fnv(spark):
    for s in ("", "a", "^çat$"):
        h = one(spark, s, fnv1a(F.col("text")))
        assert h.hi << 32 | h.lo == fnv1a_py(s.encode())
    v = hash_vector(["cats", "sleep"], 256)
    assert abs(v @ v - 1) < 1e-12 and v @ hash_vector(["cat", "sleeps"], 256) > v @ hash_vector(["bridge"], 256)


def test_profiles(spark):
    q = spark.createDataFrame([(1, "Whose book was it?"), (2, "When did Ann move, in March 2020?"), (3, "What happened in our third chat?"), (4, "How many times did Bob and Eve meet on 2022-02-14?")], "query_id int, text string")
    p = {r.query_id: r for r in profiles(q).collect()}
    assert p[1].answer_type == "Person"
    assert p[2].answer_type == "Time" and [tuple(r) for r in p[2].ranges] == [(1583020800, 1585699199)]
    assert p[3].boundary == 2 and p[3].route == "Local"
    assert p[4].aggregation and p[4].route == "Relational" and p[4].subjects == ["bob and eve"]


def test_fusion(spark):
    g = spark.createDataFrame([(1, 0, 10.0), (1, 1, 5.0)], "query_id int, idx long, score double")
    h = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id int, idx long, score double")
    w = spark.createDataFrame([(1, 0.6, 0.4)], "query_id int, w_graph double, w_hier double")
    assert [(r.idx, round(r.score, 9)) for r in fusion.fuse(g, h, w, 3).orderBy("rank").collect()] == [(0, 0.6), (1, 0.4), (2, 0.0)]
    assert [r.score for r in fusion.min_max(g.limit(1)).collect()] == [1.0]


def naive_hierarchy(rows, size, gap, threshold):
    """Window and episode starts by stepping through the turns."""
    import numpy as np

    windows, episodes, last = [], [], None
    for i, (s, ts, v) in enumerate(rows):
        changed = last is None or last[0] != s
        pause = not changed and ts - last[1] > gap
        if changed or pause or len(windows[-1]["v"]) >= size:
            new = changed or pause
            if not new and len(windows) > 1 and windows[-2]["e"] == windows[-1]["e"]:
                a, b = (np.mean(w["v"], axis=0) for w in windows[-2:])
                new = (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) < threshold
            if new:
                episodes.append(i)
            windows.append({"start": i, "e": episodes[-1], "v": [v]})
        else:
            windows[-1]["v"].append(v)
        last = (s, ts)
    return [(w["start"], w["e"]) for w in windows]


def test_hierarchy_against_the_recurrence(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows, ts = [], 0
    for _ in range(400):
        ts += int(rng.choice([1, 50, 101, 500], p=[0.6, 0.37, 0.02, 0.01]))
        v = np.eye(3)[rng.integers(0, 3)] + 0.1 * rng.random(3)
        rows.append(("ab"[int(rng.random() < 0.02) if len(rows) % 90 else 1], ts, v))
    cfg = Config(window_size=2, episode_gap=100, drift_threshold=0.5)
    df = spark.createDataFrame([(i, s, t, v.tolist()) for i, (s, t, v) in enumerate(rows)], "idx long, session_id string, ts long, vec array<double>")
    w = hierarchy.windows(hierarchy.segments(df.drop("vec"), 100, 2), df.select("idx", "vec"))
    got = sorted((r.window_start, r.episode) for r in hierarchy.episodes(w, cfg).collect())
    assert got == naive_hierarchy(rows, 2, 100, 0.5)


def test_edge_weights_sum_to_one(spark):
    turns = spark.createDataFrame([(0, "Maria met Bob. Maria left with Bob and Maria."), (1, "then Bob slept")], "idx long, text string")
    m = graph.mentions(turns)
    e = graph.edges(m, graph.catalog(m))
    assert all(abs(r.s - 1) < 1e-12 for r in e.groupBy("idx").agg(F.sum("w_turn").alias("s")).collect())
    assert all(abs(r.s - 1) < 1e-12 for r in e.groupBy("entity_id").agg(F.sum("w_entity").alias("s")).collect())


def test_dense_index_with_one_hot_key(spark):
    df = spark.range(0, 1000).select(F.when(F.col("id") < 900, 1).otherwise(2).alias("k"), (1000 - F.col("id")).alias("o"))
    got = [(r.k, r.o) for r in dense_index(df, "k", "o").orderBy("idx").collect()]
    assert got == sorted(got) and dense_index(df, "k", "o").agg(F.max("idx")).first()[0] == 999
    assert dense_index(df.limit(0), "k").collect() == []


def test_tail_hands_on_complete_lines(tmp_path):
    f = tmp_path / "t.jsonl"
    assert complete_end(str(f), 5) == (0, 0)
    f.write_bytes(b"one\ntwo\nhal")
    assert complete_end(str(f), 0) == (0, 8)
    f.write_bytes(b"x\n")
    assert complete_end(str(f), 8) == (0, 2)


def test_tail_stream(spark, tmp_path):
    from mnemoflow.sources.tail import TailSource

    spark.dataSource.register(TailSource)
    (tmp_path / "a.jsonl").write_text("one\ntwo\npart")
    q = spark.readStream.format("tail").option("path", f"{tmp_path}/*.jsonl").load().writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (tmp_path / "a.jsonl").write_text("one\ntwo\npart done\n")
        q.processAllAvailable()
        assert sorted(r.value for r in spark.table("tailed").collect()) == ["one", "part done", "two"]
    finally:
        q.stop()


LINES = [
    ("s1", "user", "Maria Lopez moved to Lisbon on February 14, 2022."),
    ("s1", "assistant", "Lisbon is a fine city."),
    ("s2", "user", "Bob Stone paid 42 euros for the lamp in Lisbon."),
    ("s2", "assistant", "That lamp is worth it, Bob."),
    ("s3", "user", "Maria Lopez now lives in Porto with her cat."),
]


def test_engine_life_cycle(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(i, *r, 1000 * i, f"u{i}") for i, r in enumerate(LINES)], "o long, session_id string, speaker string, text string, ts long, source_uuid string")
    assert e.ingest(rows, "o") == 5 and e.ingest(rows, "o") == 0
    with pytest.raises(InvalidInput):
        e.ingest_turn("s1", "user", " \n", 0)
    found = e.query("Who moved to Lisbon?")
    assert any("Maria Lopez moved" in x["text"] for x in found["evidence"]) and found["route"] in ("Relational", "Local")
    last = e.query("What was said in the last session?")
    assert last["evidence"] and {x["session_id"] for x in last["evidence"]} == {"s3"}
    reply = rpc.answer(e, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "forget_session", "arguments": {"session_id": "s1"}}}))
    assert json.loads(reply["result"]["content"][0]["text"]) == {"removed": 2}
    assert e.stats()["turns"] == 3 and all(x["session_id"] != "s1" for x in e.query("Who moved to Lisbon?")["evidence"])
    assert e.ingest_turn("s1", "user", "Back again in Lisbon", 9) == 1
    assert e.turns.agg(F.max("id")).first()[0] == 6
    assert e.calibrate_answer("How many lamps?", "none", ["There were 42 of them."])["answer"] == "42"


def test_rpc_protocol():
    assert rpc.answer(None, '{"method":"notifications/initialized"}') is None
    assert rpc.answer(None, '{"id":1,"method":"nope"}')["error"]["code"] == -32601
    assert len(rpc.answer(None, '{"id":1,"method":"tools/list"}')["result"]["tools"]) == 3
    assert rpc.answer(None, '{"id":1,"method":"tools/call","params":{"name":"x"}}')["result"]["isError"]
    assert all(rpc.answer(None, x) is None for x in ("{", "5", "null", '"id"', "[1]"))
    missing = rpc.answer(None, '{"id":1,"method":"tools/call","params":{"name":"recall","arguments":[1]}}')["result"]
    assert missing["isError"] and "query" in missing["content"][0]["text"]


def test_a_uuid_is_stored_once_in_all_sessions(spark, tmp_path):
    from mnemoflow.schema import SPOOL
    from mnemoflow.streaming.spool import drain, write_event

    for k, rows in enumerate([[("s1", "user", "first", 1, "u-1"), ("s1", "user", "no id", 2, None)], [(f"s{i}", "user", "again", 3, "u-1") for i in range(2, 6)] + [("s9", "user", "new", 4, "u-2"), ("s9", "user", "no id", 5, None)]]):
        write_event(spark.createDataFrame(rows, SPOOL).coalesce(1), f"{tmp_path}/in")
        drain(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
        got = sorted((r.session_id, r.text) for r in spark.read.parquet(f"{tmp_path}/store").collect())
        assert got == [("s1", "first"), ("s1", "no id")] + [("s9", "new"), ("s9", "no id")] * k


def test_turn_lines(spark, tmp_path):
    from mnemoflow.sources.jsonl import read_turn_lines

    f = tmp_path / "turns.jsonl"
    f.write_text('{"session_id":"s1","text":"one"}\n\n{"session_id":"s1","speaker":"bot","text":"two","ts":77}\n{"session_id":"s2","text":"three"}\n')
    got = [(r.line, r.session_id, r.speaker, r.text, r.ts) for r in read_turn_lines(spark, str(f)).orderBy("line").collect()]
    assert got == [(0, "s1", "user", "one", 0), (1, "s1", "bot", "two", 77), (2, "s2", "user", "three", 2)]
    f.write_text('{"session_id":"s1","text":"one"}\n{"session_id":"s1"}\n')
    with pytest.raises(InvalidInput):
        read_turn_lines(spark, str(f))
    f.write_text("".join(json.dumps({"session_id": "s", "text": f"line {i}"}) + "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [r.text for r in read_turn_lines(spark, str(f)).orderBy("line").collect()] == [f"line {i}" for i in range(5000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_the_first_file_by_name_wins(spark, tmp_path):
    from mnemoflow.streaming.spool import drain

    spool = tmp_path / "in"
    spool.mkdir()
    for name, text in (("2-b.json", "late"), ("1-a.json", "early")):
        (spool / name).write_text(json.dumps({"session_id": "s", "speaker": "user", "text": text, "ts": 1, "uuid": "u"}) + "\n")
    drain(spark, str(spool), f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/store").collect()] == ["early"]
    e = MemoryEngine(spark, str(tmp_path / "db"))
    assert e.drain(str(spool)) == 1 and e.drain(str(spool)) == 0 and e.drain(str(tmp_path / "none")) == 0
    assert [r.text for r in e.turns.collect()] == ["early"]


def test_serving_drains_the_spool_first(spark, tmp_path):
    from mnemoflow.schema import SPOOL
    from mnemoflow.streaming.spool import write_event

    e = MemoryEngine(spark, str(tmp_path / "db"))
    write_event(spark.createDataFrame([("s1", "user", "Maria Lopez moved to Lisbon.", 1, "u-1")], SPOOL), f"{tmp_path}/in")
    line = json.dumps({"id": 1, "method": "tools/call", "params": {"name": "forget_session", "arguments": {"session_id": "s1"}}})
    reply = json.loads(next(rpc.serve(e, ["null", line], lambda: e.drain(f"{tmp_path}/in"))))
    assert json.loads(reply["result"]["content"][0]["text"]) == {"removed": 1}


def test_superseded_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(3)), i, int(rng.integers(20)), [str(x) for x in rng.integers(0, 4, rng.integers(1, 4))]) for i in range(120)]
    got = {(r.query_id, r.idx) for r in calibration.superseded(spark.createDataFrame(rows, "query_id int, idx int, ts int, vals array<string>")).collect()}
    assert got == {(q, i) for q, i, t, v in rows if any(q == q2 and t2 > t and not set(v) & set(v2) for q2, _, t2, v2 in rows)}


def test_products_that_cancel_are_no_similarity(spark):
    from mnemoflow.operators.dense import similarities

    v = spark.createDataFrame([(0, [0.1, 0.2, -0.3]), (1, [0.1, 0.2, 0.0])], "idx long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "query_id int, vec array<double>")
    assert [r.idx for r in similarities(v, q).collect()] == [1]


def test_a_seed_among_equals_is_the_first_entity(spark):
    p = spark.createDataFrame([(1, ["x"], ["x"])], "query_id int, subjects array<string>, phrases array<string>")
    e = spark.createDataFrame([(5, "a"), (9, "b")], "entity_id long, canon string")
    ev = spark.createDataFrame([(5, [0.8, 0.6]), (9, [0.8 + 1e-13, 0.6])], "entity_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vec array<double>")
    assert [r.entity_id for r in graph.seeds(p, e, q, ev).collect()] == [5]


def test_pagerank_against_a_dense_matrix(spark):
    texts = ["Maria met Bob Stone", "then Maria saw Eve", "nothing here", "she likes Zoe and Bob Stone", "alone"]
    turns = spark.createDataFrame([(i, "ab"[i == 4], t) for i, t in enumerate(texts)], "idx long, session_id string, text string")
    edge = spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 2, 0.5, 0.5), (1, 1, 0.25, 0.5), (1, 3, 0.25, 1.0), (1, 4, 0.5, 1.0), (3, 2, 1.0, 0.5)], "idx long, entity_id long, w_turn double, w_entity double")
    reset = spark.createDataFrame([(1, "e4", 0.5), (1, "t2", 0.5), (2, "e1", 0.25), (2, "e3", 0.25), (2, "t0", 0.5), (3, "t4", 1.0)], "query_id int, node string, r double")
    trans = [(r.src, r.dst, r.p) for r in graph.transitions(turns, edge).collect()]
    nodes = sorted({x for s, d, _ in trans for x in (s, d)})
    m = np.zeros((len(nodes), len(nodes)))
    for s, d, p in trans:
        m[nodes.index(d), nodes.index(s)] += p
    want = {}
    for q in (1, 2, 3):
        r = np.zeros(len(nodes))
        for x in reset.collect():
            r[nodes.index(x.node)] += x.r * (x.query_id == q)
        pi = r
        for _ in range(12):
            pi = 0.6 * m @ pi + 0.4 * r
        want |= {(q, x): v for x, v in zip(nodes, pi) if x[0] == "t" and v > 0}
    for width in (2, 64):
        got = {(r.query_id, r.node): r.mass for r in graph.pagerank(reset, turns, edge, Config(pagerank_steps=12), 5, width).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert graph._links(turns, edge).filter("src = -4").count() == 1  # Eve and Zoe of the second turn are one node


def test_embedding_in_pieces(spark):
    from mnemoflow.functions.vectors import HashEmbedder, _cells

    texts = [(i, f"It's turn {i} of Ann's, ünï" if i % 7 else None) for i in range(300)]
    rows = spark.createDataFrame(texts, "i int, t string").coalesce(1).select("i", T.tokens(F.col("t")).alias("k"), HashEmbedder(64, 128).embed(F.col("t")).alias("v")).collect()
    assert len(rows) == 300 and all(np.allclose(r.v, hash_vector(r.k or (), 64)) for r in rows)
    assert _cells.cache_info().maxsize <= 1 << 15


def test_window_means_take_no_row_a_cell(spark):
    df = spark.createDataFrame([(i, "s", 0, [float(i), 2.0]) for i in range(6)], "idx long, session_id string, ts long, vec array<double>")
    w = hierarchy.windows(hierarchy.segments(df.drop("vec")), df.select("idx", "vec"))
    assert [(r.window_start, r.n, list(r.centroid)) for r in w.orderBy("window_start").collect()] == [(0, 4, [1.5, 2.0]), (4, 2, [4.5, 2.0])]
    assert "Generate" not in w._jdf.queryExecution().optimizedPlan().toString()

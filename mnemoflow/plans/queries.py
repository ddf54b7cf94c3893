"""Registered queries over the driver's tables, one for each operator or step of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import date_range, iso_timestamp
from ..functions.entities import mask_code
from ..functions.vectors import fnv1a
from ..operators import calibration, closure, fusion, graph, hierarchy, ingest, lexical
from ..operators.dense import nearest, similarities
from ..operators.profile import profiles, with_weights
from ..sources.bindings import conversation_turns, event_turns, session_positions
from ..sources.transcripts import parse_transcript
from ..storage import dense_index, written
from .recall import Index, Recall

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

QUESTIONS = [
    (1, "When did Thha and Erer talk about the thtion in the first conversation?"),
    (2, "Who told Tion about thing?"),
    (3, "What are all the heat that Onre and Thea know of thing?"),
    (4, "How many times did Rethen mention ering with Ble?"),
    (5, "Where is the latest erin of Thin in the last session?"),
    (6, "Is Nobodyknown near erth thor yesterday?"),
]


def query(f):
    QUERIES[f.__name__] = f
    return f


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_recalls: dict[tuple, Recall] = {}


def recall_of(spark: SparkSession, sf_dir: str) -> Recall:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _recalls:
        _recalls[key] = Recall(Index(conversation_turns(spark, sf_dir)), questions(spark))
    return _recalls[key]


@query
def ingest_session_ordinals(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("idx", "id", "session_id", "session_turn", "speaker", "ts", "source_uuid")


@query
def ingest_dedup_uuid(spark, sf_dir):
    """All events arrive twice while purchases are stored already."""
    turns = event_turns(spark, sf_dir)
    return ingest.new_turns(turns.unionAll(turns), turns.filter("speaker = 'purchase'"), "idx").select("source_uuid", "session_id", "speaker", "ts")


@query
def ingest_numbering(spark, sf_dir):
    """Events other than sign-ups are appended to a store that holds the sign-ups."""
    turns = event_turns(spark, sf_dir)
    stored = turns.filter("speaker = 'signup'")
    first = stored.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    stored = first.select("session_id", (F.col("n") - 1).alias("session_turn"))
    return ingest.number_turns(turns.filter("speaker <> 'signup'"), stored, "idx").select("source_uuid", "session_id", "session_turn")


@query
def incremental_scan_hwm(spark, sf_dir):
    return ingest.scan_after(conversation_turns(spark, sf_dir), 100).select("id", "session_id", "text")


@query
def forget_session(spark, sf_dir):
    """Sessions with a system turn are forgotten."""
    turns = conversation_turns(spark, sf_dir)
    return ingest.forget(turns, turns.filter("speaker = 'system'")).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns"), F.min("id").alias("first_id"))


@query
def store_stats(spark, sf_dir):
    return conversation_turns(spark, sf_dir).agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"), F.max("session_turn").alias("longest"))


@query
def engine_stats(spark, sf_dir):
    return recall_of(spark, sf_dir).index.stats()


@query
def session_order(spark, sf_dir):
    return session_positions(conversation_turns(spark, sf_dir))


@query
def token_frequencies(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def content_token_frequencies(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.explode(T.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def sentence_counts(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n_kept"))


@query
def masked_code(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(mask_code(F.col("html")).cast("binary")).alias("masked"))


@query
def pattern_entities(spark, sf_dir):
    found = graph.mentions(read(spark, sf_dir, "documents"), "doc_id").filter("kind <> 'Named'")
    return found.groupBy("doc_id", "kind", "canon").agg(F.count(F.lit(1)).alias("n"))


@query
def named_spans(spark, sf_dir):
    return recall_of(spark, sf_dir).index.mentions.filter("kind = 'Named'").groupBy("idx", "canon").agg(F.count(F.lit(1)).alias("n"))


@query
def entity_catalog(spark, sf_dir):
    return recall_of(spark, sf_dir).index.entities.select("canon", "display", "kind", F.shiftright("entity_id", 20).alias("first_idx"))


@query
def edge_weights(spark, sf_dir):
    i = recall_of(spark, sf_dir).index
    return i.edges.join(i.entities, "entity_id").select("idx", "canon", "cnt", F.round("w_turn", 9).alias("w_turn"), F.round("w_entity", 9).alias("w_entity"))


@query
def turn_adjacency(spark, sf_dir):
    return graph.adjacency(conversation_turns(spark, sf_dir))


@query
def transition_mass(spark, sf_dir):
    return recall_of(spark, sf_dir).index.transitions.filter("src like 't%'").groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.round(F.sum("p"), 9).alias("p_out"))


@query
def bm25_topk(spark, sf_dir):
    r = recall_of(spark, sf_dir)
    return lexical.top_turns(r.bm25, 5).select("query_id", "rank", "idx", F.round("score", 6).alias("score"))


@query
def bm25_scores(spark, sf_dir):
    return recall_of(spark, sf_dir).bm25.select("query_id", "idx", F.round("score", 6).alias("score"))


@query
def phrase_match_counts(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    phrases = F.array(*[F.lit(p) for p in ("the tion", "ering", "", "tion", "ering", "und")])
    return turns.select("idx", T.phrase_matches(phrases, F.col("text")).cast("long").alias("n"))


@query
def fnv1a_tokens(spark, sf_dir):
    tokens = conversation_turns(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    h = fnv1a(F.col("token"))
    return tokens.select("token", h["hi"].alias("hi"), h["lo"].alias("lo"))


@query
def hash_embedding_cells(spark, sf_dir):
    v = recall_of(spark, sf_dir).index.vectors.select("idx", F.posexplode("vec").alias("bucket", "v"))
    return v.filter(F.abs("v") > 1e-9).select("idx", F.col("bucket").cast("long").alias("bucket"), F.round("v", 6).alias("v"))


@query
def hash_similarities(spark, sf_dir):
    return recall_of(spark, sf_dir).sims.filter(F.abs("sim") > 1e-6).select("query_id", "idx", F.round("sim", 6).alias("sim"))


def _probe(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All embeddings, and the first of each label as a query."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    first = v.groupBy("label").agg(F.min_by("vec", "idx").alias("vec"))
    return v.select("idx", "vec"), first.select(F.col("label").alias("query_id"), "vec")


@query
def dense_topk(spark, sf_dir):
    v, q = _probe(spark, sf_dir)
    return nearest(v, q, 5).select("query_id", "rank", "idx", F.round("sim", 6).alias("sim"))


@query
def dense_alignment(spark, sf_dir):
    """The nearest vector beyond the alignment threshold."""
    v, q = _probe(spark, sf_dir)
    sims = similarities(v, q).filter("sim > 0.55")
    best = sims.groupBy("query_id").agg(F.max(F.struct(F.round("sim", 9).alias("s"), (-F.col("idx")).alias("n"))).alias("b"))
    return best.select("query_id", (-F.col("b.n")).alias("idx"), F.round("b.s", 6).alias("sim"))


@query
def segments_and_windows(spark, sf_dir):
    return hierarchy.segments(event_turns(spark, sf_dir)).select("idx", "session_id", "segment", "window_start")


@query
def gap_episodes(spark, sf_dir):
    """Runs of events in arrival order: sessions interleave, so an episode ends at each change of session."""
    s = hierarchy.segments(event_turns(spark, sf_dir, "ts", "event_id"))
    return s.groupBy("segment").agg(F.max("idx").alias("end_idx"), F.count(F.lit(1)).alias("n"), F.min("session_id").alias("session_id"))


def _vector_turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Embeddings in order of label and vec_id, a label a session."""
    rows = dense_index(read(spark, sf_dir, "embeddings"), "label", "vec_id")
    rows = rows.select("idx", F.col("label").cast("string").alias("session_id"), F.lit(0).cast("long").alias("ts"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return rows.drop("vec"), rows.select("idx", "vec")


@query
def window_centroids(spark, sf_dir):
    turns, vectors = _vector_turns(spark, sf_dir)
    w = hierarchy.windows(hierarchy.segments(turns), vectors)
    return w.select("window_start", "end_idx", "n", F.posexplode("centroid").alias("pos", "x")).select("window_start", "end_idx", "n", "pos", F.round("x", 6).alias("x"))


@query
def drift_episodes(spark, sf_dir):
    turns, vectors = _vector_turns(spark, sf_dir)
    w = written(hierarchy.windows(hierarchy.segments(turns), vectors), "windows")
    return hierarchy.episodes(w).select("window_start", "segment", "episode", "n")


@query
def query_profiles(spark, sf_dir):
    p = with_weights(profiles(questions(spark)))
    joined = {c: F.array_join(c, "|").alias(c) for c in ("subjects", "phrases", "keywords", "mentions")}
    return p.select("query_id", *joined.values(), "answer_type", "boundary", "aggregation", "prefer", "route", F.round("w_graph", 6).alias("w_graph"), F.round("w_hier", 6).alias("w_hier"))


DATES = ["2022-02-14", "2022-02-31", "february 14, 2022", "feb. 3 2021", "14th february 2022", "march 2020", "february 2024", "2023", "1899", "may 5", "31 june 2020", "sometime"]


@query
def date_ranges(spark, sf_dir):
    d = spark.createDataFrame([(x,) for x in DATES], "mention string").withColumn("r", date_range(F.col("mention")))
    return d.select("mention", "r.lo", "r.hi")


STAMPS = ["2024-01-31T10:00:00Z", "2024-02-29T23:59:59.123Z", "2023-02-29T00:00:00Z", "2024-01-31T10:00:00+01:00", "2024-01-31T10:00:60Z", "2024-01-31T10:00Z", "2024-13-01T00:00:00Z", "garbage"]


@query
def iso_timestamps(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in STAMPS], "stamp string").select("stamp", iso_timestamp(F.col("stamp")).alias("seconds"))


@query
def episode_beam(spark, sf_dir):
    return recall_of(spark, sf_dir).episode_beam.select("query_id", "episode", "e_rank", F.round("e_score", 6).alias("e_score"))


@query
def window_beam(spark, sf_dir):
    return recall_of(spark, sf_dir).window_beam.select("query_id", "window_start", "w_rank", F.round("w_score", 6).alias("w_score"))


@query
def hier_scores(spark, sf_dir):
    return recall_of(spark, sf_dir).hier.select("query_id", "idx", F.round("score", 6).alias("score"))


@query
def activation_propagation(spark, sf_dir):
    r = recall_of(spark, sf_dir)
    return r.activations.join(r.index.entities, "entity_id").select("query_id", "canon", F.round("a", 6).alias("a"))


@query
def personalized_pagerank(spark, sf_dir):
    return recall_of(spark, sf_dir).ranks.filter("node like 't%' and mass > 1e-6").select("query_id", F.substring("node", 2, 20).cast("long").alias("idx"), F.round("mass", 6).alias("mass"))


@query
def minmax_fusion(spark, sf_dir):
    """BM25 as one view and the dense similarity as the other."""
    r = recall_of(spark, sf_dir)
    dense = r.sims.filter("sim > 1e-9").select("query_id", "idx", F.col("sim").alias("score"))
    return fusion.fuse(r.bm25, dense, r.profiles, 5).select("query_id", "rank", "idx", F.round("score", 6).alias("score"))


@query
def local_neighbours(spark, sf_dir):
    """Neighbours of every turn."""
    turns = conversation_turns(spark, sf_dir)
    return closure.neighbours(turns.select(F.lit(0).alias("query_id"), "idx"), turns).select("anchor", "idx", "delta")


@query
def graph_bridges(spark, sf_dir):
    """The best three bridges of each question's best BM25 turns."""
    r = recall_of(spark, sf_dir)
    return closure.bridges(lexical.top_turns(r.bm25, 5), r.index.edges, 3).select("query_id", "anchor", "idx", "b_rank", F.round("strength", 6).alias("strength"))


@query
def evidence_closure(spark, sf_dir):
    return recall_of(spark, sf_dir).closed.select("query_id", "idx", F.round("score", 6).alias("score"), "role", "anchor", "emit")


def _bm25_mains(r: Recall) -> DataFrame:
    return lexical.top_turns(r.bm25, 5)


@query
def bm25_closure(spark, sf_dir):
    """Closure with the best BM25 turns as mains, which SQL can follow step by step."""
    r = recall_of(spark, sf_dir)
    return closure.close(_bm25_mains(r), r.index.turns, r.index.edges).select("query_id", "idx", F.round("score", 6).alias("score"), "role", "anchor", "emit")


@query
def bm25_evidence(spark, sf_dir):
    """Calibration of that closure: sessions that the question names, supersession, two supports a main, the budget."""
    r = recall_of(spark, sf_dir)
    i = r.index
    closed = written(closure.close(_bm25_mains(r), i.turns, i.edges), "bm25-closed")
    return calibration.calibrate(closed, i.turns, r.profiles, i.positions).select("query_id", "rank", "idx", F.round("score", 6).alias("score"), "role")


@query
def graph_scores(spark, sf_dir):
    """Turns' PageRank mass with a quarter more for each phrase of the question that they hold."""
    return recall_of(spark, sf_dir).graph_scores.filter("score > 1e-6").select("query_id", "idx", F.round("score", 6).alias("score"))


@query
def recall(spark, sf_dir):
    return recall_of(spark, sf_dir).evidence().withColumn("score", F.round("score", 6))


@query
def superseded_values(spark, sf_dir):
    """Events as valued turns: a user's value of a type is out of date once a later one differs."""
    turns = event_turns(spark, sf_dir)
    valued = turns.select(F.concat_ws("/", "session_id", "speaker").alias("query_id"), "idx", "ts", F.array(F.regexp_extract("text", r"(\d+)", 1)).alias("vals"))
    return calibration.superseded(valued)


ANSWERS = [
    (1, "When did she move?", "In March", ["She moved on February 14, 2022.", "It rained."]),
    (2, "How many cats has Ann?", "three cats", ["Ann has three cats and 12 fish."]),
    (3, "What are the colours?", "red, green, and blue", ["The Red one", "a blue one"]),
    (4, "Who wrote it?", "nobody", ["Maria Lopez wrote it.", "Maria Lopez again"]),
    (5, "Who wrote it?", "nobody", ["Maria Lopez wrote it.", "or John Smith did"]),
    (6, "How many?", "five", ["There were 42 of them, 42 in all."]),
]


@query
def answer_calibration(spark, sf_dir):
    rows = spark.createDataFrame(ANSWERS, "query_id int, text string, answer string, evidence array<string>")
    p = profiles(rows.select("query_id", "text")).select("query_id", "answer_type", "subjects")
    out = calibration.calibrate_answers(rows.drop("text").join(p, "query_id"))
    return out.withColumn("candidates", F.array_join("candidates", "|"))


TRANSCRIPT = [
    '{"type":"user","uuid":"a","timestamp":"2024-01-31T10:00:00Z","message":{"role":"user","content":" hello there "}}',
    '{"type":"assistant","uuid":"b","timestamp":"bad","message":{"content":[{"type":"text","text":"one"},{"type":"tool_use","id":"x"},{"type":"text","text":" two "}]}}',
    '{"type":"user","uuid":"c","isMeta":true,"message":{"content":"meta"}}',
    '{"type":"user","uuid":"d","isSidechain":true,"message":{"content":"side"}}',
    '{"type":"user","uuid":"e","message":{"content":"<command-name>x</command-name>"}}',
    '{"type":"summary","uuid":"f","message":{"content":"s"}}',
    '{"type":"user","message":{"content":"no uuid"}}',
    "not json",
    '{"type":"user","uuid":"g","message":{"content":"[1] bracketed prose"}}',
]


@query
def transcript_turns(spark, sf_dir):
    return parse_transcript(spark.createDataFrame([(x,) for x in TRANSCRIPT], "value string"))


@query
def spool_stream_ingest(spark, sf_dir):
    """Conversations written as spool files, drained by a stream that runs until it has all; every file comes twice."""
    from ..streaming.spool import drain_all

    return drain_all(spark, conversation_turns(spark, sf_dir)).select("session_id", "speaker", "source_uuid", "ts", F.md5("text").alias("text_md5"))

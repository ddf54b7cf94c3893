"""Recall: from a batch of questions to calibrated evidence, as one chain of DataFrames keyed by query_id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.vectors import HashEmbedder, normalize
from ..operators import calibration, closure, fusion, graph, hierarchy, lexical, views
from ..operators.dense import similarities
from ..operators.profile import profiles, with_weights
from ..sources.bindings import session_positions
from ..storage import written


class Index:
    """Tables derived from turns; each is built when first needed and kept in the shared folder."""

    def __init__(self, turns: DataFrame, cfg: Config = DEFAULT, embedder=None):
        self.turns, self.cfg = turns, cfg
        self.embedder = embedder or HashEmbedder(cfg.dim)

    @cached_property
    def mentions(self) -> DataFrame:
        return written(graph.mentions(self.turns), "mentions")

    @cached_property
    def entities(self) -> DataFrame:
        return written(graph.catalog(self.mentions), "entities")

    @cached_property
    def edges(self) -> DataFrame:
        return written(graph.edges(self.mentions, self.entities), "edges")

    @cached_property
    def vectors(self) -> DataFrame:
        return written(self.turns.select("idx", self.embedder.embed(F.col("text")).alias("vec")), "vectors")

    @cached_property
    def entity_vectors(self) -> DataFrame:
        return self.entities.select("entity_id", self.embedder.embed(F.col("canon")).alias("vec"))  # read once, so not stored

    @cached_property
    def members(self) -> DataFrame:
        return written(hierarchy.segments(self.turns, self.cfg.episode_gap, self.cfg.window_size), "members")

    @cached_property
    def windows(self) -> DataFrame:
        return written(hierarchy.episodes(written(hierarchy.windows(self.members, self.vectors), "windows"), self.cfg), "windows")

    @cached_property
    def turn_hier(self) -> DataFrame:
        return written(self.members.select("idx", "window_start").join(self.windows.select("window_start", "episode"), "window_start"), "turn-hier")

    @cached_property
    def positions(self) -> DataFrame:
        return session_positions(self.turns)

    @cached_property
    def transitions(self) -> DataFrame:
        return written(graph.transitions(self.turns, self.edges), "transitions")

    def stats(self) -> DataFrame:
        """One row: turns, sessions, entities, windows, episodes, embedder."""
        t = self.turns.agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("session_id").alias("sessions"))
        e = self.entities.agg(F.count(F.lit(1)).alias("entities"))
        w = self.windows.agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("episode").alias("episodes"))
        values = {**t.first().asDict(), **e.first().asDict(), **w.first().asDict(), "embedder": self.embedder.id}
        return self.turns.sparkSession.createDataFrame([tuple(values.values())], "turns long, sessions long, entities long, windows long, episodes long, embedder string")


@dataclass
class Recall:
    """The steps for a batch ``queries`` (query_id, text) over an index."""

    index: Index
    queries: DataFrame

    @cached_property
    def profiles(self) -> DataFrame:
        return written(with_weights(profiles(self.queries), self.index.cfg.primary), "profiles")

    @cached_property
    def query_vectors(self) -> DataFrame:
        return written(self.queries.select("query_id", self.index.embedder.embed(F.col("text")).alias("vec")), "query-vectors")

    @cached_property
    def sims(self) -> DataFrame:
        return written(similarities(self.index.vectors, self.query_vectors), "sims")

    @cached_property
    def bm25(self) -> DataFrame:
        return written(lexical.bm25(self.profiles, self.index.turns), "bm25")

    @cached_property
    def base(self) -> DataFrame:
        return written(views.base_scores(self.sims, self.bm25), "base")

    @cached_property
    def episode_beam(self) -> DataFrame:
        return views.episode_beam(self.base, self.index.turn_hier, self.queries, self.index.cfg.episode_beam)

    @cached_property
    def window_beam(self) -> DataFrame:
        beam = written(self.episode_beam, "episode-beam")
        near = self.index.windows.join(beam.select("episode").distinct(), "episode", "left_semi").select("window_start", normalize(F.col("centroid")).alias("vec"))
        sims = similarities(near, self.query_vectors, "window_start")
        return views.window_beam(beam, self.index.windows, sims, self.base, self.index.turn_hier, self.index.cfg.window_beam)

    @cached_property
    def hier(self) -> DataFrame:
        i = self.index
        return written(views.hier_scores(self.window_beam, i.turn_hier, self.base, i.turns, self.profiles, i.edges, i.entities, i.positions, i.cfg), "hier")

    @cached_property
    def activations(self) -> DataFrame:
        i = self.index
        start = graph.seeds(self.profiles, i.entities, self.query_vectors, i.entity_vectors, i.cfg)
        return graph.propagate(written(start, "seeds"), i.edges, self.sims, i.cfg.propagation_steps)

    @cached_property
    def ranks(self) -> DataFrame:
        return graph.pagerank(graph.reset_vector(self.activations, self.sims), self.index.turns, self.index.edges, self.index.cfg)

    @cached_property
    def graph_scores(self) -> DataFrame:
        return written(graph.graph_scores(self.ranks, self.index.turns, self.profiles), "graph")

    @cached_property
    def mains(self) -> DataFrame:
        return written(fusion.fuse(self.graph_scores, self.hier, self.profiles, self.index.cfg.top_k), "mains")

    @cached_property
    def closed(self) -> DataFrame:
        return written(closure.close(self.mains, self.index.turns, self.index.edges, self.index.cfg), "closed")

    def evidence(self, exclude_session: str | None = None) -> DataFrame:
        """(query_id, route, rank, turn_id, session_id, session_turn, speaker, text, ts, score, role); a session is excluded after ranking."""
        i = self.index
        found = calibration.calibrate(self.closed, i.turns, self.profiles, i.positions, i.cfg)
        rows = found.join(i.turns, "idx").join(self.profiles.select("query_id", "route"), "query_id")
        if exclude_session is not None:
            rows = rows.filter(F.col("session_id") != exclude_session)
        return rows.select("query_id", "route", "rank", F.col("id").alias("turn_id"), "session_id", "session_turn", "speaker", "text", "ts", "score", "role")

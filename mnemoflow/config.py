"""Tunables of the retrieval engine."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    follow: float = 0.6  # share of a node's mass that moves on in a PageRank step
    primary: float = 0.6  # weight of the view that the route prefers
    top_k: int = 5
    propagation_steps: int = 2
    window_size: int = 4
    episode_gap: int = 6 * 3600
    drift_threshold: float = 0.35
    local_span: int = 2
    align_threshold: float = 0.55
    pagerank_steps: int = 30
    episode_beam: int = 4
    window_beam: int = 8
    dim: int = 256


DEFAULT = Config()

"""Evidence closure: bridges over shared entities and neighbouring turns around the main evidence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import starts_anaphoric


def bridges(mains: DataFrame, edge: DataFrame, keep: int) -> DataFrame:
    """(query_id, anchor, idx, strength, b_rank): turns that share an entity with a main turn, by the largest minimum of
    both weights, first met first. ``keep`` a main are enough: no more than that can be taken before it."""
    m = mains.select("query_id", F.col("idx").alias("anchor")).join(edge.select(F.col("idx").alias("anchor"), "entity_id", F.col("w_turn").alias("wm")), "anchor")
    rows = m.join(edge.select("idx", "entity_id", "w_turn"), "entity_id").filter("idx <> anchor")
    best = F.max(F.struct(F.least("wm", "w_turn").alias("s"), (-F.col("entity_id")).alias("e")))
    rows = rows.groupBy("query_id", "anchor", "idx").agg(best.alias("b")).select("query_id", "anchor", "idx", F.col("b.s").alias("strength"), (-F.col("b.e")).alias("via"))
    rank = F.row_number().over(Window.partitionBy("query_id", "anchor").orderBy(F.desc(F.round("strength", 12)), "via", "idx"))
    return rows.withColumn("b_rank", rank).filter(F.col("b_rank") <= keep).drop("via")


def neighbours(mains: DataFrame, turns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, anchor, idx, delta): turns of the same session at most one away, or ``local_span`` if the main is short or starts with a reference."""
    t = turns.select("idx", "session_id", "text")
    radius = F.when((F.octet_length("text") < 48) | starts_anaphoric(F.col("text")), cfg.local_span).otherwise(1)
    m = mains.select("query_id", "idx").join(t, "idx").select("query_id", F.col("idx").alias("anchor"), F.col("session_id").alias("s"), F.explode(F.sequence(-radius, radius)).alias("delta"))
    m = m.filter("delta <> 0").withColumn("idx", F.col("anchor") + F.col("delta"))
    return m.join(t.select("idx", "session_id"), "idx").filter("session_id = s").select("query_id", "anchor", "idx", "delta")


_OUT = "query_id {q}, idx long, score double, role string, anchor long, emit int"


def close(mains: DataFrame, turns: DataFrame, edge: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, idx, score, role, anchor, emit): mains, and for each in turn its best bridge not yet taken and its
    neighbours not yet taken, at half its score. What is taken depends on what was, so a small fold a query does it."""
    parts = (
        mains.select("query_id", F.col("idx").alias("anchor"), "idx", "score", F.lit("m").alias("part"), F.col("rank").alias("n"))
        .unionByName(bridges(mains, edge, 6 * cfg.top_k + 1).select("query_id", "anchor", "idx", F.col("strength").alias("score"), F.lit("b").alias("part"), F.col("b_rank").alias("n")))
        .unionByName(neighbours(mains, turns, cfg).select("query_id", "anchor", "idx", F.lit(0.0).alias("score"), F.lit("n").alias("part"), F.col("delta").alias("n")))
    )

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        query = p["query_id"].iloc[0]
        main = p[p.part == "m"].sort_values("n")
        seen = set(main.idx)
        out = [(query, i, s, "Main", i) for i, s in zip(main.idx, main.score)]
        for anchor, score in zip(main.idx, main.score):
            own = p[p.anchor == anchor].sort_values("n")
            for i in own[own.part == "b"].idx:
                if i not in seen:
                    seen.add(i)
                    out.append((query, i, score * 0.5, "GraphBridge", anchor))
                    break
            for i in own[own.part == "n"].idx:
                if i not in seen:
                    seen.add(i)
                    out.append((query, i, score * 0.5, "LocalNeighbor", anchor))
        return pd.DataFrame([(*r, k) for k, r in enumerate(out)], columns=["query_id", "idx", "score", "role", "anchor", "emit"])

    return parts.groupBy("query_id").applyInPandas(fold, _OUT.format(q=mains.schema["query_id"].dataType.simpleString()))

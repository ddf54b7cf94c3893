"""The hierarchical view: episode beam, window beam, and turns with their compatibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import phrase_matches


def base_scores(sims: DataFrame, lexical: DataFrame) -> DataFrame:
    """(query_id, idx, base): half the positive similarity, half the BM25 score as a share of the query's best. Turns with neither are left out (base 0)."""
    top = lexical.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(1e-6)).alias("top"))
    lex = lexical.join(top, "query_id").select("query_id", "idx", (0.5 * F.col("score") / F.col("top")).alias("part"))
    dense = sims.filter("sim > 0").select("query_id", "idx", (0.5 * F.col("sim")).alias("part"))
    return dense.unionByName(lex).groupBy("query_id", "idx").agg(F.sum("part").alias("base"))


def episode_beam(base: DataFrame, turn_hier: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """(query_id, episode, e_rank, e_score): best plus a tenth of the mean base; ties to the earlier episode. Episodes of which no turn scores come last, with 0."""
    sizes = turn_hier.groupBy("episode").agg(F.count(F.lit(1)).alias("n"))
    scored = base.join(turn_hier.select("idx", "episode"), "idx").groupBy("query_id", "episode").agg(F.max("base").alias("best"), F.sum("base").alias("total"))
    scored = scored.join(sizes, "episode").select("query_id", "episode", (F.col("best") + 0.1 * F.col("total") / F.col("n")).alias("e_score"))
    first = [r.episode for r in sizes.select("episode").orderBy("episode").limit(k).collect()]
    if first:  # the first k episodes stand for those without a score
        rest = query_ids.select("query_id").withColumn("episode", F.explode(F.array(*[F.lit(e).cast("long") for e in first]))).join(scored.select("query_id", "episode"), ["query_id", "episode"], "left_anti")
        scored = scored.unionByName(rest.withColumn("e_score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("e_score", 9)), "episode"))
    return scored.withColumn("e_rank", rank).filter(F.col("e_rank") <= k)


def window_beam(beam: DataFrame, windows: DataFrame, window_sims: DataFrame, base: DataFrame, turn_hier: DataFrame, k: int) -> DataFrame:
    """(query_id, window_start, w_rank, w_score): 0.4 of the centroid's positive similarity and 0.6 of the best turn, within the episode beam."""
    best = base.join(turn_hier.select("idx", "window_start"), "idx").groupBy("query_id", "window_start").agg(F.max("base").alias("best"))
    rows = beam.join(windows.select("episode", "window_start"), "episode").join(window_sims, ["query_id", "window_start"], "left").join(best, ["query_id", "window_start"], "left")
    score = 0.4 * F.greatest(F.coalesce("sim", F.lit(0.0)), F.lit(0.0)) + 0.6 * F.coalesce("best", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("w_score", 9)), "e_rank", "window_start"))
    return rows.withColumn("w_score", score).withColumn("w_rank", rank).filter(F.col("w_rank") <= k).select("query_id", "window_start", "w_rank", "w_score")


def _kinds_of(t: Column) -> Column:
    return F.when(t == "Time", "Date").when(t == "Number", "Number").when(t.isin("Person", "Entity", "Place"), "Named")


def compatibility() -> Column:
    """Bonus of a turn from subjects, dates, session, answer type and phrases, over the joined row."""
    subjects = F.size("subjects")
    hits = F.size(F.filter("subjects", lambda s: F.array_contains(F.col("canons"), s)))
    inside = F.exists("ranges", lambda r: F.col("ts").between(r["lo"], r["hi"]))
    same = F.when(F.col("boundary") == -1, F.col("last")).otherwise(F.col("pos") == F.col("boundary"))
    return (
        F.when(subjects > 0, 0.25 * hits / subjects).otherwise(0.0)
        + F.when((F.size("ranges") > 0) & inside, 0.3).otherwise(0.0)
        + F.when(F.col("boundary").isNull(), 0.0).when(same, 0.3).otherwise(-0.9)
        + F.when(F.array_contains(F.col("kinds"), _kinds_of(F.col("answer_type"))), 0.15).otherwise(0.0)
        + 0.1 * F.least(phrase_matches(F.col("phrases"), F.col("text")), F.lit(3))
    )


def hier_scores(beam: DataFrame, turn_hier: DataFrame, base: DataFrame, turns: DataFrame, profiles: DataFrame, edge: DataFrame, entities: DataFrame, positions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, idx, score) of the turns in the window beam whose score is positive."""
    rows = beam.join(turn_hier.select("idx", "window_start"), "window_start").join(base, ["query_id", "idx"]).select("query_id", "idx", "base")
    kinds = edge.join(rows.select("idx").distinct(), "idx", "left_semi").join(entities, "entity_id").groupBy("idx").agg(F.collect_set("canon").alias("canons"), F.collect_set("kind").alias("kinds"))
    rows = rows.join(turns.select("idx", "session_id", "text", "ts"), "idx").join(positions, "session_id").join(kinds, "idx", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("canons", "kinds")})
    rows = rows.join(profiles.select("query_id", "subjects", "phrases", "ranges", "boundary", "answer_type"), "query_id")
    return rows.select("query_id", "idx", (F.col("base") * (1 + F.coalesce(compatibility(), F.lit(0.0)))).alias("score")).filter("score > 0")

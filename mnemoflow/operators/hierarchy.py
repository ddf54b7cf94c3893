"""Windows and episodes of turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.vectors import dot, normalize
from ..storage import carry_last


def segments(turns: DataFrame, gap: int = DEFAULT.episode_gap, size: int = DEFAULT.window_size) -> DataFrame:
    """(idx, session_id, ts, segment, window_start): a segment begins where the session differs from the turn before or a
    pause exceeds ``gap`` seconds, and is cut into windows of ``size`` turns. The turn before is found by a join on the
    position, so neither a long session nor the global order needs a single task."""
    t = turns.select("idx", "session_id", "ts")
    before = t.select((F.col("idx") + 1).alias("idx"), F.col("session_id").alias("s0"), F.col("ts").alias("ts0"))
    rows = t.join(before, "idx", "left")
    fresh = F.col("s0").isNull() | (F.col("s0") != F.col("session_id")) | (F.col("ts") - F.col("ts0") > gap)
    rows = carry_last(rows, "idx", fresh, "segment").drop("s0", "ts0")
    return rows.withColumn("window_start", (F.col("segment") + size * F.floor((F.col("idx") - F.col("segment")) / size)).cast("long"))


def windows(members: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(window_start, segment, session_id, end_idx, n[, centroid]): the centroid is the mean of the turns' vectors."""
    out = members.groupBy("window_start").agg(F.min("segment").alias("segment"), F.min("session_id").alias("session_id"), F.max("idx").alias("end_idx"), F.count(F.lit(1)).alias("n"))
    if vectors is None:
        return out
    # one row a window: its vectors in order are added up in place, not cell by cell over the cluster
    rows = members.select("idx", "window_start").join(vectors, "idx").groupBy("window_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "vec"))), lambda s: s["vec"]).alias("vs"))
    sums = F.aggregate("vs", F.array().cast("array<double>"), lambda a, v: F.zip_with(a, v, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))))
    centroid = rows.select("window_start", F.transform(sums, lambda x, i: x / F.size(F.filter("vs", lambda v: F.size(v) > i))).alias("centroid"))
    return out.join(centroid, "window_start")


def episodes(w: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``w`` with episode, the start of the episode of each window.

    A window opens an episode at the start of its segment, or where the two finished windows before it, of one episode,
    have drifted apart. As an episode break puts the next comparison out of action, of a run of windows with such a low
    similarity the first, third, fifth and so on open one.
    """
    v = w.select("window_start", "segment", normalize(F.col("centroid")).alias("u"))
    one = v.select((F.col("window_start") + cfg.window_size).alias("window_start"), F.col("u").alias("u1"), F.col("segment").alias("s1"))
    two = v.select((F.col("window_start") + 2 * cfg.window_size).alias("window_start"), F.col("u").alias("u2"), F.col("segment").alias("s2"))
    rows = w.join(one, "window_start", "left").join(two, "window_start", "left")
    low = (F.col("s1") == F.col("segment")) & (F.col("s2") == F.col("segment")) & (dot(F.col("u1"), F.col("u2")) < cfg.drift_threshold)
    rows = rows.withColumn("low", F.coalesce(low, F.lit(False))).drop("u1", "u2", "s1", "s2")
    rows = carry_last(rows, "window_start", ~F.col("low"), "steady")
    drift = F.col("low") & (((F.col("window_start") - F.col("steady")) / cfg.window_size) % 2 == 1)
    rows = rows.withColumn("opens", (F.col("window_start") == F.col("segment")) | drift)
    return carry_last(rows, "window_start", F.col("opens"), "episode").drop("low", "steady", "opens")

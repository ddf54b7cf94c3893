"""Min-max fusion of the two views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import top_turns


def min_max(scores: DataFrame) -> DataFrame:
    """Scores of each query scaled to 0..1; all equal become 1."""
    ends = scores.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scores.join(ends, "query_id").select("query_id", "idx", scaled.alias("score"))


def fuse(graph: DataFrame, hier: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, idx, score): weighted sum of both scaled views, a missing turn counts 0; ties to the earlier turn."""
    both = min_max(graph).withColumn("view", F.lit("g")).unionByName(min_max(hier).withColumn("view", F.lit("h"))).join(weights.select("query_id", "w_graph", "w_hier"), "query_id")
    part = F.when(F.col("view") == "g", F.col("w_graph")).otherwise(F.col("w_hier")) * F.col("score")
    return top_turns(both.groupBy("query_id", "idx").agg(F.sum(part).alias("score")), k)

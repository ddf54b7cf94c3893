"""BM25 over turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens

K1, B = 1.2, 0.75


def postings(turns: DataFrame) -> DataFrame:
    """(term, idx, tf)."""
    return turns.select("idx", F.explode(content_tokens(F.col("text"))).alias("term")).groupBy("term", "idx").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(turns: DataFrame) -> DataFrame:
    """(idx, dl) for every turn, also without a term."""
    return turns.select("idx", F.size(content_tokens(F.col("text"))).alias("dl"))


def query_terms(profiles: DataFrame) -> DataFrame:
    """(query_id, term, times): a keyword that a query repeats counts as often."""
    return profiles.select("query_id", F.explode("keywords").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(profiles: DataFrame, turns: DataFrame) -> DataFrame:
    """(query_id, idx, score) of turns with a keyword. One pass counts terms; only postings of query terms are joined."""
    terms = query_terms(profiles)
    lengths = doc_lengths(turns)
    n, total = lengths.agg(F.count(F.lit(1)), F.sum("dl")).first()
    if not n or not total:
        return terms.select("query_id", F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("score")).limit(0)
    tokens = turns.select("idx", content_tokens(F.col("text")).alias("t"))
    found = tokens.select("idx", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    tf = found.groupBy("term", "idx", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (total / n)))
    weighted = terms.join(df, "term").withColumn("idf", idf)
    return tf.join(weighted, "term").groupBy("query_id", "idx").agg(F.sum(part).alias("score"))


def top_turns(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, idx, score): best first, ties to the earlier turn."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "idx"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)

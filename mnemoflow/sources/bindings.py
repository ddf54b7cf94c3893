"""Turns from conversation and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dense_index

_bound: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, kind: str, path: str, make) -> DataFrame:
    """A store is bound once a session and path, like an ingested table."""
    key = (spark.sparkContext.applicationId, kind, path)
    if key not in _bound:
        _bound[key] = make()
    return _bound[key]


def with_session_turn(turns: DataFrame) -> DataFrame:
    """Turns of one session are numbered from 0; sessions lie in runs of ``idx``, so the number is the distance to the first."""
    first = turns.groupBy("session_id").agg(F.min("idx").alias("_first"))
    return turns.join(first, "session_id").withColumn("session_turn", F.col("idx") - F.col("_first")).drop("_first")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, id, session_id, session_turn, speaker, text, ts, source_uuid) in order of conversation and turn; ts is the position."""

    def make():
        rows = dense_index(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn")
        rows = rows.select(
            "idx", (F.col("idx") + 1).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("speaker"), "text", F.col("idx").alias("ts"), F.concat_ws("-", "conv_id", "turn").alias("source_uuid")
        )
        return with_session_turn(rows)

    return _once(spark, "conversations", sf_dir, make)


def event_turns(spark: SparkSession, sf_dir: str, *order: str) -> DataFrame:
    """Events as turns, in the given order (by default user, time, event)."""
    order = order or ("user_id", "ts", "event_id")

    def make():
        rows = dense_index(spark.read.parquet(f"{sf_dir}/events.parquet"), *order)
        return rows.select(
            "idx", (F.col("idx") + 1).alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("speaker"), F.concat_ws(" ", "event_type", "props").alias("text"),
            F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").cast("string").alias("source_uuid"),
        )

    return _once(spark, f"events {order}", sf_dir, make)


def session_positions(turns: DataFrame) -> DataFrame:
    """(session_id, pos, last): sessions in first-seen order from 0, and whether it is the last one."""
    first = turns.groupBy("session_id").agg(F.min("idx").alias("first_idx"))
    pos = dense_index(first, "first_idx", out="pos")
    top = pos.agg(F.max("pos")).first()[0]
    return pos.select("session_id", "pos", (F.col("pos") == top).alias("last"))

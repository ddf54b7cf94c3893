"""The append-only turn store: inserting, de-duplicating, scanning and forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..storage import dense_index


def valid(turns: DataFrame) -> DataFrame:
    return turns.filter(has_text(F.col("text")))


def new_turns(incoming: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Rows of ``incoming`` that may be appended: with text, the first of each non-null source_uuid, and none stored yet. Null uuids never collide."""
    incoming = valid(incoming)
    known = stored.filter("source_uuid is not null").select("source_uuid").distinct()
    dated = incoming.filter("source_uuid is not null")
    first = dated.groupBy("source_uuid").agg(F.min(order).alias("_first"))
    dated = dated.join(first, "source_uuid").filter(F.col(order) == F.col("_first")).drop("_first").dropDuplicates(["source_uuid"]).join(known, "source_uuid", "left_anti")
    return dated.unionByName(incoming.filter("source_uuid is null"))


def number_turns(new: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """``new`` with session_turn going on from the session's largest stored one.

    Positions come from one sorted order of all sessions, less where the session begins, so that no task gets a session whole.
    """
    last = stored.groupBy("session_id").agg(F.max("session_turn").alias("_last"))
    rows = dense_index(new, "session_id", order, out="_at")
    first = rows.groupBy("session_id").agg(F.min("_at").alias("_first")).join(last, "session_id", "left")
    number = F.col("_at") - F.col("_first") + F.coalesce("_last", F.lit(-1)) + 1
    return rows.join(first, "session_id").withColumn("session_turn", number.cast("long")).drop("_at", "_first", "_last")


def scan_after(turns: DataFrame, mark: int) -> DataFrame:
    """Turns with an id beyond the mark; the comparison reaches the Parquet scan."""
    return turns.filter(F.col("id") > mark)


def forget(turns: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Turns of sessions that no tombstone names."""
    return turns.join(tombstones.select("session_id").distinct(), "session_id", "left_anti")


def live_vectors(vectors: DataFrame, turns: DataFrame, entities: DataFrame, embedder: str) -> DataFrame:
    """Cached vectors (embedder, kind, key, vec) of this embedder whose turn or entity still exists."""
    own = vectors.filter(F.col("embedder") == embedder)
    keys = turns.select(F.lit("turn").alias("kind"), F.col("id").cast("string").alias("key")).unionByName(entities.select(F.lit("entity").alias("kind"), F.col("canon").alias("key")))
    return own.join(keys, ["kind", "key"], "left_semi")

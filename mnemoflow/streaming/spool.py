"""The spool: files of turns that a stream appends to the store, at least once delivered and once stored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..operators.ingest import new_turns
from ..schema import SPOOL
from ..storage import shared_dir

STORED = "session_id string, speaker string, text string, ts long, source_uuid string"


def write_event(turns: DataFrame, spool: str) -> None:
    """Drop turns (session_id, speaker, text, ts, uuid) as JSON lines; Spark's commit makes files appear whole."""
    turns.select("session_id", "speaker", "text", "ts", "uuid").write.mode("append").json(spool)


def drain(spark: SparkSession, spool: str, store: str, checkpoint: str, tombstones: DataFrame | None = None, **trigger):
    """Start a stream that appends the spool's new turns to the Parquet ``store``.

    A batch that is repeated after a failure finds its uuids stored and adds nothing; malformed lines and empty texts are
    skipped; turns of forgotten sessions are dropped. A uuid is stored once in the whole store, under whichever session it
    came first in the order of file names and lines, so a batch reads the column of uuids of all session buckets.
    """
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(64)).cast("int")

    def append(batch: DataFrame, _: int) -> None:
        rows = batch.filter("session_id is not null and text is not null").filter(has_text(F.col("text")))
        place = F.struct("file_name", "file_block_start", F.monotonically_increasing_id().alias("line")).alias("_n")
        rows = rows.select("session_id", F.coalesce("speaker", F.lit("user")).alias("speaker"), "text", F.coalesce("ts", F.lit(0)).alias("ts"), F.col("uuid").alias("source_uuid"), bucket.alias("bucket"), place)
        if tombstones is not None:
            rows = rows.join(tombstones.select("session_id").distinct(), "session_id", "left_anti")
        stored = spark.read.schema(STORED + ", bucket int").parquet(store).select("source_uuid").join(rows.select("source_uuid"), "source_uuid", "left_semi")
        new_turns(rows, stored, "_n").drop("_n").write.mode("append").partitionBy("bucket").parquet(store)

    spark.createDataFrame([], STORED + ", bucket int").write.mode("append").partitionBy("bucket").parquet(store)
    lines = spark.readStream.schema(SPOOL).option("mode", "DROPMALFORMED").json(spool)
    lines = lines.select("*", "_metadata.file_name", "_metadata.file_block_start")
    return lines.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain_all(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Spool all turns twice, drain them, and return the store."""
    root = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex[:12]}"
    rows = turns.withColumnRenamed("source_uuid", "uuid")
    for _ in range(2):
        write_event(rows, f"{root}/in")
    drain(spark, f"{root}/in", f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(STORED).parquet(f"{root}/store")

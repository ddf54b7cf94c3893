"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mnemoflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: the lineage ends there and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """``df`` with gapless positions from 0 in the given order.

    Rows are range-partitioned and sorted, written with their place in their partition, and the partitions' row counts
    (one number each) give the offsets: no task sees all rows, and a hot leading key is split by the rest of the order.
    """
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.withColumns({"_part": F.shiftright(place, 33).cast("int"), "_place": place.bitwiseAND((1 << 33) - 1)}), "indexed")
    counts = sorted((r["_part"], r["count"]) for r in rows.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return rows.withColumn(out, F.lit(0).cast("long")).drop("_part", "_place")
    at = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return rows.join(F.broadcast(at), "_part").withColumn(out, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def carry_last(df: DataFrame, order: str, flag, out: str, block: int = 1 << 16) -> DataFrame:
    """``df`` with the latest value of ``order`` (a whole number) at or before each row where ``flag`` is true.

    Runs over blocks of the order and one small row a block, so a run of any length takes no task of its own.
    """
    from pyspark.sql import Window

    b = F.floor(F.col(order) / block)
    rows = df.withColumns({"_b": b, "_at": F.when(flag, F.col(order))})
    here = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_b").agg(F.max("_at").alias("_last")).select("_b", F.max("_last").over(before).alias("_before"))
    rows = rows.withColumn("_own", F.max("_at").over(here))
    return rows.join(blocks, "_b").withColumn(out, F.coalesce("_own", "_before")).drop("_b", "_at", "_own", "_before")

"""Two-pass external shuffle into shards.

Pass 1 scatters the rows uniformly into buckets by a seeded hash of the id, as many buckets as make each fit a task's
memory; the scatter is one Spark shuffle whose map output is on disk. Pass 2 reads one bucket a task, applies a seeded
Fisher-Yates shuffle and writes its rows. Buckets follow one another in a global order that is cut into shards with
row counts at most one apart (the law ``rows``), so a bucket writes to a shard or two and there are few files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    order = np.arange(n)
    np.random.default_rng([seed, bucket]).shuffle(order)
    return order


def _shuffle_bucket(plan, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        offset, size, bounds = plan.value
        whole = pa.Table.from_batches(held)
        del held
        buckets = whole.column("_bucket").to_numpy()
        for k in np.unique(buckets):
            t = whole.filter(pa.array(buckets == k)) if (buckets != k).any() else whole
            if t.num_rows != size[k]:
                raise RuntimeError(f"bucket {k} has {t.num_rows} rows, {size[k]} were counted")
            order = t.select(["_rank", "_tie"]).to_pandas().sort_values(["_rank", "_tie"], kind="stable").index.to_numpy()
            order = order[fisher_yates(t.num_rows, seed, int(k))]
            at = offset[k] + np.arange(t.num_rows)
            shard = np.searchsorted(bounds, at, "right") - 1
            t = t.drop_columns(["_bucket", "_rank", "_tie"])
            for i in range(0, len(order), 2000):
                s = slice(i, i + 2000)
                rows = t.take(pa.array(order[s]))
                rows = rows.append_column("shard", pa.array(shard[s], pa.int32())).append_column("slot", pa.array(at[s] - bounds[shard[s]], pa.int64()))
                yield from rows.combine_chunks().to_batches()

    return run


def shuffled(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, bucket_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` in a seeded uniform random order, with columns shard (0 to shards - 1) and slot (gapless from 0).

    Shard sizes differ by one row at most, so shards may be empty where there are fewer rows than shards. Null ids and
    texts, repeated rows and ties are rows like any other. Should one id hold so many rows that its bucket outgrows
    the rest eightfold, that bucket's rows are scattered by their place in the input instead. Columns of the input
    named shard or slot are replaced, others may have any name; an empty table gives no rows. A bucket must fit a task's
    memory, so a text may be as long as that allows.
    """
    docs, names, (id_col, text_col) = common.numbered(docs.drop("shard", "slot"), id_col, text_col)
    place = F.lit(None).cast("long")
    n, volume = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    buckets = max(1, -(-((volume or 0) + 32 * n) // bucket_bytes))
    hashed = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(buckets)).cast("int")
    sizes = {r[0]: r[1] for r in docs.groupBy(hashed.alias("b")).count().collect()}
    large = [b for b, c in sizes.items() if c > 8 * max(1000, n / buckets)]
    if large:
        docs = common.materialize(docs.withColumn("_place", F.monotonically_increasing_id()), "sharding")
        place = F.when(hashed.isin(large), F.col("_place"))
        hashed = F.when(hashed.isin(large), F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "_place"), F.lit(buckets)).cast("int")).otherwise(hashed)
        sizes = {r[0]: r[1] for r in docs.groupBy(hashed.alias("b")).count().collect()}
    size = np.zeros(buckets, np.int64)
    for b, c in sizes.items():
        size[b] = c
    plan = docs.sparkSession.sparkContext.broadcast((np.concatenate([[0], np.cumsum(size)[:-1]]), size, np.array([s * n // shards for s in range(shards)], np.int64)))
    rows = docs.withColumns({"_bucket": hashed, "_rank": F.xxhash64(F.lit(seed), F.lit(2), F.col(id_col), place), "_tie": F.xxhash64(*docs.columns)})
    rows = rows.repartitionById(buckets, "_bucket") if hasattr(rows, "repartitionById") else rows.repartition(buckets, "_bucket")
    if large:
        rows = rows.drop("_place")
        docs = docs.drop("_place")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", shard int, slot long"
    return rows.mapInArrow(_shuffle_bucket(plan, seed), kind).toDF(*names, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write ``shuffled(docs)`` under ``path`` as Parquet, a folder ``shard=k`` each, rows in slot order within a file."""
    shuffled(docs, shards, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

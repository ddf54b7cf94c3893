"""Similarity of a stated set of queries to all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


NOISE = 1e-14  # of products that cancel, rounding leaves this much at most; what is less is a zero


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def similarities(vectors: DataFrame, queries: DataFrame, key: str = "idx", block: int = 2048) -> DataFrame:
    """(query_id, key, sim) of every query with every row of ``vectors`` (key, vec), inner products in double; zeros, and what rounding leaves of
    them, are left out.

    The queries are broadcast in blocks of ``block`` and multiplied with Arrow batches of vectors; rows are never shuffled.
    """
    rows = queries.select("query_id", "vec").orderBy("query_id").collect()
    kind = vectors.schema[key].dataType.simpleString()
    q_kind = queries.schema["query_id"].dataType.simpleString()
    id_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[q_kind]
    out = []
    for at in range(0, max(1, len(rows)), block):
        part = rows[at : at + block]
        ids, q = [r.query_id for r in part], np.array([r.vec for r in part], np.float64)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 4096):
                    piece = b.slice(start, 4096)
                    if not len(ids) or not piece.num_rows:
                        continue
                    s = _matrix(piece.column(1)) @ q.T
                    row, col = np.nonzero(np.abs(s) > NOISE)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[c] for c in col], id_type), piece.column(0).take(pa.array(row)), pa.array(s[row, col])], names=["query_id", key, "sim"])

        out.append(vectors.select(key, "vec").mapInArrow(run, f"query_id {q_kind}, {key} {kind}, sim double"))
    return reduce(DataFrame.unionByName, out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "idx") -> DataFrame:
    """(query_id, rank, key, sim): the k most similar rows, ties to the smaller key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), key))
    return similarities(vectors, queries, key).withColumn("rank", rank).filter(F.col("rank") <= k)

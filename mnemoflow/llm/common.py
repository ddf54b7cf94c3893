"""Helpers shared by the training-data operators: scratch tables, Arrow access, hot-key joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder; a cluster without the setting is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mnemoflow-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files behind tables made by ``materialize`` that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t._scratch)


def delete(spark: SparkSession, uri: str) -> None:
    """Delete a scratch folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_blocks(rows: DataFrame, root: str, text_col: str, block_bytes: int) -> DataFrame:
    """Write ``rows`` under ``root`` in files of about ``block_bytes`` of text; a larger text is a block of its own.

    Returns the manifest (block, path, rows, bytes), a written table. Names carry the attempt, and only files of
    attempts that ended are in the manifest, so lost or repeated tasks do no harm.
    """
    made = pa.schema([("block", pa.int64()), ("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        task, done, held, size = TaskContext.get(), [], [], 0

        def write():
            block = task.partitionId() << 24 | len(done)
            path = f"{base}/block-{block:012x}-{task.taskAttemptId()}.parquet"
            t = pa.Table.from_batches(held)
            with fs.open_output_stream(path) as f:
                pq.write_table(t, f, compression="zstd", use_dictionary=False, write_statistics=False)
            done.append((block, path, t.num_rows, size))

        for batch in batches:
            n = np.array([len(x) if x else 0 for x in utf8(batch.column(text_col))])
            at = 0
            while at < batch.num_rows:
                to = at + int(np.searchsorted(np.cumsum(n[at:]), block_bytes - size, "right"))
                if to > at or not held:
                    to = max(to, at + 1)
                    held.append(batch.slice(at, to - at))
                    size += int(n[at:to].sum())
                    at = to
                if at < batch.num_rows:
                    write()
                    held, size = [], 0
        if held:
            write()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), made)], schema=made)

    fs, base = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(base)
    return materialize(rows.mapInArrow(run, "block long, path string, rows long, bytes long"), "blocks")


def read_block(path: str, root: str) -> pa.Table:
    fs, _ = pa.fs.FileSystem.from_uri(root)
    with fs.open_input_file(path) as f:
        return pq.read_table(f)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with its columns called c0, c1, ..., which no working column clashes with; the old names in order; and what
    ``names`` are called now."""
    old = docs.columns
    low = [c.lower() for c in old]
    return docs.toDF(*(f"c{i}" for i in range(len(old)))), old, [f"c{low.index(n.lower())}" for n in names]


def rows_batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def word_blocks(raw: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The ASCII-whitespace separated words of a text, in lists from slices of about ``block`` bytes, so that a very long text needs little memory."""
    if len(raw) <= block:
        yield raw.split()
        return
    at, end = 0, len(raw)
    spaces = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8), np.array([32, 9, 10, 11, 12, 13], np.uint8)))
    while at < end:
        k = np.searchsorted(spaces, at + block)
        to = int(spaces[k]) if k < len(spaces) else end
        yield raw[at:to].split()
        at = to


def join_unique(big: DataFrame, small: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose ``key`` is unique, where a few keys hold much of ``big``.

    ``heavy`` has the keys that hold over 1/256 of the rows, thus at most 256 of them: their side is broadcast, so
    no task gets a hot key's rows; all other keys go through an ordinary shuffle join.
    """
    heavy = F.broadcast(heavy.select(key))
    hot = big.join(F.broadcast(small.join(heavy, key, "left_semi")), key)
    return hot.unionByName(big.join(heavy, key, "left_anti").join(small.hint("shuffle_hash"), key))


def to_table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

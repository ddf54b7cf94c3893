"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, shard results merged.

A shard's graph is built in its task and written as flat arrays: original vectors, the rows of each, and per level an
int32 array of ``m`` neighbours a node (-1: none). Equal vectors are one node with all their rows, so that copies, however
many, neither fill a node's links nor a beam. Inner product is made a metric by one more dimension that gives all vectors
the same length, so neighbours are found on a sphere whatever the vectors' norms.

Nodes are inserted in seeded order, in batches that double: each walks down from the top and searches every level it is
on with a beam over the nodes inserted before, the heuristic chooses among those found and its batch, and links back are
added, again chosen by the heuristic where a node has too many.

Queries are read in blocks of ``query_block``; a task takes one shard and one block and walks all its queries through the
graph in step, in numpy. A shard returns at most k rows a query; the merge keeps the best k in double precision.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _select(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, m: int, block: int = 512) -> np.ndarray:
    """The neighbour heuristic for the nodes ``own`` in step, of candidates in any order (-1: none): a candidate is taken if
    it is nearer to the node than to any neighbour taken before it; places left over go to the nearest that were passed over."""
    n, c = candidates.shape
    out = np.full((n, m), -1, np.int32)
    for at in range(0, n, block):
        cand = candidates[at : at + block]
        near = np.einsum("ncd,nd->nc", x[np.maximum(cand, 0)], x[own[at : at + block]])
        order = np.argsort(np.where(cand >= 0, -near, np.inf), axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        valid = cand >= 0
        v = x[np.maximum(cand, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(cand.shape, bool)
        closest = np.full(cand.shape, -np.inf, np.float32)  # similarity of each candidate to the nearest taken one
        for i in range(c):
            ok = valid[:, i] & (near[:, i] > closest[:, i]) & (taken.sum(1) < m)
            taken[:, i] = ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, i]), closest)
        order = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :m]
        out[at : at + block, : order.shape[1]] = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(cand, order, 1), -1)
    return out


def _mates(x: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """For each of the nodes ``own`` the nearest of the others."""
    k = min(most, len(own) - 1)
    if k < 1:
        return np.full((len(own), 0), -1, np.int64)
    s = x[own] @ x[own].T
    np.fill_diagonal(s, -np.inf)
    return own[np.argpartition(-s, k - 1, axis=1)[:, :k]]


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the links from ``chosen`` neighbours back to the ``new`` nodes."""
    b, a = np.repeat(new, chosen.shape[1]), chosen.ravel()
    b, a = b[a >= 0], a[a >= 0].astype(np.int64)
    keep = ~(links[a] == b[:, None]).any(1)  # nodes of one batch may have chosen each other
    b, a = b[keep], a[keep]
    if not len(a):
        return
    s = np.einsum("nd,nd->n", x[a], x[b])
    order = np.lexsort((-s, a))
    a, b = a[order], b[order]
    target, first, count = np.unique(a, return_index=True, return_counts=True)
    place = np.arange(len(a)) - np.repeat(first, count)
    width = links.shape[1]
    own = place < width
    more = np.full((len(target), min(int(count.max()), width)), -1, np.int64)
    more[np.repeat(np.arange(len(target)), count)[own], place[own]] = b[own]
    both = np.concatenate([links[target].astype(np.int64), more], axis=1)
    used = (both >= 0).sum(1)
    room = used <= width
    front = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
    links[target[room]] = np.take_along_axis(both, front, 1)[room]
    if not room.all():
        links[target[~room]] = _select(x, target[~room], both[~room], width)


def build(vectors: np.ndarray, m: int = 16, beam: int = 64, seed: int = 3, batch: int = 256) -> dict[str, np.ndarray]:
    """Flat arrays of a graph of distinct vectors: ``nodes{l}`` (members of level l), ``links{l}`` (neighbours, positions in
    the level; 2m a node on level 0), in metric space ``x``; ``beam`` nodes are kept while a node is inserted."""
    norm = np.einsum("nd,nd->n", vectors, vectors)
    lift = np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))
    x = np.concatenate([vectors, lift[:, None]], axis=1).astype(np.float32)
    rng = np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(m)), 12).astype(int)
    top = level.max(initial=0)
    order = rng.permutation(len(x))
    if len(x):  # a node of the top level comes first, and is where every walk begins
        k = int(np.argmax(level[order]))
        order[[0, k]] = order[[k, 0]]
    nodes = [np.flatnonzero(level >= l) for l in range(top + 1)]
    points = [x if l == 0 else x[own] for l, own in enumerate(nodes)]
    links = [np.full((len(own), m if l else 2 * m), -1, np.int32) for l, own in enumerate(nodes)]
    done = 1
    while done < len(x):
        part = order[done : done + min(batch, done)]
        entry = np.full((len(part), 1), order[0])
        for l in range(top, -1, -1):
            found = _walk(points[l], links[l], x[part], np.searchsorted(nodes[l], entry), beam if l == 0 else min(beam, len(nodes[l])))
            own = level[part] >= l
            here = np.searchsorted(nodes[l], part[own])
            chosen = _select(points[l], here, np.concatenate([found[own], _mates(points[l], here, m)], axis=1), m)
            links[l][here, :m] = chosen
            _link_back(points[l], links[l], here, chosen)
            best = found[:, :8]
            entry = nodes[l][np.where(best < 0, best[:, :1], best)]
        done += len(part)
    out = {"x": x, "entry": order[:1]}
    for l in range(top + 1):
        out[f"nodes{l}"], out[f"links{l}"] = nodes[l].astype(np.int32), links[l]
    return out


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, steps: int = 4) -> np.ndarray:
    """Beam search of all queries in step from start (queries x s), which opens ``steps`` nodes of each at once; returns
    positions (queries x ef), best first, -1 where fewer."""
    n = len(q)
    ef = max(ef, start.shape[1])
    stamp = np.zeros((n, len(x)), np.int32)  # which gathering first met a node
    rows = np.repeat(np.arange(n), start.shape[1])
    stamp[rows, start.ravel()] = np.tile(np.arange(1, start.shape[1] + 1), n)
    first = stamp[np.arange(n)[:, None], start] == np.arange(1, start.shape[1] + 1)
    ids = np.full((n, ef), -1, np.int64)
    score = np.full((n, ef), -np.inf, np.float32)
    open_ = np.zeros((n, ef), bool)
    s = start.shape[1]
    ids[:, :s], score[:, :s], open_[:, :s] = np.where(first, start, -1), np.where(first, np.einsum("qsd,qd->qs", x[start], q), -np.inf), first
    active = np.arange(n)
    code = s + 1
    width = links.shape[1]
    k = min(steps, ef)
    while len(active):
        rank = np.where(open_[active], score[active], -np.inf)
        best = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < ef else np.tile(np.arange(ef), (len(active), 1))
        go = np.take_along_axis(open_[active], best, 1)
        some = go.any(1)
        active, best, go = active[some], best[some], go[some]
        if not len(active):
            break
        open_[active[:, None], best] = False
        near = np.where(go[:, :, None], links[np.maximum(np.take_along_axis(ids[active], best, 1), 0)], -1).reshape(len(active), k * width)
        at, col = np.nonzero(near >= 0)
        node, row = near[at, col], active[at]
        fresh = stamp[row, node] == 0
        at, col, node, row = at[fresh], col[fresh], node[fresh], row[fresh]
        stamp[row, node] = code + col
        fresh = stamp[row, node] == code + col
        at, col, node, row = at[fresh], col[fresh], node[fresh], row[fresh]
        code += k * width
        sims = np.full(near.shape, -np.inf, np.float32)
        sims[at, col] = np.einsum("nd,nd->n", x[node], q[row])
        all_s = np.concatenate([score[active], sims], axis=1)
        all_i = np.concatenate([ids[active], np.where(np.isfinite(sims), near, -1)], axis=1)
        all_o = np.concatenate([open_[active], np.isfinite(sims)], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        score[active], ids[active], open_[active] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1)


def search(graph: dict[str, np.ndarray], queries: np.ndarray, ef: int) -> np.ndarray:
    """Positions of about the ef nearest vectors of each query, best first."""
    x = graph["x"]
    if not len(x):
        return np.empty((len(queries), 0), np.int64)
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    ef = min(ef, len(x))
    top = max(int(k[5:]) for k in graph if k.startswith("nodes"))
    block = max(1, min(256, (1 << 26) // len(x)))
    out = []
    for at in range(0, len(q), block):
        part = q[at : at + block]
        entry = np.zeros((len(part), 1), np.int64) + graph["entry"][0]
        for l in range(top, -1, -1):
            nodes = graph[f"nodes{l}"]
            found = _walk(x[nodes] if l else x, graph[f"links{l}"], part, np.searchsorted(nodes, entry), ef if l == 0 else min(32, len(nodes)))
            found = np.where(found < 0, found[:, :1], found)
            entry = nodes[found]
        out.append(entry)
    return np.concatenate(out) if out else np.empty((0, ef), np.int64)


def make_shard(ids: np.ndarray, vectors: np.ndarray, m: int, beam: int) -> dict[str, np.ndarray]:
    """A shard's arrays: the graph of the distinct vectors, and the ids of each (``start``, ``ids``: smallest first)."""
    kind = vectors.dtype
    distinct, node = np.unique(np.ascontiguousarray(vectors + kind.type(0)).view(np.dtype((np.void, kind.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    distinct = distinct.view(kind).reshape(len(distinct), -1)
    order = np.lexsort((ids, node))
    start = np.searchsorted(node[order], np.arange(len(distinct) + 1))
    return {"ids": ids[order], "start": start, "vectors": distinct, **build(distinct.astype(np.float64), m, beam)}


def top_k(shard: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int):
    """(query_id, vec_id, score) of the k nearest found, never a row with the query's own id; scores in double on the original vectors."""
    ids, start, vectors = shard["ids"], shard["start"], shard["vectors"]
    found = search(shard, queries, max(ef, k + 1))
    for i, (qid, q) in enumerate(zip(query_ids, queries.astype(np.float64))):
        at = np.unique(found[i])
        s = vectors[at].astype(np.float64) @ q
        n = start[at + 1] - start[at]
        rows = np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        s = np.repeat(s, n)[ids[rows] != qid]
        rows = rows[ids[rows] != qid]
        order = np.lexsort((ids[rows], -s))[:k]
        yield np.full(len(order), qid), ids[rows][order], s[order]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def _by_dimension(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows of each dimension."""
    t = t.combine_chunks()
    if not t.num_rows:
        return
    ids, column = t.column(0).to_numpy(), t.column(1).chunk(0)
    size = np.diff(column.offsets.to_numpy())
    for dim in np.unique(size):
        own = np.flatnonzero(size == dim)
        yield ids[own], _matrix(column.take(pa.array(own)))


def _build_shards(root: str, m: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fs, base = pa.fs.FileSystem.from_uri(root)
        task = TaskContext.get()
        for ids, v in _by_dimension(pa.Table.from_batches(held)):
            path = f"{base}/shard-{task.partitionId():06d}-{v.shape[1]}-{task.taskAttemptId()}.npz"
            order = np.argsort(ids, kind="stable")
            with fs.open_output_stream(path) as f:
                buffer = io.BytesIO()
                np.savez(buffer, **make_shard(ids[order], v[order], m, beam))
                f.write(buffer.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([v.shape[1]], pa.int32()), pa.array([len(ids)], pa.int64())], names=["path", "dim", "rows"])

    return run


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col("embedding")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v)) & F.exists(x, lambda v: v != 0)
    )


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 16384, m: int = 16, beam: int = 64) -> DataFrame:
    """Write a graph for each shard of about ``shard_rows`` rows to the shared folder; returns the manifest (path, dim, rows).

    Rows are dealt to shards in turn, so no id, label or group of copies can make a shard large. Vectors that are null,
    zero, or hold null or non-finite components, and null ids take no part. Vectors of another dimension get graphs of
    their own, as there is no inner product between them. Repeated rows are rows of their own; an empty table gives an
    empty index; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    root = common.scratch_path(spark, "hnsw")
    fs, base = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(base)
    shards = max(1, -(-rows.count() // shard_rows))
    made = common.materialize(rows.repartition(shards).mapInArrow(_build_shards(root, m, beam), "path string, dim int, rows long"), "hnsw-manifest")
    made._root = root
    return made


def _search_shard(root: str, queries: str, k: int, ef: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(root)
        qfs, qbase = pa.fs.FileSystem.from_uri(queries)
        for b in batches:
            for path, dim, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                folder = f"{qbase}/dim={dim}/block={block}"
                if qfs.get_file_info(folder).type == pa.fs.FileType.NotFound:
                    continue
                with fs.open_input_file(path) as f:
                    shard = dict(np.load(io.BytesIO(f.read())))
                t = pq.ParquetDataset(folder, filesystem=qfs, partitioning=None).read(columns=["vec_id", "embedding"])
                for ids, own in _by_dimension(t):
                    found = list(zip(*top_k(shard, ids, own, k, ef)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(found, _FOUND)], schema=_FOUND)

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = 128, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, a row with the query's own id left out; ties go
    to the smaller vec_id. Queries that take no part (see ``build_index``) have no rows; of repeated query ids one counts."""
    spark = queries.sparkSession
    rows = _usable(queries, id_col, vector_col).dropDuplicates(["vec_id"])
    path = common.scratch_path(spark, "hnsw-queries")
    blocks = max(1, -(-rows.count() // query_block))
    rows.withColumns({"dim": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")}).write.partitionBy("dim", "block").parquet(path)
    tasks = index.select("path", "dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    n = max(1, index.count() * blocks)
    tasks = tasks.repartitionByRange(min(n, 20_000), "path", "block")
    found = tasks.mapInArrow(_search_shard(index._root, path, k, ef), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)

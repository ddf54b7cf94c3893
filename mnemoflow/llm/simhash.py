"""SimHash near-duplicate groups by a binary trie self-join of the fingerprints.

1. Every text becomes a 64-bit fingerprint of its 2-word shingles (Python, Arrow batches, one pass over the text).
2. Equal fingerprints are counted first, with map-side combine, so copies cost one row from there on.
3. The trie join is spread over the cluster by its leading levels: the 64 bits are cut into ``distance + j`` blocks, of
   which at least ``j`` agree for two fingerprints within ``distance`` bits. Each choice of ``j`` blocks puts those bits
   first in the trie, and the nodes below one value of them form a bucket. In a bucket pairs of trie nodes are
   traversed together, differing bits add up, and a pair over the budget is pruned with all below it. ``j`` follows the
   number of fingerprints, so that buckets stay small at any size; no choice of ``j`` loses a pair.
4. A bucket beyond ``tile_rows`` is cut into tiles of two chunks, so a hot prefix is spread over tasks and stays exact.
5. A task returns link counts per fingerprint and a spanning forest, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components, forest

BITS = 64
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def fingerprint(raw: bytes | None, seed: int = 42) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the XXH64 hashes of its 2-word shingles (repeats
    included); a single word is its own shingle; no word (empty or null text) gives 0."""
    ones, total, last = np.zeros(BITS, np.int64), 0, None
    for words in common.word_blocks((raw or b"").lower()):
        if last is not None:
            words.insert(0, last)
        if len(words) > 1:
            h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(words, words[1:])), itertools.repeat(seed)), np.uint64, len(words) - 1)
            for at in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
        if words:
            last = words[-1]
    if total == 0:
        if last is None:
            return 0
        return xxhash.xxh64_intdigest(last, seed)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(x) for x in common.utf8(b.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])


def _id(docs: DataFrame, id_col: str) -> Column:
    """The id, whole numbers as long; ids of other types are compared as they are."""
    return F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.col(id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_batches, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def trie_pairs(v: np.ndarray, roots: np.ndarray, budget: int, leaf: int = 256, width: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` bits, by simultaneous descent of node pairs.

    ``v`` holds unsigned fingerprints. A trie node is a range of ``v`` in which each root's range is sorted, and
    ``roots`` has rows (lo, hi, lo2, hi2): node pairs to start from; equal ranges mean a node with itself. A level adds
    the differing bit of each child pair and drops those over the budget; pairs of at most ``leaf`` combinations are
    compared outright. Work is taken in slices of ``width`` node pairs, deepest first, which bounds the memory.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(0, roots.astype(np.int64).T, np.zeros(len(roots), np.int16))]
    while stack:
        depth, (alo, ahi, blo, bhi), err = stack.pop()
        if len(err) > width:
            for at in range(0, len(err), width):
                s = slice(at, at + width)
                stack.append((depth, np.stack([alo[s], ahi[s], blo[s], bhi[s]]), err[s]))
            continue
        done = ((ahi - alo) * (bhi - blo) <= leaf) | (depth == BITS)
        if done.any():
            yield from _compare(v, alo[done], ahi[done], blo[done], bhi[done], budget)
        go = ~done
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = alo[go], ahi[go], blo[go], bhi[go], err[go]
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((v >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        own = (alo == blo) & (ahi == bhi)
        kids, errs = [], []
        for a, b, cost in (((alo, am), (blo, bm), 0), ((am, ahi), (bm, bhi), 0), ((alo, am), (bm, bhi), 1), ((am, ahi), (blo, bm), 1)):
            keep = (a[1] > a[0]) & (b[1] > b[0]) & (err + cost <= budget)
            if a[0] is am and b[0] is blo:
                keep &= ~own
            kids.append(np.stack([a[0][keep], a[1][keep], b[0][keep], b[1][keep]]))
            errs.append(err[keep] + cost)
        stack.append((depth + 1, np.concatenate(kids, axis=1), np.concatenate(errs).astype(np.int16)))


def _compare(v, alo, ahi, blo, bhi, budget, most: int = 1 << 21):
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    start = 0
    while start < len(size):
        total = np.cumsum(size[start:])
        end = start + max(1, int(np.searchsorted(total, most, "right")))
        s = slice(start, end)
        n = size[s]
        offset = np.concatenate([[0], np.cumsum(n)[:-1]])
        k = np.arange(int(n.sum())) - np.repeat(offset, n)
        width = np.repeat(nb[s], n)
        i, j = np.repeat(alo[s], n) + k // width, np.repeat(blo[s], n) + k % width
        near = np.bitwise_count(v[i] ^ v[j]) <= budget
        own = np.repeat((alo[s] == blo[s]) & (ahi[s] == bhi[s]), n)
        near &= ~own | (i < j)
        yield i[near], j[near]
        start = end


def block_masks(blocks: int) -> list[int]:
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def plan_levels(distinct: int, distance: int) -> int:
    """How many agreeing blocks lead the trie: one while buckets average under some 8,000 fingerprints, else more."""
    for j in range(1, 5):
        if distinct / 2 ** (BITS * j / (distance + j)) <= 8000:
            return j
    return 5


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _join_task(distance: int, j: int, rows: int = 1 << 18):
    masks = np.array(block_masks(distance + j), np.uint64)
    combos = list(itertools.combinations(range(distance + j), j))

    def solve(t: pa.Table):
        combo, masked, tile, side = (t.column(k).to_numpy() for k in ("combo", "masked", "tile", "side"))
        v, cnt = t.column("fp").to_numpy().view(np.uint64), t.column("cnt").to_numpy()
        order = np.lexsort((v, side, tile, masked, combo))
        combo, masked, tile, side, v, cnt = (x[order] for x in (combo, masked, tile, side, v, cnt))
        new = np.flatnonzero(np.concatenate([[True], (combo[1:] != combo[:-1]) | (masked[1:] != masked[:-1]) | (tile[1:] != tile[:-1])]))
        end = np.append(new[1:], len(v))
        switch = np.append(0, np.cumsum(side))
        cut = end - (switch[end] - switch[new])
        two = tile[new] >> 16 != tile[new] & 0xFFFF
        roots = np.where(two[:, None], np.stack([new, cut, cut, end], 1), np.stack([new, end, new, end], 1))
        roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])]
        n, found = np.zeros(len(v), np.int64), []
        for c in np.unique(combo):
            lead, own = combos[c], combo[roots[:, 0]] == c
            other = [masks[b] for b in range(lead[-1]) if b not in lead]
            for a, b in trie_pairs(v, roots[own], distance):
                x = v[a] ^ v[b]
                first = np.ones(len(x), bool)  # of all choices of agreeing blocks, only the first reports the pair
                for m in other:
                    first &= (x & m) != 0
                a, b = a[first], b[first]
                if len(a):
                    np.add.at(n, a, cnt[b])
                    np.add.at(n, b, cnt[a])
                    found.append(np.stack([a, b]))
                    if sum(f.shape[1] for f in found) > 1 << 20:
                        found = [forest(np.concatenate(found, axis=1), len(v))]
        hit = np.flatnonzero(n)
        f = v.view(np.int64)
        yield common.to_table({"a": f[hit], "b": f[hit], "n": n[hit]}, _OUT)
        if found:
            a, b = forest(np.concatenate(found, axis=1), len(v))
            yield common.to_table({"a": f[a], "b": f[b], "n": np.zeros(len(a), np.int64)}, _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= rows:  # the last bucket may go on in the next batch
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [t.column(k).to_numpy() for k in ("combo", "masked", "tile")]
                same = np.logical_and.reduce([k == k[-1] for k in keys])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def link_table(groups: DataFrame, distance: int = 6, tile_rows: int = 1 << 15, levels: int | None = None) -> DataFrame:
    """Links of the distinct fingerprints in ``groups`` (fp, cnt): rows (a, a, n) add n linked documents to a; rows (a, b, 0) connect two fingerprints."""
    j = levels or plan_levels(groups.count(), distance)
    masks = block_masks(distance + j)
    combos = [sum(masks[b] for b in c) for c in itertools.combinations(range(distance + j), j)]
    keys = F.array(*[F.struct(F.lit(i).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("masked")) for i, m in enumerate(combos)])
    rows = groups.select("fp", "cnt", F.explode(keys).alias("k")).select("k.combo", "k.masked", "fp", "cnt")
    large = rows.groupBy("combo", "masked").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > tile_rows)
    large = large.select("combo", "masked", F.ceil(F.col("size") / tile_rows).cast("int").alias("chunks"))
    rows = rows.join(large, ["combo", "masked"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(
            (F.least(o, F.col("chunk")) * 65536 + F.greatest(o, F.col("chunk"))).cast("int").alias("tile"),
            F.when(o < F.col("chunk"), 1).otherwise(0).alias("side"),
        ),
    )
    rows = rows.select("combo", "masked", "fp", "cnt", F.explode(tiles).alias("t")).select("combo", "masked", "t.tile", "t.side", "fp", "cnt")
    rows = rows.repartition("combo", "masked", "tile").sortWithinPartitions("combo", "masked", "tile")
    return rows.mapInArrow(_join_task(distance, j), "a long, b long, n long")


def _grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 6, tile_rows: int = 1 << 15, levels: int | None = None, local_edges: int = 1_000_000) -> DataFrame:
    """(doc_id, fp, n_near, component_id, group_size, root) for every row; root is the least fingerprint of the component, which tells apart those that share a component_id."""
    fps = common.materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    groups = common.materialize(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("rep")), "simhash-groups")
    links = common.materialize(link_table(groups, distance, tile_rows, levels), "simhash-links")
    edges = links.filter("n = 0").select("a", "b")
    roots = connected_components(edges, local_edges=local_edges).select(F.col("node").alias("fp"), "root")
    degree = links.filter("n > 0").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("other"))
    nodes = groups.join(degree, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("cnt").alias("group_size"))
    nodes = common.materialize(
        nodes.join(least, "root").select("fp", (F.col("cnt") - 1 + F.coalesce("other", F.lit(0))).alias("n_near"), "component_id", "group_size", "root"), "simhash-nodes"
    )
    rows = fps.count()
    return common.join_unique(fps, nodes, "fp", groups.filter(F.col("cnt") * 256 > rows)).select("doc_id", "fp", "n_near", "component_id", "group_size", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), n_near (other rows linked directly), component_id
    (smallest doc_id reachable over links), group_size (rows of the component).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are documents of their own. A null
    doc_id takes part; it never names a component unless all its ids are null. Ids may be of any type that has an order. An empty table gives an empty result.
    Other columns are ignored.
    """
    out = _grouped(docs, id_col, text_col, **options)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id", "group_size")


def _with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs``, all columns as they are, and the fingerprint ``_fp`` of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x) for x in common.utf8(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*b.schema.names[:-1], "_fp"])

    rows = docs.select("*", F.col(text_col).cast("string").alias("_fp"))
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps the one with the smallest id; of rows
    that repeat that id in the group, one with the least fingerprint stays. A group with null ids only keeps one of its rows with a null id.

    Columns may have any names, ids any type that has an order; null and empty texts are near duplicates of each other.
    An empty table gives no rows. An id that the table has once names its row. Rows of other ids are told apart by their fingerprints, which are made again for them alone.
    """
    docs, names, (id_col, text_col) = common.numbered(docs, id_col, text_col)
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = common.materialize(_grouped(docs, id_col, text_col, **options).select("doc_id", "root", F.when(named, F.col("fp")).alias("fp"), named.alias("named")), "simhash-found")
    ids = common.materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("named").alias("named")).filter("named"), "simhash-kept")
    key = _id(docs, id_col)

    def having(which: DataFrame) -> DataFrame:
        return docs.join(which.select(F.col("doc_id").alias("_kept")).hint("merge"), key == F.col("_kept"), "left_semi")

    once = having(ids.filter("rows = 1 and doc_id is not null"))
    again = ids.filter("rows > 1 or doc_id is null")
    if again.isEmpty():
        return once.toDF(*names)
    least = found.filter("named").groupBy("root").agg(F.min("doc_id").alias("_kept"), F.min("fp").alias("_least"))
    rows = having(again)
    if not again.filter("doc_id is null").isEmpty():
        rows = rows.unionByName(docs.filter(key.isNull()))
    rows = _with_fingerprint(rows, text_col).withColumn("_id", key).dropDuplicates(["_id", "_fp"])
    rows = rows.join(least.hint("merge"), F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_fp") == F.col("_least")), "left_semi")
    return once.unionByName(rows.select(docs.columns)).toDF(*names)

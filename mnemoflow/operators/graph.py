"""Entities, their weighted edges to turns, and propagation over the graph."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.entities import with_entities
from ..functions.text import phrase_matches
from ..storage import written


def mentions(turns: DataFrame, key: str = "idx") -> DataFrame:
    """(key, pos, display, canon, kind)."""
    return with_entities(turns.select(key, "text")).select(key, F.posexplode("entities").alias("pos", "e")).select(key, "pos", "e.*")


def catalog(found: DataFrame) -> DataFrame:
    """(entity_id, canon, display, kind): display and kind as first seen; ids follow the order of first mention."""
    first = F.min(F.struct("idx", "pos", "display", "kind"))
    rows = found.groupBy("canon").agg(first.alias("f"))
    return rows.select((F.col("f.idx") * (1 << 20) + F.col("f.pos")).alias("entity_id"), "canon", "f.display", "f.kind")


def edges(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(idx, entity_id, cnt, w_turn, w_entity): counts as shares of the turn's and of the entity's mentions."""
    pairs = found.groupBy("idx", "canon").agg(F.count(F.lit(1)).alias("cnt")).join(entities.select("canon", "entity_id"), "canon").drop("canon")
    by_turn = pairs.groupBy("idx").agg(F.sum("cnt").alias("n_turn"))
    by_entity = pairs.groupBy("entity_id").agg(F.sum("cnt").alias("n_entity"))
    return pairs.join(by_turn, "idx").join(by_entity, "entity_id").select("idx", "entity_id", "cnt", (F.col("cnt") / F.col("n_turn")).alias("w_turn"), (F.col("cnt") / F.col("n_entity")).alias("w_entity"))


def adjacency(turns: DataFrame) -> DataFrame:
    """(idx, other): the turn before and after in the same session. A join on the position, so a long session is no hot key."""
    t = turns.select("idx", "session_id")
    nxt = t.select((F.col("idx") - 1).alias("idx"), F.col("session_id").alias("s2"))
    pairs = t.join(nxt, "idx").filter("session_id = s2").select("idx", (F.col("idx") + 1).alias("other"))
    return pairs.unionByName(pairs.select(F.col("other").alias("idx"), F.col("idx").alias("other")))


def transitions(turns: DataFrame, edge: DataFrame) -> DataFrame:
    """(src, dst, p) of a step; nodes are t<idx> and e<entity_id>. A turn with entities keeps 0.2 for its neighbours, which is
    lost if it has none; one with neither stays where it is."""
    near = adjacency(turns)
    counts = turns.select("idx").join(edge.groupBy("idx").agg(F.count(F.lit(1)).alias("n_e")), "idx", "left").join(near.groupBy("idx").agg(F.count(F.lit(1)).alias("n_a")), "idx", "left").fillna(0)
    t, e = F.concat(F.lit("t"), "idx"), F.concat(F.lit("e"), "entity_id")
    share = F.when(F.col("n_e") > 0, 0.2).otherwise(1.0) / F.col("n_a")
    return (
        edge.select(e.alias("src"), t.alias("dst"), F.col("w_entity").alias("p"))
        .unionByName(edge.select(t.alias("src"), e.alias("dst"), (F.col("w_turn") * 0.8).alias("p")))
        .unionByName(near.join(counts, "idx").select(t.alias("src"), F.concat(F.lit("t"), "other").alias("dst"), share.alias("p")))
        .unionByName(counts.filter("n_e = 0 and n_a = 0").select(t.alias("src"), t.alias("dst"), F.lit(1.0).alias("p")))
    )


def seeds(profiles: DataFrame, entities: DataFrame, query_vecs: DataFrame | None, entity_vecs: DataFrame | None, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, entity_id, a): entities named by a query; for a query with subjects but none of them known, the entity whose vector is nearest beyond the threshold."""
    names = profiles.select("query_id", F.explode(F.array_distinct(F.concat("subjects", "phrases"))).alias("canon"))
    exact = names.join(entities.select("canon", "entity_id"), "canon").select("query_id", "entity_id", F.lit(1.0).alias("a"))
    if entity_vecs is None:
        return exact
    from .dense import similarities

    open_ = profiles.filter(F.size("subjects") > 0).join(exact.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    sims = similarities(entity_vecs, query_vecs.join(open_, "query_id", "left_semi"), key="entity_id").filter(F.col("sim") > cfg.align_threshold)
    best = sims.groupBy("query_id").agg(F.max(F.struct(F.round("sim", 9).alias("s"), (-F.col("entity_id")).alias("n"))).alias("b"), F.max("sim").alias("a"))
    return exact.unionByName(best.select("query_id", (-F.col("b.n")).alias("entity_id"), "a"))


def propagate(start: DataFrame, edge: DataFrame, sims: DataFrame, steps: int) -> DataFrame:
    """Activation spread over turns by their similarity to the query: old values stay, a turn passes its entities' values to its other entities, and the largest becomes 1."""
    act = start
    pairs = edge.select("idx", "entity_id")
    for _ in range(steps):
        by_turn = act.join(pairs, "entity_id").join(sims.filter("sim > 0"), ["query_id", "idx"]).select("query_id", "idx", "entity_id", (F.col("a") * F.col("sim")).alias("a"))
        total = by_turn.groupBy("query_id", "idx").agg(F.sum("a").alias("all_a"))
        own = by_turn.select("query_id", "idx", "entity_id", F.col("a").alias("own_a"))
        # what an entity gets from a turn is the turn's sum without its own part, so no pair of entities is formed
        got = total.join(pairs, "idx").join(own, ["query_id", "idx", "entity_id"], "left")
        got = got.filter(F.col("own_a").isNull() | (F.abs(F.col("all_a") - F.col("own_a")) > 1e-15)).select("query_id", "entity_id", (F.col("all_a") - F.coalesce("own_a", F.lit(0.0))).alias("a"))
        new = act.unionByName(got).groupBy("query_id", "entity_id").agg(F.sum("a").alias("a"))
        top = new.groupBy("query_id").agg(F.max("a").alias("m"))
        act = new.join(top, "query_id").select("query_id", "entity_id", F.when(F.col("m") > 0, F.col("a") / F.col("m")).otherwise(F.col("a")).alias("a"))
    return act


def reset_vector(act: DataFrame, sims: DataFrame) -> DataFrame:
    """(query_id, node, r): half the mass on activations, half on turns by similarity; all of it on one side if the other is empty."""
    rows = act.filter("a > 0").select("query_id", F.concat(F.lit("e"), "entity_id").alias("node"), F.lit("e").alias("side"), F.col("a").alias("v")).unionByName(
        sims.filter("sim > 0").select("query_id", F.concat(F.lit("t"), "idx").alias("node"), F.lit("t").alias("side"), F.col("sim").alias("v"))
    )
    total = rows.groupBy("query_id").agg(F.sum(F.when(F.col("side") == "e", F.col("v"))).alias("te"), F.sum(F.when(F.col("side") == "t", F.col("v"))).alias("tt"))
    mass = F.when(F.col("te").isNotNull() & F.col("tt").isNotNull(), 0.5).otherwise(1.0)
    return rows.join(total, "query_id").select("query_id", "node", (mass * F.col("v") / F.when(F.col("side") == "e", F.col("te")).otherwise(F.col("tt"))).alias("r"))


def _links(turns: DataFrame, edge: DataFrame) -> DataFrame:
    """(src, dst, p) of :func:`transitions` with numbers for nodes: a turn is -(2 idx + 1), an entity its id. Entities that one
    turn alone mentions get and give all they have from and to that turn, so those of a turn are one node, -(2 idx + 2)."""
    turn = lambda c: -(F.col(c) * 2 + 1)
    kept = edge.select("idx", F.when(F.col("w_entity") == 1.0, -(F.col("idx") * 2 + 2)).otherwise(F.col("entity_id")).alias("e"), "w_turn", "w_entity")
    kept = kept.groupBy("idx", "e").agg(F.sum("w_turn").alias("w_turn"), F.max("w_entity").alias("w_entity"))
    near = adjacency(turns)
    counts = turns.select("idx").join(edge.groupBy("idx").agg(F.count(F.lit(1)).alias("n_e")), "idx", "left").join(near.groupBy("idx").agg(F.count(F.lit(1)).alias("n_a")), "idx", "left").fillna(0)
    share = F.when(F.col("n_e") > 0, 0.2).otherwise(1.0) / F.col("n_a")
    return (
        kept.select(F.col("e").alias("src"), turn("idx").alias("dst"), F.col("w_entity").alias("p"))
        .unionByName(kept.select(turn("idx").alias("src"), F.col("e").alias("dst"), (F.col("w_turn") * 0.8).alias("p")))
        .unionByName(near.join(counts, "idx").select(turn("idx").alias("src"), turn("other").alias("dst"), share.alias("p")))
        .unionByName(counts.filter("n_e = 0 and n_a = 0").select(turn("idx").alias("src"), turn("idx").alias("dst"), F.lit(1.0).alias("p")))
    )


def pagerank(reset: DataFrame, turns: DataFrame, edge: DataFrame, cfg: Config = DEFAULT, cut_every: int = 10, width: int = 64) -> DataFrame:
    """(query_id, node, mass) of the turns after a fixed number of steps.

    A node's masses for up to ``width`` queries are one row. Links and resets lie by node on the executors' disks, so a step
    shuffles only what moves, one row a node and map task; the lineage is cut in the shared folder every few steps.
    """
    reset = written(reset, "reset")
    spark = reset.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = written(_links(turns, edge), "links").repartition(n, "src").sortWithinPartitions("src").persist(StorageLevel.DISK_ONLY)
    number = F.expr("cast(substring(node, 2) as bigint)")
    only = edge.filter("w_entity = 1").select(F.concat(F.lit("e"), "entity_id").alias("node"), (-(F.col("idx") * 2 + 2)).alias("only"))
    start = reset.join(only, "node", "left").select("query_id", F.when(F.col("node").startswith("t"), -(number * 2 + 1)).otherwise(F.coalesce("only", number)).alias("node"), "r")
    ids = sorted(r.query_id for r in reset.select("query_id").distinct().collect())
    out = []
    for at in range(0, max(1, len(ids)), width):
        part = ids[at : at + width]
        sums = [F.sum(F.when(F.col("query_id") == q, F.col("r"))).alias(f"r{i}") for i, q in enumerate(part)] or [F.sum("r").alias("r0")]
        names = range(len(sums))
        base = links.select(F.col("src").alias("node")).distinct().join(start.groupBy("node").agg(*sums), "node", "left").fillna(0.0)
        base = base.repartition(n, "node").sortWithinPartitions("node").persist(StorageLevel.DISK_ONLY)
        pi = base.select("node", *[F.col(f"r{i}").alias(f"m{i}") for i in names])
        for k in range(cfg.pagerank_steps):
            moved = links.join(pi, F.col("src") == F.col("node")).groupBy("dst").agg(*[F.sum(F.col(f"m{i}") * F.col("p") * cfg.follow).alias(f"g{i}") for i in names])
            pi = base.join(moved, F.col("node") == F.col("dst"), "left").select("node", *[(F.col(f"r{i}") * (1 - cfg.follow) + F.coalesce(f"g{i}", F.lit(0.0))).alias(f"m{i}") for i in names])
            if k % cut_every == cut_every - 1 and k < cfg.pagerank_steps - 1:
                pi = written(pi, "pagerank")
        rows = pi.filter("node < 0 and node % 2 <> 0").select(F.concat(F.lit("t"), F.expr("cast((-node - 1) div 2 as string)")).alias("node"), *[f"m{i}" for i in names])
        cells = F.explode(F.array(*[F.struct(F.lit(q).alias("query_id"), F.col(f"m{i}").alias("mass")) for i, q in enumerate(part)])) if part else None
        if cells is not None:
            rows = rows.select("node", cells.alias("c")).select(F.col("c.query_id").cast(reset.schema["query_id"].dataType).alias("query_id"), "node", "c.mass").filter("mass > 0")
            out.append(written(rows, "pagerank"))
        base.unpersist()
    links.unpersist()
    return reduce(DataFrame.unionByName, out) if out else reset.select("query_id", "node", F.col("r").alias("mass"))


def graph_scores(ranks: DataFrame, turns: DataFrame, profiles: DataFrame) -> DataFrame:
    """(query_id, idx, score): a turn's mass, a quarter more for each phrase of the query that it holds."""
    mass = ranks.filter(F.col("node").startswith("t") & (F.col("mass") > 0)).select("query_id", F.substring("node", 2, 20).cast("long").alias("idx"), "mass")
    hits = phrase_matches(F.col("phrases"), F.col("text"))
    rows = mass.join(turns.select("idx", "text"), "idx").join(profiles.select("query_id", "phrases"), "query_id")
    return rows.select("query_id", "idx", (F.col("mass") * (1 + 0.25 * hits)).alias("score"))

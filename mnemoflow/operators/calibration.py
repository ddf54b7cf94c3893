"""Calibration of evidence and answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.entities import with_entities
from ..functions.text import strip


def admissible(selected: DataFrame, turns: DataFrame, profiles: DataFrame, positions: DataFrame) -> DataFrame:
    """Selected turns within the session that the query names, if it names one."""
    rows = selected.join(turns.select("idx", "session_id", "ts", "text"), "idx").join(positions, "session_id").join(profiles.select("query_id", "boundary", "answer_type", "prefer"), "query_id")
    return rows.filter(F.col("boundary").isNull() | F.when(F.col("boundary") == -1, F.col("last")).otherwise(F.col("pos") == F.col("boundary")))


def superseded(valued: DataFrame) -> DataFrame:
    """Rows (query_id, idx) of ``valued`` (query_id, idx, ts, vals) with a later one of the query whose values are all
    different. Only the distinct sets of values of a query meet, each with its latest time, however many rows have it."""
    rows = valued.select("query_id", "idx", "ts", F.array_sort(F.array_distinct("vals")).alias("own"))
    sets = rows.groupBy("query_id", "own").agg(F.max("ts").alias("last"))
    others = sets.select("query_id", F.col("own").alias("other"), F.col("last").alias("until"))
    until = sets.join(others, "query_id").filter(~F.arrays_overlap("own", "other")).groupBy("query_id", "own").agg(F.max("until").alias("until"))
    return rows.join(until, ["query_id", "own"]).filter("ts < until").select("query_id", "idx")


def calibrate(selected: DataFrame, turns: DataFrame, profiles: DataFrame, positions: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(query_id, rank, idx, score, role): surviving mains in order, each followed by at most two of its supports (bridge
    first, then by distance) while fewer than 2 * top_k rows are out."""
    rows = admissible(selected, turns, profiles, positions)
    dated = rows.filter((F.col("role") == "Main") & F.col("answer_type").isin("Time", "Number") & (F.col("prefer") == "Latest"))
    kind = F.when(F.col("answer_type") == "Time", "Date").otherwise("Number")
    vals = F.transform(F.filter("entities", lambda e: e["kind"] == kind), lambda e: e["canon"])
    valued = with_entities(dated.select("query_id", "idx", "ts", "text", "answer_type")).select("query_id", "idx", "ts", vals.alias("vals")).filter(F.size("vals") > 0)
    rows = rows.select("query_id", "idx", "score", "role", "anchor", "emit")
    gone = superseded(valued).withColumn("role", F.lit("Main"))
    rows = rows.join(gone, ["query_id", "idx", "role"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "idx"))
    mains = rows.filter("role = 'Main'").withColumn("m_rank", rank).filter(F.col("m_rank") <= cfg.top_k)
    supports = rows.filter("role <> 'Main'").join(mains.select("query_id", F.col("idx").alias("anchor"), "m_rank"), ["query_id", "anchor"]).join(mains.select("query_id", "idx"), ["query_id", "idx"], "left_anti")
    near = Window.partitionBy("query_id", "anchor").orderBy(F.when(F.col("role") == "GraphBridge", 1).otherwise(2), F.abs(F.col("idx") - F.col("anchor")), "emit")
    supports = supports.withColumn("s_rank", F.row_number().over(near)).filter("s_rank <= 2")
    parts = mains.withColumn("s_rank", F.lit(0)).select("query_id", "idx", "score", "role", "m_rank", "s_rank").unionByName(supports.select("query_id", "idx", "score", "role", "m_rank", "s_rank"))
    budget = 2 * cfg.top_k

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        out, seen = [], set()
        for r in p.sort_values(["m_rank", "s_rank"]).itertuples():
            if r.s_rank == 0 or (len(out) < budget and r.idx not in seen):
                seen.add(r.idx)
                out.append((r.query_id, len(out) + 1, r.idx, r.score, r.role))
        return pd.DataFrame(out, columns=["query_id", "rank", "idx", "score", "role"])

    return parts.groupBy("query_id").applyInPandas(fold, f"query_id {selected.schema['query_id'].dataType.simpleString()}, rank int, idx long, score double, role string")


def candidates(answer_type: Column, entities: Column, subjects: Column) -> Column:
    """Sorted distinct canonical names of the kinds that suit the answer type, without the query's subjects."""
    kinds = (
        F.when(answer_type == "Time", F.array(F.lit("Date"))).when(answer_type == "Number", F.array(F.lit("Number"))).when(answer_type.isin("Person", "Place", "Entity"), F.array(F.lit("Named")))
        .when(answer_type == "List", F.array(F.lit("Named"), F.lit("Number"), F.lit("Date"))).otherwise(F.array().cast("array<string>"))
    )
    names = F.transform(F.filter(entities, lambda e: F.array_contains(kinds, e["kind"])), lambda e: e["canon"])
    return F.array_sort(F.array_except(F.array_distinct(names), subjects))


def calibrate_answers(rows: DataFrame) -> DataFrame:
    """``rows`` (query_id, answer_type, subjects, answer, evidence array<string>) with calibrated, changed, supported, candidates.

    An unsupported scalar answer is replaced if the evidence has exactly one candidate of its type; of a list the items
    that the evidence lacks go, unless it has all or none of them.
    """
    texts = rows.select("query_id", F.posexplode("evidence").alias("n", "text"))
    found = with_entities(texts).groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "entities"))), lambda s: s["entities"])).alias("entities"))
    rows = rows.join(found, "query_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<struct<display:string,canon:string,kind:string>>")))
    rows = rows.withColumn("candidates", candidates(F.col("answer_type"), F.col("entities"), F.col("subjects"))).withColumn("lower", F.transform("evidence", F.lower))
    bare = F.regexp_replace(strip(F.lower("answer")), r"\.+$", "")
    held = lambda s: F.exists("lower", lambda t: F.contains(t, s))
    supported = F.exists("candidates", lambda c: F.contains(F.lower("answer"), c)) | ((bare != "") & held(bare))
    items = F.filter(F.transform(F.split("answer", r"[,;\n]"), lambda s: strip(F.regexp_replace(strip(s), r"^(?:and )+", ""))), lambda s: s != "")
    rows = rows.withColumns({"supported0": supported, "items": items}).withColumn("kept", F.filter("items", lambda i: held(F.lower(i))))
    prune = (F.col("answer_type") == "List") & (F.size("kept") > 0) & (F.size("kept") < F.size("items"))
    swap = ~F.col("supported0") & (F.size("candidates") == 1) & F.col("answer_type").isin("Time", "Number", "Person", "Place", "Entity")
    changed = prune | swap
    return rows.select("query_id", F.when(prune, F.array_join("kept", ", ")).when(swap, F.get("candidates", F.lit(0))).otherwise(F.col("answer")).alias("calibrated"), changed.alias("changed"), (changed | F.col("supported0")).alias("supported"), "candidates")

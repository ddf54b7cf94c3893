"""Query profiles and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.dates import date_range
from ..functions.entities import with_entities
from ..functions.text import content_tokens

AGGREGATION = r"\b(each time|both|which all|list all|all the|every time|how often|how many times)\b"
BOUNDARY = r"\b(previous|latest|last|fifth|fourth|third|second|first)\s+(chat|session|conversation)\b"
MARKERS = ["yesterday", "last week", "last month", "last year", "recently", "earlier"]
VERBS = "would will can have has do does did were was are is".split()


def _any(lower: Column, *parts: str) -> Column:
    out = F.contains(lower, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(lower, F.lit(p))
    return out


def answer_type(lower: Column) -> Column:
    verb = lower.startswith(VERBS[0] + " ")
    for v in VERBS[1:]:
        verb = verb | lower.startswith(v + " ")
    return (
        F.when(lower.startswith("who"), "Person")
        .when(lower.startswith("when") | _any(lower, "how long ago", "what time", "what date", "what year"), "Time")
        .when(lower.startswith("where"), "Place")
        .when(_any(lower, "how old", "how much", "how many"), "Number")
        .when(_any(lower, "name all", "which are", "what are", "list "), "List")
        .when(verb, "Boolean")
        .when(lower.startswith("what") | lower.startswith("which") | lower.startswith("whose"), "Entity")
        .otherwise("Open")
    )


def boundary(lower: Column) -> Column:
    """0 to 4 for the first to fifth session, -1 for the last one, null without a session."""
    word = F.regexp_extract(lower, BOUNDARY, 1)
    at = F.array_position(F.array(*[F.lit(w) for w in ("first", "second", "third", "fourth", "fifth")]), word)
    return F.when(word != "", F.when(at > 0, at - 1).otherwise(-1)).cast("int")


def profiles(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, text) with subjects, phrases, keywords, answer_type, mentions, ranges, prefer, boundary, aggregation, route, w_graph, w_hier."""
    q = with_entities(queries, "text", "e").withColumn("lower", F.lower("text"))
    of = lambda *kinds: F.transform(F.filter("e", lambda x: x["kind"].isin(*kinds)), lambda x: x["canon"])
    q = q.withColumns({"subjects": of("Named"), "phrases": of("Named", "Date", "Number", "Quote"), "dates": of("Date"), "keywords": content_tokens(F.col("text"))})
    markers = F.filter(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(F.col("lower"), m))
    q = q.withColumns({"markers": markers, "ranges": F.filter(F.transform("dates", date_range), lambda r: r.isNotNull()), "answer_type": answer_type(F.col("lower")), "boundary": boundary(F.col("lower")), "aggregation": F.col("lower").rlike(AGGREGATION)})
    prefer = F.when(_any(F.col("lower"), "last time", "latest", "most recent"), "Latest").when(_any(F.col("lower"), "initially", "originally", "first time"), "Earliest").when(F.size("markers") > 0, "Latest")
    q = q.withColumns({"mentions": F.concat("dates", "markers"), "prefer": prefer})
    temporal = (F.size("ranges") > 0) | (F.size("mentions") > 0) | (F.col("answer_type") == "Time")
    route = F.when((F.col("boundary").isNotNull() | temporal) & ~F.col("aggregation"), "Local").when(F.size("subjects") > 0, "Relational").otherwise("Local")
    return q.withColumn("route", route).drop("e", "lower", "dates", "markers")


def with_weights(p: DataFrame, primary: float = DEFAULT.primary) -> DataFrame:
    graph = F.when(F.col("route") == "Relational", primary).otherwise(1 - primary)
    return p.withColumns({"w_graph": graph, "w_hier": 1 - graph})

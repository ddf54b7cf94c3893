"""Agent transcripts (JSON lines) as clean turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_timestamp
from ..functions.text import strip

MOST_CHARS = 8000
NOISE = ("Caveat:", "<system-reminder>", "<local-command-caveat>", "<local-command-stdout>", "<command-name>")


def _text(line: Column) -> Column:
    """The prose of a message whose content is a string or an array of typed blocks, or null."""
    content = F.get_json_object(line, "$.message.content")
    plain = F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), "$.message.content", "variant")) == "STRING"
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    parts = F.when(plain, F.array(content)).otherwise(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]))
    kept = F.filter(F.transform(parts, strip), lambda t: (t != "") & ~_starts(t))
    joined = F.when(F.size(kept) > 0, F.array_join(kept, "\n\n"))
    return F.when(F.char_length(joined) > MOST_CHARS, F.concat(F.substring(joined, 1, MOST_CHARS), F.lit("\n[truncated]"))).otherwise(joined)


def _starts(t: Column) -> Column:
    out = t.startswith(NOISE[0])
    for n in NOISE[1:]:
        out = out | t.startswith(n)
    return out


def parse_transcript(lines: DataFrame, line: str = "value") -> DataFrame:
    """(speaker, text, ts, uuid) of the user's and assistant's prose; malformed, meta and side-chain lines are dropped."""
    v = F.col(line)
    get = lambda k: F.get_json_object(v, f"$.{k}")
    rows = lines.select(
        get("type").alias("speaker"), _text(v).alias("text"), F.coalesce(iso_timestamp(get("timestamp")), F.lit(0)).alias("ts"), get("uuid").alias("uuid"),
        F.coalesce(get("isSidechain"), F.lit("")).alias("side"), F.coalesce(get("isMeta"), F.lit("")).alias("meta"),
    )
    return rows.filter(F.col("speaker").isin("user", "assistant") & F.col("uuid").isNotNull() & F.col("text").isNotNull() & (F.col("side") != "true") & (F.col("meta") != "true")).drop("side", "meta")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return parse_transcript(spark.read.text(path))

"""JSON lines of turns, as the command line ingests them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput
from ..functions.text import has_text
from ..schema import LINE
from ..storage import dense_index


def read_turn_lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, speaker, text, ts) in line order with column ``line``; the speaker defaults to user and ts to the number of lines before. A malformed line or a missing field stops the read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_m"))
    numbered = dense_index(lines.filter(has_text(F.col("value"))), "_f", "_s", "_m", out="line")
    rows = numbered.select("line", F.from_json("value", LINE, {"mode": "FAILFAST"}).alias("v")).select("line", "v.*")
    if not rows.filter("session_id is null or text is null").isEmpty():
        raise InvalidInput("a line lacks session_id or text")
    return rows.withColumns({"speaker": F.coalesce("speaker", F.lit("user")), "ts": F.coalesce("ts", "line")})

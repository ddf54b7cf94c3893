"""The engine over a folder: ingest, recall, forget, calibrate, stats."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, Config
from .errors import InvalidInput
from .operators import calibration, ingest
from .operators.profile import profiles
from .plans.recall import Index, Recall
from .schema import SPOOL
from .sources.bindings import with_session_turn
from .storage import dense_index

STORED = "id long, session_id string, speaker string, text string, ts long, source_uuid string, bucket int"
TOMBSTONE = "session_id string, at long"


def _bucket():
    return F.pmod(F.xxhash64("session_id"), F.lit(64)).cast("int")


class MemoryEngine:
    """Append-only turns and tombstones under ``path``; everything else is derived and rebuilt after a change.

    There is one writer. Ids go on from the largest id ever stored, also if its session was forgotten, so none is reused.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = DEFAULT, embedder=None):
        self.spark, self.path, self.config, self.embedder = spark, path.rstrip("/"), config, embedder
        for name, kind in (("turns", STORED), ("forgotten", TOMBSTONE)):
            spark.createDataFrame([], kind).write.mode("append").parquet(f"{self.path}/{name}")

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.path}/turns")

    @property
    def turns(self) -> DataFrame:
        """(idx, id, session_id, session_turn, ...) of the sessions that were not forgotten after their turns came."""
        gone = self.spark.read.schema(TOMBSTONE).parquet(f"{self.path}/forgotten").groupBy("session_id").agg(F.max("at").alias("at"))
        live = self.stored.drop("bucket").join(gone, "session_id", "left").filter("at is null or id > at").drop("at")
        return with_session_turn(dense_index(live, "id"))

    def _changed(self) -> None:
        self.__dict__.pop("index", None)

    @cached_property
    def index(self) -> Index:
        return Index(self.turns, self.config, self.embedder)

    def ingest(self, rows: DataFrame, order: str) -> int:
        """Append rows (session_id, speaker, text, ts[, source_uuid]) in the given order; returns how many were new."""
        if "source_uuid" not in rows.columns:
            rows = rows.withColumn("source_uuid", F.lit(None).cast("string"))
        last = self.stored.agg(F.max("id")).first()[0] or 0
        new = dense_index(ingest.new_turns(rows, self.stored, order), order, out="_n")
        n = new.count()
        if not n:
            return 0
        new.select((F.col("_n") + last + 1).alias("id"), "session_id", "speaker", "text", "ts", "source_uuid", _bucket().alias("bucket")).write.mode("append").parquet(f"{self.path}/turns")
        self._changed()
        return n

    def ingest_turn(self, session_id: str, speaker: str, text: str, ts: int, source_uuid: str | None = None) -> int:
        if not text.strip():
            raise InvalidInput("a turn needs text")
        row = self.spark.createDataFrame([(0, session_id, speaker, text, ts, source_uuid)], "_o long, session_id string, speaker string, text string, ts long, source_uuid string")
        return self.ingest(row, "_o")

    def drain(self, spool: str) -> int:
        """Ingest the spool's files in the order of their names; what is stored already adds nothing. Returns how many turns were new."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(spool)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return 0
        rows = self.spark.read.schema(SPOOL).option("mode", "DROPMALFORMED").json(spool)
        place = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id())
        rows = rows.select("session_id", F.coalesce("speaker", F.lit("user")).alias("speaker"), "text", F.coalesce("ts", F.lit(0)).alias("ts"), F.col("uuid").alias("source_uuid"), place.alias("_o"))
        return self.ingest(rows.filter("session_id is not null and text is not null"), "_o")

    def delete_session(self, session_id: str) -> int:
        """Forget a session's turns so far; returns how many there were."""
        n = self.turns.filter(F.col("session_id") == session_id).count()
        last = self.stored.agg(F.max("id")).first()[0] or 0
        self.spark.createDataFrame([(session_id, last)], TOMBSTONE).write.mode("append").parquet(f"{self.path}/forgotten")
        self._changed()
        return n

    def refresh(self) -> None:
        """See what other writers appended."""
        self._changed()

    def recall(self, queries: DataFrame, exclude_session: str | None = None) -> DataFrame:
        """Evidence for a batch (query_id, text)."""
        return Recall(self.index, queries).evidence(exclude_session)

    def query(self, text: str, top_k: int | None = None, exclude_session: str | None = None) -> dict:
        index = self.index
        if top_k is not None and top_k != self.config.top_k:
            index = Index(index.turns, Config(**{**self.config.__dict__, "top_k": top_k}), self.embedder)
        one = self.spark.createDataFrame([(0, text)], "query_id int, text string")
        r = Recall(index, one)
        rows = [] if index.turns.isEmpty() else r.evidence(exclude_session).orderBy("rank").collect()
        keys = ("turn_id", "session_id", "session_turn", "speaker", "text", "ts", "score", "role")
        return {"route": r.profiles.first().route, "evidence": [{k: row[k] for k in keys} for row in rows]}

    def calibrate_answer(self, query: str, answer: str, evidence: list[str]) -> dict:
        rows = self.spark.createDataFrame([(0, query, answer, evidence)], "query_id int, text string, answer string, evidence array<string>")
        p = profiles(rows.select("query_id", "text")).select("query_id", "answer_type", "subjects")
        r = calibration.calibrate_answers(rows.drop("text").join(p, "query_id")).first()
        return {"answer": r.calibrated, "changed": r.changed, "supported": r.supported, "candidates": r.candidates}

    def stats(self) -> dict:
        return self.index.stats().first().asDict()

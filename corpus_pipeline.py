"""A cleaning pipeline over ``documents``: toxic documents go, near duplicates go, repeated passages are cut, benchmark
leaks go, and what is left is packed into training sequences. Each stage works on all its predecessor kept.

Every stage takes null and empty texts (empty ones are neither toxic by themselves nor hold a passage; as near duplicates
they are one group), null ids, repeated rows and further columns of any name, and gives no rows for an empty table. A text
must fit a task's memory some ten times over. ``doc_id`` must be a whole number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm import common, decontaminate, packing, simhash, substring_dedup, toxicity
from mnemoflow.llm.queries import remainder, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents whose toxicity scores 0.5 or more go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates the smallest doc_id stays."""
    return simhash.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: bytes of 50-byte strings that an earlier document holds are cut; a document of which nothing is left
    goes, a null text stays null. ``n_chars`` follows the text where it was cut."""
    own, names, (key, text) = common.numbered(docs, "doc_id", "text")
    own = own.withColumn("was_null", F.col(text).isNull())
    left = substring_dedup.remove_repeats(own, key, text, mode="text").filter("n_removed = 0 or n_removed < n_bytes")
    left = left.withColumn(text, F.when(~F.col("was_null"), F.col(text)))
    if "n_chars" in names:
        chars = f"c{names.index('n_chars')}"
        left = left.withColumn(chars, F.when(F.col("n_removed") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(chars)))
    return left.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("suffix_array", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs

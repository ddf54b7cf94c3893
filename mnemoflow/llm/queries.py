"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontaminate, hnsw, language_model, packing, quality, sharding, simhash, substring_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "shards")
    sharding.write_shards(table(spark, sf_dir, "documents"), path, 24)
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return spark.read.parquet(path).select(
        "doc_id",
        (F.octet_length(bytes_) + 8).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.scratch_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), root)
    return warc.read_archives(manifest, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS least FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, 5 * CAST(i AS INTEGER) + 1, 5) AS INTEGER) >> CAST(s AS INTEGER)) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM g
"""


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op9_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS l, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l),
hits AS (SELECT doc_id, i, dw.l, item FROM dw JOIN bw ON bw.l = dw.l AND bw.g = array_to_string(dw.w[i : i + dw.l - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY 1),
k AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(hnsw.build_index(vectors), vectors.filter("vec_id % 20 = 0"), 20)


def remainder(n: int):
    """crc32 of the doc_id as text, modulo n; a null doc_id gives that of the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = common.materialize(quality.statistics_table(table(spark, sf_dir, "documents")), "quality-stats")
    model = quality.train(stats, table(spark, sf_dir, "labels").filter(remainder(4) != 2))
    return quality.score(stats, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("ids")


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), remainder(10) != 0)
    return scored.select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL["op8_suffix_array"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS g FROM (SELECT doc_id, x, unnest(range(CAST(length(x) // 2 - 49 AS BIGINT))) AS p FROM d)),
m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS f FROM s),
h AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m WHERE f < doc_id),
r AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM h),
a AS (SELECT doc_id, min(p) AS b, max(p) + 50 AS e FROM r GROUP BY doc_id, run),
o AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS last FROM a),
k AS (SELECT o.doc_id, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(substr(x, 2 * last + 1, 2 * (b - last)), '' ORDER BY b) AS kept FROM o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

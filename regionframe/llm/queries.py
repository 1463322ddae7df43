"""The queries and their SQL that __spark_entry__.py registers for this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm.unigram import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm.ngram_join import similarity_components

    return similarity_components(_table(spark, sf_dir, "documents"), num=90, den=100, width=3)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
  FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id AND 100 * y.n >= 90 * x.n AND 100 * x.n >= 90 * y.n
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON s.doc_id = m.a
"""

#: Pseudonyms depend on it; a deployment passes its own secret to pii.pseudonymise.
PII_KEY = "documents-v1"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm import pii

    out = pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, found_col="found")
    counts = [F.expr(f"CAST(size(filter(found, m -> m.w IS NOT NULL AND m.k = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", *[F.coalesce(c, F.lit(0)).alias(f"n_{k}") for k, c in zip(pii.KINDS, counts, strict=True)])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm import toxicity
    from regionframe.llm.langid import fold

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    learn = docs.filter(fold(F.col("doc_id"), 3) != 1).join(labels.select("doc_id", "toxic"), "doc_id")
    scored = toxicity.score(docs, toxicity.fit(learn))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm import shards

    path, _ = shards.materialise(_table(spark, sf_dir, "documents"), key="training-order-v1", stable=True)
    out = shards.records(spark, path)
    return out.select("slot", "doc_id", "seq", "n_tokens", F.xxhash64("ids").alias("ids_hash"), F.expr(f"slot DIV {shards.PER_SHARD}").alias("shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm.mtree import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm import langid

    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold(F.col("doc_id"), 5) != 0))
    out = langid.predict(docs, model)
    return out.select("doc_id", F.coalesce(langid.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm import quality
    from regionframe.llm.store import written

    stats = written(quality.statistics(_table(spark, sf_dir, "documents")), "stats")
    rules = quality.fit(stats, _table(spark, sf_dir, "labels"))
    return quality.judged(stats, rules).select("doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op10_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regionframe.llm.unigram import n_best

    out = n_best(_table(spark, sf_dir, "documents"), n=4)
    return out.select("doc_id", "rank", "score", "n_tokens", F.xxhash64("ids").alias("ids_hash"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_ngram_join": op4_ngram_join,
    "op5_shards": op5_shards,
    "op6_packing": op6_packing,
    "op7_top_k": op7_top_k,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_n_best": op10_n_best,
}
ORACLES = {"op4_ngram_join": OP4_SQL, "op7_top_k": OP7_SQL}

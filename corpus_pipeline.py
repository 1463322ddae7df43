"""The corpus pipeline: five stages over documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionframe.llm import langid, ngram_join, packing, pii, toxicity
from regionframe.llm.queries import PII_KEY
from regionframe.llm.store import modest_batches, small_or_shuffled, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document's main language has at least this share of its letters' evidence.
LEAST_SHARE = 0.5
#: Documents at or above this score are toxic.
TOXIC = 0.7
#: Bytes of text that Spark hands to a Python worker at once.  All stages run in the same executors,
#: whose threads and buffers keep the room of the largest batch they met.
BATCH_BYTES = 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those in which no language has LEAST_SHARE."""
    modest_batches(spark, BATCH_BYTES)
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.filter(langid.fold(F.col("doc_id"), 5) != 0))
    found = langid.predict(docs, model, carry=COLUMNS[1:])
    return found.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored TOXIC or above; learns from the labelled ones outside the held-out fold."""
    modest_batches(spark, BATCH_BYTES)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(langid.fold(F.col("doc_id"), 3) != 1).join(labels, "doc_id"))
    return toxicity.score(docs, model, carry=COLUMNS[1:]).filter(F.col("score") < TOXIC).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest id stays.

    Rows that repeat an id are one document, of which each text stays once; rows without an id cannot be linked and stay.
    """
    modest_batches(spark, BATCH_BYTES)
    docs = docs.select(*COLUMNS)
    total = docs.count()
    groups = written(ngram_join.similarity_components(docs, num=80, den=100, width=5), "groups", total)
    first = groups.filter(F.col("doc_id") == F.col("component_id"))
    ids = written(first.select("doc_id").distinct(), "first", total)
    n = ids.count()
    kept = docs.join(small_or_shuffled(ids, n, 16), "doc_id", "left_semi").select(*COLUMNS)
    if first.count() > n:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, n_tokens, bin, capacity, offset."""
    modest_batches(spark, BATCH_BYTES)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: Learned models and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

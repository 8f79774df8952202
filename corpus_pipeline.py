"""A corpus pipeline of five operators: each stage works on all that the one before kept.

Quality classifier (documents that it rejects go), n-gram Jaccard join (five words, 0.8;
the document of the smallest id of each group stays), benchmark decontamination (documents
that hold an item go), mixing to target weights (each document as often as the mix
takes it), token ids. Rows with equal ids are told apart by their texts where
documents are dropped.

In every stage a null, empty or very long text is a document like another: it has log weight 0 or is weighed whole, links
with nothing or by all its words, holds no item, has size 0 or its words, and becomes the end id alone or all its ids. Ties and
repeated rows are as each operator's module says; columns beyond those of ``documents`` pass through, whatever
their names; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import decontaminate, mixing, ngram_join, quality, token_file
from meridian.llm.common import cut, read, remove, shared_dir, ship, unused

SHINGLE, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier's sample holds."""
    ship(spark)
    return quality.keep_sampled(docs, quality.resample(docs, read(spark, sf_dir, "labels"))).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, null ids last. Of rows of equal ids and texts one stays.

    Rows are joined by a key: their id, or a hash of id and text where the id is null or has several texts.
    """
    ship(spark)
    i, k = unused(docs, "_i", "_k")
    row = F.xxhash64(F.lit(10), F.col("doc_id"), F.col("text"))
    seen = docs.groupBy("doc_id").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    shared = cut(seen.where("doc_id is null or lo <> hi").select(F.col("doc_id").alias(i)))
    if plain := shared.isEmpty():
        keyed = docs.withColumn(k, F.col("doc_id"))
    else:
        known = docs.where("doc_id is not null").join(shared, F.col("doc_id") == F.col(i), "left")
        known = known.withColumn(k, F.when(F.col(i).isNull(), F.col("doc_id")).otherwise(row)).drop(i)
        keyed = known.unionByName(docs.where("doc_id is null").withColumn(k, row))
    found = ngram_join.ngram_jaccard(keyed, id_col=k, n=SHINGLE, percent=PERCENT)
    if plain:
        kept = found.where(F.col(k) == F.col("component_id")).select(F.col(k).alias(i)).distinct()
    else:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(k).alias("key")))
        kept = found.select(k, F.col("component_id").alias(i)).join(keyed.select(k, "doc_id").distinct(), k).groupBy(i).agg(first.alias("first")).select(F.col("first.key").alias(i))
    return keyed.join(kept, F.col(k) == F.col(i), "left_semi").dropDuplicates([k]).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.keep_clean(docs, decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return mixing.repeat_taken(docs, mixing.mix_sources(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each row stand in the token files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_file.read_tokens(token_file.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: The stages use models, hashes and files that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again; a stage's rows go when the next one's are there."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

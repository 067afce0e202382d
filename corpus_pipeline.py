"""From raw documents to token shards: the stages of a training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colweave.llm import decontam, langid, mixing, simhash, tokenbin
from colweave.llm.queries import tokenizer_path
from colweave.session import materialise, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled documents; the ones the model rejects go."""
    small_batches(spark)
    return langid.drop_rejected(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    small_batches(spark)
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs, mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, and per document what they hold.

    Smaller groups of texts than by default, and workers that keep no words: the executors
    still hold what the stages before left, and go on to others.
    """
    small_batches(spark)
    manifest = tokenbin.write_tokens(docs, tokenizer_path(), text_bytes=1 << 20, remembered=200_000, keep=False)
    return tokenbin.read_documents(manifest)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("source_mixing", source_mixing), ("token_ids", token_ids)]

# Learned models, fingerprints and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = materialise(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)

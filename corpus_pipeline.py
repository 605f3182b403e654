"""A pipeline over the table ``documents``: each stage works on all rows that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
``documents``.  SQL cannot express these stages; the tests compare each with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoquern.llm import decontamination, ngram_join, quality, sentencepiece_codec, substring_dedup
from geoquern.llm._text import ensure_checkpoint_dir

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is one half or more."""
    fitted = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select_quality(docs, fitted)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each class of near duplicates."""
    return ngram_join.keep_one_per_class(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated runs of 20; a document of which nothing is left goes."""
    cut = substring_dedup.cut_repeats(docs)
    gone, kept = F.col("n_removed") > 0, F.col("kept_text")
    cut = cut.where(~gone | (F.length(F.regexp_replace(kept, r"\s+", "")) > 0))
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return cut.select(*(F.when(gone, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip."""
    return sentencepiece_codec.encode(docs, check=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written to the session's checkpoint folder and read again; a stage's input goes when its result stands."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs

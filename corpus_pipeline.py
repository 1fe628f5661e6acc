"""From raw documents to packed training sequences, stage by stage.

Every stage reads all that its predecessor kept and its decision takes effect;
all but the last return the columns of ``documents``.  ``run`` writes each
stage's result as Parquet in the cluster's shared folder (``spark.checkpoint.dir``)
and rereads it, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.llm.common import table
from driftkit.llm.mixing import mixed_documents
from driftkit.llm.packing import pack_documents
from driftkit.llm.queries import vocabulary
from driftkit.llm.simhash import without_near_duplicates
from driftkit.llm.substring import without_repeats
from driftkit.llm.toxicity import toxicity_scores
from driftkit.session import ensure_checkpoint_dir, prepare_session


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects (predicted 1) go."""
    prepare_session(spark)
    whole = docs.withColumn("_whole", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    scored = toxicity_scores(whole, table(spark, sf_dir, "labels"), carry="_whole")
    return scored.where("predicted = 0").select(*[F.col(f"_whole.`{c}`").alias(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest doc_id (NULL
    last), and of several texts under that id the one with the smallest row hash."""
    prepare_session(spark)
    return without_near_duplicates(docs, shingle=3, max_bits=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out."""
    prepare_session(spark)
    return without_repeats(docs, window=13)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; repeated takes repeat the row."""
    prepare_session(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything is packed into sequences of at most 4096 tokens."""
    prepare_session(spark)
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None  # learned scores, XXH64 and a tokenizer are beyond SQL; tests hold the operators behind the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare_session(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

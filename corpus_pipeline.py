"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet
to the shared folder and gives it to the next. The last stage's rows are the mixed corpus: the
columns of documents with redacted texts, copy (which copy of a document it is) and words.

Defined results, at every stage: NULL and empty texts are documents without words (copies of
each other, so one of them stays; the mix takes none of them); of repeated rows one stays;
documents without an id are judged by their text like any other, but decontamination can't
name them and keeps them; empty tables give no rows; columns besides those of documents are
carried, and one called copy or words is replaced by the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallystream.llm import decontaminate, mixing, secret_scan, simhash, toxicity
from tallystream.sources.shared import delete, shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.corpus(docs)


STAGES = [("toxicity", without_toxic), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secrets), ("mixing", mixture)]
#: No SQL can express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if done:  # nothing reads it any more
            delete(spark, done)
        done = f"{base}/{name}"
    return docs

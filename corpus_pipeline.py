"""The corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import op02_packing, op05_shingles, op07_quality, op09_toxicity
from kinmatch.llm.common import shared_dir
from kinmatch.sources.ship import ship

#: Near copies: fingerprints of at most 26 of 128 differing bits, all found by nine segments, and five-word shingles of a similarity of 0.8.
NEAR = {"words": 5, "similarity": 0.8, "radius": 26, "segments": 9}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op09_toxicity.keep_clean(docs, op09_toxicity.fit(docs, labels))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op07_quality.keep_good(docs, op07_quality.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_shingles.keep_one_each(docs, **NEAR)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = op02_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _shipped(stage):
    """The stage, after the package has been sent to the executors."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(toxicity)),
    ("quality", _shipped(quality)),
    ("simhash_near_dedup", _shipped(near_duplicates)),
    ("packing", _shipped(packing)),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

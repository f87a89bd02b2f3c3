"""Documents → training sequences: each stage is one operator of `fleetpulse.llm`, written and reread as Parquet.

Rows with a null doc_id pass the filters (nothing can be said of them); rows that share one stay or go together. The
columns of `documents` are kept up to the last stage, whose rows are the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import contamination, minhash_dedup, packing, suffix_dedup
from fleetpulse.llm import toxicity as crf
from fleetpulse.llm.common import drop_tables, without_ids
from fleetpulse.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain model calls toxic (score ≥ 0.3) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = crf.toxicity(docs, labels).where("predicted = 1").select("doc_id")
    return without_ids(docs, toxic, "doc_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, Jaccard ≥ 0.8) stays: the one with the smallest doc_id."""
    copies = minhash_dedup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id")
    return without_ids(docs, copies, "doc_id")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 400 that also start elsewhere are cut out of the texts."""
    return suffix_dedup.without_repeats(docs, length=400)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other parameters, go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_ids(docs, contamination.contaminated(docs, benchmark).select("doc_id"), "doc_id")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("repeated_strings", repeated_strings),
          ("decontamination", decontamination), ("sequences", sequences)]

#: A trained model, hash minima and a tokenizer are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; every stage reads what the one before has written.

    A stage's input table is deleted once the next table is written; the last table stays for the caller to read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, written)
        written.append(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage only reads the
columns that it needs and keeps the others of each row as they are. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, suffixes, toxicity
from tessera.llm.durable import settled


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of sf_dir's labels predicts as toxic go. Rows without text stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that five-word shingles with a similarity of 0.8 or more connect, the document with the smallest doc_id stays.

    Rows that repeat an id are one document; rows without words are linked with nothing and stay, as do rows without an id.
    """
    found = jaccard.link(docs, k=5, percent=80)
    copies = settled(found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct())
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller doc_id has too are cut out, up to whole characters; n_chars follows.

    A document of which nothing is left goes; one that had no text stays.
    """
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; what it doesn't take goes. Rows come in training order."""
    return mixing.training_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_out), ("ngram_jaccard", near_duplicates_out), ("repeated_passages", repeats_out), ("source_mix", mixed), ("packing", packed)]

#: Learnt scores, tokenizers and byte windows are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

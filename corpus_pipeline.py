"""A training-corpus pipeline: five stages, each one operator of quire.llm over all that the stage before kept.

Every stage reads its predecessor's Parquet table whole.  The first four return the columns of documents; the
last returns (doc_id, tokens, n_tokens, round_trip).  Rows with null ids or texts pass the filters (they can
be neither toxic nor copies nor hold a passage) and are encoded as no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import bpe, decontaminate, phrase_automata, simhash, toxicity
from quire.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on labelled documents among docs."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.dedup(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every recurring passage, the first occurrence stays."""
    return phrase_automata.dedup(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut, documents that are mostly benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_copies), ("passages", cut_passages), ("benchmark", cut_benchmark), ("encoding", encode)]

#: The stages are a trained model, an approximate search, automata and merges, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs

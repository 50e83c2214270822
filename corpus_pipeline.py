"""A corpus pipeline: five stages, each over everything that the one before kept.

1. language_id: documents whose language can't be determined go (no letters, or a posterior below 0.5);
2. exact_dedup: of equal texts the row with the largest doc_id stays;
3. ngram_join: of each group of texts linked at five-word shingles and a similarity of 0.8 the
   row with the least doc_id stays;
4. mixing: documents as often as the mix takes them (none to three times), dealt to output
   shards and shuffled in each;
5. packing: all of these as pieces of at most 2048 tokens in sequences.

The first four return the columns of documents.  Each stage's result is a Parquet table in
the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewarp.llm import exact_dedup, language_id, mixing, ngram_join, packing
from basewarp.llm.common import documents, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept_rows(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned language model, hash permutations and a tokenizer are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

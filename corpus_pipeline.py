"""Corpus pipeline: five stages of the training-data operators, from raw documents to their piece ids.

Each stage takes what its predecessor kept, with the columns of ``documents``, and is written as Parquet before
the next reads it. Stages 1 to 4 return the columns of ``documents``; the last returns ids and decoded texts.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import piece_codec, simhash, source_mix, substring_dedup, toxicity
from paperloom.llm.shared import dropped, scratch_dir
from paperloom.session import ship

#: Not expressible in SQL (XXH64, learned scores, BPE); the tests hold the stages against brute force.
ORACLE_SQL = None


def stage(function):
    """A stage, on executors that have the package."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


@stage
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix_documents(docs)


@stage
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("substring dedup", drop_repeats),
    ("source mix", mix_sources),
    ("piece codec", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again, and goes when the
    next is written. The last of them stays, since the result reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = scratch_dir(spark, name.replace(" ", "-"))
        (out := step(spark, docs, sf_dir)).write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

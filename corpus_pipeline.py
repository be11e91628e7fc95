"""A training-data pipeline over ``documents``, stage by stage.

Each stage is ``function(spark, docs, sf_dir) -> DataFrame`` and works on all
rows that its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes every stage's result as Parquet in the shared
folder and rereads it, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagwright.llm.common import load, materialize
from tagwright.llm.decontaminate import decontaminate
from tagwright.llm.language import known_language
from tagwright.llm.mix import mix_sources, take
from tagwright.llm.queries import tokenizer_path
from tagwright.llm.simhash import simhash_dedup
from tagwright.llm.tokens import token_round_trip

#: Several stages have no SQL form (learned language model, pivotal rounding,
#: tokenizer); the tests hold the stages against brute force.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    return known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark items contaminate."""
    judged = decontaminate(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.where("NOT contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for."""
    return take(mix_sources(docs)).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode into token records and read them back."""
    return token_round_trip(docs, tokenizer_path)


STAGES = [("language_id", identify_languages), ("simhash_dedup", drop_near_copies), ("decontaminate", drop_benchmark),
          ("mix_sources", mix), ("token_records", write_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: five operators over all documents, each stage on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlake.llm import decontaminate, language, mixing, ngram_join, sharding
from claimlake.llm.common import fresh, quoted, stash, table

SHARDS = 16


def _as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told (null, or without a letter) go."""
    learned = docs.filter(language.remainder("doc_id", 4) != 2).select("doc_id", "text", "lang")
    found = language.identify(docs, language.Model(language.sample(learned)))
    return _as_before(found.filter(F.col("lang_pred") != "und"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays; documents are similar from a Jaccard of 0.8 of their five-word shingles (op5's own contract asks for 3 and 0.9)."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: a twentieth of the words or more stands in benchmark windows."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _as_before(found.filter(~((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each use of a document, none where its source has enough without it.

    The training position is a last column, as rows read from Parquet again have no order of their own.
    """
    position, = fresh(docs, "training_position")
    mixed = mixing.mix_sources(docs, mixing.word_count())
    return mixing.training_order(mixed, docs.columns, position)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of the mix with shard and slot; slots of a shard follow the training position, the mix's last column."""
    position = docs.columns[-1]
    return sharding.shard_documents(docs, SHARDS, along=position).drop(position)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Suffix automata, components and bounded loads are not said in SQL. A test compares run()'s rows with the five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

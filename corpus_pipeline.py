"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. Documents without a language that can be told go.
2. Of each class of near duplicates, one document stays.
3. Documents of which one word in twenty or more stands in the benchmark go.
4. Secrets are replaced by a mark.
5. The rest is mixed by source: documents get their number of copies.

A stage starts when the rows of the one before have been written; it deletes the tables that these were made from.
Each stage takes documents with nulls in any column, repeated rows, shared ids and further columns as its operator
says: null texts and texts without a letter go with the first stage, null ids are documents of their own, a null
source is a source of its own. An empty table stays empty.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, jaccard_join, language_id, mixing, secrets
from tessera.llm.common import crc_mod
from tessera.session import cut, drop, noting, release

#: No SQL: the language model, the classes and the balanced sample aren't relations that SQL can state.
ORACLE_SQL = None

#: The tables that the stage before has made for its rows, by the folder of a run's tables. A thread has its own, so runs side by side don't meet.
_runs = threading.local()


def stage(function: Callable) -> Callable:
    """Deletes the tables of the stage before when the next one of the same run starts, as the rows of that one have been written."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _runs.__dict__.setdefault("made", {})
        release(spark, made.pop(sf_dir, []), docs)
        with noting() as paths:
            out = function(spark, docs, sf_dir)
        made[sf_dir] = paths
        return out

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told. The model learns from the labelled documents that aren't held out."""
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"), id_col="doc_id")
    return language_id.keep_identified(docs, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of 5-word shingles with a similarity of 80 % or more."""
    return jaccard_join.one_of_each(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold the benchmark's passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in texts; n_chars follows the text."""
    clean = secrets.redact(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the documents taken, and how many copies of each."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        before, docs = docs, cut(function(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            drop(before)
    return docs

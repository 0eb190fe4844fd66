"""The corpus pipeline: language, toxicity, exact copies, near copies, packed sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the rows that it keeps, with all their columns (the last
one: the packed pieces). run() applies them to the documents table, writing each stage's rows as Parquet and reading them back.

Defined results: a stage that gets no rows returns none; language and toxicity judge each row by its own text, also where doc_ids repeat or
are null, and a score at the threshold goes on for languages and goes for toxicity; null and empty texts have no language and go; very long texts
are judged whole; extra columns go on whatever their names; for copies, near copies and packing see the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import language, toxicity
from tidewell.llm.block_names import without_exact_duplicates
from tidewell.llm.common import settle
from tidewell.llm.near_copies import without_near_copies
from tidewell.llm.packing import pack

#: A document goes if its language can't be told with this posterior, or if it is toxic with this score.
LANGUAGE_SURE, TOXIC = 0.5, 0.5

#: SQL can't express the trained stages; the tests compare exact and near copies and packing with brute force, what language and toxicity drop with
#: labels and letters (their scores are compared with brute force as operators), and run() as a whole with what has to be left.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told go on."""
    return language.with_known_language(docs, language.fit(docs), LANGUAGE_SURE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold go on."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id goes on."""
    return without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their 5-word shingles, the one with the smallest id goes on. Candidates come from
    the SimHash multi-index and from bottom-k sketches, which find what 64 bits can't."""
    return without_near_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_known_languages),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

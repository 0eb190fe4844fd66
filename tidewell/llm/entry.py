"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.block_names import exact_duplicates
from tidewell.llm.bottom_k import near_duplicates as near_duplicates_by_sketches
from tidewell.llm.common import read
from tidewell.llm.gumbel_pieces import sampled_encodings
from tidewell.llm.hash_tree import shards
from tidewell.llm.language import languages
from tidewell.llm.packing import pack
from tidewell.llm.prefix_counts import token_counts
from tidewell.llm.prefix_trie import ORACLE as TRIE_SQL
from tidewell.llm.prefix_trie import trie_nodes
from tidewell.llm.rotated_centroids import clusters
from tidewell.llm.rotated_centroids import oracle as centroid_sql
from tidewell.llm.scaled_sketch import fingerprints_with_edits
from tidewell.llm.simhash import near_duplicates
from tidewell.llm.token_files import token_files
from tidewell.llm.toxicity import toxicity


def op1_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_encodings(read(spark, sf_dir, "documents"))


def op2_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(read(spark, sf_dir, "documents"))


def op3_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"), 40)


def op5_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op6_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op11_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_by_sketches(read(spark, sf_dir, "documents"))


def op12_rotated_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def op13_double_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(read(spark, sf_dir, "conversations"))


#: One query for each operator.
QUERIES = (
    op1_gumbel_top_k, op2_scaled_sketch, op3_subword_bag, op4_hash_tree, op5_block_naming, op6_prefix_counts, op7_multi_index, op8_word_backoff,
    op9_token_files, op10_sum_of_squares, op11_bottom_k, op12_rotated_centroids, op13_double_array,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_block_naming": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
            g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
        "op12_rotated_centroids": centroid_sql(),
        "op13_double_array": TRIE_SQL,
    }

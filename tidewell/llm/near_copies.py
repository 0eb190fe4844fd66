"""SimHash near duplicates with a guaranteed similarity: each link is verified by the exact Jaccard similarity of the word shingles.

Candidates are what the multi-index search finds (fingerprints within 3 bits), and more: at a similarity of 0.8 two 64-bit fingerprints differ
in 9.7 bits on average, and balls that reach so far hold a share of all pairs. So the bottom-k sketches of bottom_k give further candidates, of
which a pair at the limit is missed with a probability of 2e-10 at most, also in crowds of documents that share a passage. Every candidate is then
judged by its full sets, so no link is wrong.

Defined results: words and hashes as in simhash; equal sets are linked, and so are all texts without a word; of repeated rows each is a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bottom_k import near_groups
from tidewell.llm.common import settle, shuffled, without
from tidewell.llm.simhash import links as fingerprint_links
from tidewell.llm.simhash import majority

WORDS, PERCENT = 5, 80


def fingerprint_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a < b) of prints by multi-index search over their fingerprints: each print with the least of its own fingerprint, and the least
    ones of fingerprints that link. Their chains hold all links of fingerprints without forming all pairs."""
    leads = settle(groups.groupBy("fingerprint").agg(F.min("print").alias("lead")), "leads")
    near = fingerprint_links(leads.select(F.col("fingerprint").alias("print")))
    lead = lambda c: shuffled(leads.select(F.col("fingerprint").alias(c), F.col("lead").alias(f"{c}_lead")))
    near = near.join(lead("a"), "a").join(lead("b"), "b").select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b"))
    same = groups.join(shuffled(leads), "fingerprint").filter("print <> lead").select(F.col("lead").alias("a"), F.col("print").alias("b"))
    return near.unionByName(same)


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over links, for each row."""
    return near_groups(docs, words, percent, majority, fingerprint_pairs).select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the document with the smallest doc_id. Rows of one doc_id share
    their fate, so those that repeat it are left as they are; rows without doc_id stay."""
    found = near_copies(docs, words, percent)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("doc_id is not null and not stays")
    return without(docs, settle(gone.select(F.col("doc_id").alias("_tw_id")), "gone"), docs["doc_id"] == F.col("_tw_id"))

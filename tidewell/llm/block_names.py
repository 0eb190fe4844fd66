"""Exact duplicates by deterministic block naming.

Every normalised text is cut into fixed-size blocks. The distinct blocks are sorted (by 64-bit hash, then by content) and each gets an
integer name from its place in that order; then adjacent names are paired, the distinct pairs are sorted and named in turn, until each
document has one name. Two documents have equal identities (number of blocks, name) exactly if their texts are equal: a hash only places
blocks, and blocks that share a hash without being equal are told apart by their content.

Block contents cross the network once, pre-aggregated before the shuffle (equal blocks of one task become one row). All that follows are
rows of a few integers. Joins are plain equi-joins, whose skewed partitions Spark splits.

Defined results: a null text is the empty text; repeated rows of one doc_id are rows of their own, and of equal ones exactly one is kept;
of equal texts the smallest doc_id stays (a null doc_id stays only where all in the group are null); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle, shuffled, without

#: Bytes in a block. Two in five documents of the check tables have more than one, the longest sixty.
BLOCK = 2048
#: The sorted order is cut into so many ranges by hash; names are numbered within a range.
RANGES = 1 << 16


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space. Only runs that change anything are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _ranked(keys: DataFrame, place: Column, order: list[str]) -> DataFrame:
    """Integer names for distinct keys: the range of the key in the high bits, its place there in the low ones."""
    by = Window.partitionBy("range").orderBy(*order)
    return keys.withColumn("range", F.pmod(place, F.lit(RANGES))).withColumn("name", F.shiftleft(F.col("range").cast("long"), 44) + F.row_number().over(by)).drop("range")


def block_identities(docs: DataFrame, block: int = BLOCK, place: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: row_id, doc_id, text_sha256, n_blocks, name. `place` hashes a block; a poor hash costs time, not correctness."""
    whole = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("text"))
    rows = settle(
        whole.select(
            F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("text"), block), lambda b: place(b)).alias("places"),
        ),
        "rows",
    )
    cut = whole.select(F.explode(_blocks(F.col("text"), block)).alias("block")).withColumn("place", place(F.col("block")))
    found = settle(cut.groupBy("place").agg(F.min("block").alias("low"), F.max("block").alias("high")).select("place", (F.col("low") != F.col("high")).alias("shared")), "places")

    # sort the blocks into integer names; a place that different blocks share is settled by their contents
    alone = found.filter(~F.col("shared")).select("place", F.lit(0).alias("nth"))
    shared = found.filter("shared").select("place")
    mixed = bool(shared.head(1))
    if mixed:
        contents = cut.join(shared, "place", "left_semi").distinct()
        contents = settle(contents.withColumn("nth", F.row_number().over(Window.partitionBy("place").orderBy("block"))), "contents")
        alone = alone.unionByName(contents.select("place", "nth"))
    names = settle(_ranked(alone, F.col("place"), ["place", "nth"]), "names")

    parts = rows.select("row_id", F.size("places").alias("n_blocks"), F.posexplode("places").alias("at", "place"))
    named = parts.join(shuffled(names.filter("nth = 0").select("place", "name")), "place").select("row_id", "n_blocks", "at", "name")
    if mixed:
        # the few rows concerned are found again by doc_id and digest, since row_id exists only in the settled table
        again = whole.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.posexplode(_blocks(F.col("text"), block)).alias("at", "block")).withColumn("place", place(F.col("block")))
        again = again.join(shared, "place", "left_semi").distinct().join(contents, ["place", "block"]).join(names.filter("nth > 0"), ["place", "nth"])
        again = again.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "at", "name")
        whose = rows.select("row_id", "doc_id", "text_sha256", F.size("places").alias("n_blocks"))
        named = named.unionByName(again.join(whose, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))).select("row_id", "n_blocks", "at", "name"))

    # name adjacent pairs until one name is left
    done = [named.filter("n_blocks = 1").select("row_id", "name")]
    left = rows.agg(F.max(F.size("places"))).first()[0] or 0
    if left > 1:
        named = settle(named.filter("n_blocks > 1"), "level")
    while left > 1:
        pairs = named.groupBy("row_id", "n_blocks", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("first"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second")
        )
        pairs = settle(pairs, "pairs")
        names = _ranked(pairs.select("first", "second").distinct(), F.xxhash64("first", "second"), ["first", "second"])
        named = settle(pairs.join(names, ["first", "second"]).select("row_id", "n_blocks", "at", "name"), "level")
        last = named.groupBy("row_id").agg(F.max("at").alias("last")).filter("last = 0").select("row_id")
        done.append(named.join(last, "row_id", "left_semi").select("row_id", "name"))
        named = named.join(last, "row_id", "left_anti")
        left = (left + 1) // 2
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.select("row_id", "doc_id", "text_sha256", F.size("places").alias("n_blocks")).join(identity, "row_id")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, place: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (smallest doc_id among equal texts), group_size, kept, text_sha256 of the normalised text."""
    rows = settle(block_identities(docs, block, place), "identities")
    groups = rows.groupBy("n_blocks", "name").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    groups = settle(groups, "groups")  # so that both sides of the join are plain shuffles, which Spark can split where a group is large
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_sha256"
    )


def without_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows that repeat a doc_id with an equal text are reduced to one as well."""
    found = exact_duplicates(docs)
    gone = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("stay")).filter("stay < n")
    twice = bool(gone.filter("stay > 0").head(1))
    gone = settle(gone.select(F.col("doc_id").alias("_tw_id"), F.col("text_sha256").alias("_tw_sha"), F.col("stay").alias("_tw_stay")), "gone")
    own_sha = F.sha2(normalised(docs["text"]).cast("binary"), 256)
    out = without(docs, gone, docs["doc_id"].eqNullSafe(F.col("_tw_id")) & (own_sha == F.col("_tw_sha")))
    if twice:  # of rows that repeat a doc_id and its text, one comes back
        back = docs.join(gone.filter("_tw_stay > 0"), docs["doc_id"].eqNullSafe(F.col("_tw_id")) & (own_sha == F.col("_tw_sha")))
        back = back.dropDuplicates(["_tw_id", "_tw_sha"]).select(*[docs[c] for c in docs.columns])
        out = out.unionByName(back)
    return out

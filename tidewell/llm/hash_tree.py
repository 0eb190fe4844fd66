"""Shards by a tree of weighted hash draws.

Shards hang in racks and racks in regions; every rack and region has a place for each shard that it may hold, taken or not. A row's key gives every
region a sequence of records, each with a time that the region has drawn: steps of -ln(u) / width, so a region draws in proportion to its places. The
region with the earliest record is taken, the record's draws for its racks choose the rack, those for the rack's shards the shard, and a height
that it draws must lie below the shard's weight. If it doesn't, the region goes on to its next record and the regions draw anew. Accepted records
come in proportion to the weights (consistent weighted sampling over the tree). A row draws once for each region, and then for the racks of one
region and the shards of one rack only; with places mostly taken, few records are refused.

No draw depends on a weight: weights only decide which records are accepted. When a shard's weight grows, or a shard is added at any count, a row moves
only if an earlier record of it is accepted now, and then into that shard; when it shrinks, only its own rows move; nothing moves between subtrees
whose weights stay. Heights lie in layers [0, 1), [1, 2), [2, 4), ..., with records of their own and a region has those that its largest weight
reaches, so weights have no upper bound; weights far below 1 are refused often and cost time.

Slots number the rows of a shard without gaps: rows are counted by (shard, part of the hash range), the counts are summed up over the parts
of a shard, and each part numbers its own rows from there; no task gets a whole shard, and the parts grow in number with the table.

Defined results: doc_id and the shard weights alone decide; a null doc_id is a key like any other; a null text has no bytes; rows that
repeat a doc_id go to one shard, in slots of their own (spread over parts by their texts); very long texts are measured, not copied; an empty
table gives an empty table; negative or no positive weights are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle, texts_of

#: Shards in a rack, racks in a region; rows that a part numbers on its own, shards times parts at most (one short row each is broadcast);
#: bytes of a row besides its text.
RACK, REGION, ROWS, PARTS, OVERHEAD = 4, 2, 2000, 1_000_000, 16
#: Draws that a task holds at a time.
_CELLS = 1 << 18
#: The increment and the two multipliers of the SplitMix64 generator.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: What a record's draws are for; racks and shards add their number.
_HEIGHT, _RACKS, _SHARDS = 1, 1 << 20, 1 << 40


def mixed(key: np.ndarray, number: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of a 64-bit key and a number."""
    z = key + np.asarray(number).astype(np.uint64) * np.uint64(_STEP) + np.uint64(_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_SECOND)
    return z ^ (z >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """A value in (0, 1) from the upper 53 bits of a 64-bit hash."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def drawn(keys: np.ndarray, weights: list[float], rack: int = RACK, region: int = REGION) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    if not weights or min(weights) < 0 or not 0 < max(weights) < math.inf:
        raise ValueError("weights are finite, not negative, and one is positive")
    size = rack * region
    places = np.zeros(-(-len(weights) // size) * size)
    places[: len(weights)] = weights
    reach = places.reshape(-1, size).max(axis=1)
    # one track of records for each layer of each region: region, lower end and width of the layer, number
    tracks = [(r, 0.0 if j == 0 else 2.0 ** (j - 1), 1.0 if j == 0 else 2.0 ** (j - 1), (r << 11) + j) for r, w in enumerate(reach) if w > 0 for j in range(1 + max(0, math.ceil(math.log2(w))))]
    of, low, width, number = (np.array(c) for c in zip(*tracks, strict=True))
    out = np.empty(len(keys), dtype=np.int32)
    block = max(1, _CELLS // len(tracks))
    for start in range(0, len(keys), block):
        seeds = mixed(keys[start : start + block, None], number)  # of the tracks of each row
        record = mixed(seeds, 0)
        at = -np.log(unit(record)) / width
        nth = np.zeros(at.shape, dtype=np.int64)
        left = np.arange(len(at))
        while len(left):
            t = at[left].argmin(axis=1)
            own = record[left, t]
            racks = mixed(own[:, None], _RACKS + np.arange(region)).argmin(axis=1)
            shard = racks * rack + mixed(own[:, None], _SHARDS + racks[:, None] * rack + np.arange(rack)).argmin(axis=1) + of[t] * size
            taken = low[t] + width[t] * unit(mixed(own, _HEIGHT)) < places[shard]
            out[start + left[taken]] = shard[taken]
            left, t = left[~taken], t[~taken]
            nth[left, t] += 1
            record[left, t] = mixed(seeds[left, t], nth[left, t])
            at[left, t] -= np.log(unit(record[left, t])) / width[t]
    return out


def shard_of(key: Column, weights: list[float], rack: int = RACK, region: int = REGION) -> Column:
    """The shard that a key falls into, for shards 0, 1, ... of the given weights (0: never taken)."""

    @F.pandas_udf("int")
    def descend(hashes: pd.Series) -> pd.Series:
        return pd.Series(drawn(hashes.to_numpy(dtype=np.int64).view(np.uint64), weights, rack, region))

    return descend(F.xxhash64(key, F.lit("shard")))


def shards(docs: DataFrame, n: int, rack: int = RACK, region: int = REGION, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) for each row."""
    weights = weights or [1.0] * n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            now, grown = (pa.array(drawn(keys, w, rack, region)) for w in (weights, [*weights, 1.0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], now, grown], names=["doc_id", "size", "text_crc32", "shard", "grown_shard"])

    size, crc = (F.octet_length("text") + OVERHEAD).cast("long"), F.crc32(F.col("text").cast("binary"))
    measured = texts_of(docs).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64("doc_id", F.lit("shard")).alias("key"))
    # texts are read once: what is left of them is measured here, and both the counts and the numbers come from the settled rows
    rows = settle(measured.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int"), "rows")
    parts = max(1, min(rows.count() // (n * ROWS), PARTS // n))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # PARTS rows at most
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(bases), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), "grown_shard"
    )

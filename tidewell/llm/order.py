"""The next row in a global order of ids, without sorting the table in one task.

Ids are dealt into buckets of the order, about ROWS rows each. The bounds of up to COARSE ranges are quantiles of the ids themselves; only in
tables of more than COARSE * ROWS rows is a range cut further, evenly between its bounds, so that an id far from all others spoils one range of
COARSE at most. A row finds its range by binary search.

Rows that repeat one doc_id share a bucket, and so do those without one.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import settle

#: Ranges whose bounds the driver holds, rows that a bucket is meant to have, buckets at most (one row of two numbers each is broadcast; beyond
#: BUCKETS * ROWS rows buckets grow), and rows that a task is meant to have.
COARSE, ROWS, BUCKETS, TASK = 8192, 1000, 2_000_000, 8000


def _numbers(values: list, kind: str) -> Column:
    """A constant array, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class Buckets:
    """n: rows; tasks: partitions to deal them into; bucket: an expression that maps doc_id to a bucket, in the same order (null: -1)."""

    def __init__(self, ids: DataFrame, rows: int = ROWS):
        n = ids.count()
        ranges = max(1, min(n // rows, COARSE))
        shares = [i / ranges for i in range(ranges)]
        bounds = ids.agg(F.percentile_approx("doc_id", _numbers(shares, "double"), F.lit(20 * ranges))).first()[0]
        bounds = sorted(set(bounds or [0]))
        fine = max(1, min(n // (len(bounds) * rows), BUCKETS // len(bounds)))
        self.n, self.tasks = n, max(1, math.ceil(n / TASK))
        lows, key = _numbers(bounds, "bigint"), F.col("doc_id")
        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        k = F.aggregate(_numbers(steps, "int"), F.lit(0), lambda at, s: F.when(F.get(lows, at + s - 1) <= key, at + s).otherwise(at))  # bounds at or below
        part = F.lit(0)
        if fine > 1:
            low, high = F.get(lows, k - 1).cast("double"), F.get(lows, k).cast("double")
            part = F.coalesce(F.greatest(F.least(F.floor((key - low) / (high - low) * fine), F.lit(fine - 1)), F.lit(0)), F.lit(0))
        self.bucket = F.when(key.isNull(), F.lit(-1)).otherwise(k * fine + part).cast("long")


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """doc_id and the carried columns of each row, dealt into buckets in one shuffle, for lead_in_bucket.

    The first row of each bucket is sent to the bucket before it as well, so that no task needs another's rows.
    """
    order = Buckets(docs.select("doc_id"))
    bucket = order.bucket
    rows = docs.select("doc_id", *[c.alias(name) for name, c in carried.items()])
    heads = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))  # at most BUCKETS rows
    ring = Window.orderBy("bucket")
    heads = heads.select("head", F.coalesce(F.lead("bucket").over(ring), F.first("bucket").over(ring)).alias("also"))
    heads = settle(heads, "heads").select(F.col("head").alias("_head"), "also")
    dealt = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")), "left").drop("_head")
    copies = F.when(F.col("also").isNull(), F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("also").alias("bucket"), F.lit(True).alias("guest")))
    )
    return dealt.select("doc_id", *carried, F.explode(copies).alias("copy")).select("doc_id", *carried, "copy.bucket", "copy.guest").repartition(order.tasks, "bucket")


def lead_in_bucket(dealt: DataFrame, names: list[str], tie: str) -> DataFrame:
    """doc_id, the carried columns, and `next_<name>` of the row that follows in descending doc_id (after the last: the first).

    Of rows with one doc_id, the order is that of the hash of what they carry. Nulls come last.
    """
    by = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64(tie))
    return dealt.select("*", *[F.lead(c).over(by).alias(f"next_{c}") for c in names]).filter(~F.col("guest")).drop("bucket", "guest")

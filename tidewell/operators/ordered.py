"""Sums along a global order, and ranks, without a window over all rows in one task."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into at least and at most (the driver holds their bounds), and rows that one is meant to have.
RANGES, MOST_RANGES, ROWS = 200, 2000, 1_000_000
#: Rows that a task groups by key.
SHARE = 500_000


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which driver and executors share; one of our own only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, fixes what a recomputation might change."""
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_shares(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt by key to tasks of about SHARE rows, so that what a task holds to group them doesn't grow with the table. n: rows of the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE)), key)


def range_of(df: DataFrame, order: str, descending: bool = False, apart: bool = False) -> Column:
    """Number of the range that a value of the order column lies in, ascending along the order, found by binary search among the bounds. With
    `apart`, ranges have even numbers, and the rows of a value that is itself a bound have the odd number that follows."""
    n, bounds = df.agg(F.count(order), F.percentile_approx(order, [i / MOST_RANGES for i in range(1, MOST_RANGES)], 10_000)).first()
    wanted = max(RANGES, min(MOST_RANGES, n // ROWS))
    bounds = sorted(set((bounds or [])[MOST_RANGES // wanted - 1 :: MOST_RANGES // wanted]))
    kind = df.schema[order].dataType.simpleString()
    if not bounds:
        return F.lit(0)  # no values at all
    if kind in ("double", "float", "bigint", "int", "smallint", "tinyint"):
        table = F.from_json(F.lit(json.dumps(bounds)), f"array<{kind}>")  # a constant
    else:
        table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda k, s: F.when(F.get(table, k + s - 1) < F.col(order), k + s).otherwise(k))  # bounds below the value
    at = 2 * at + F.when(F.get(table, at) == F.col(order), 1).otherwise(0) if apart else at
    return -at if descending else at


def prefix_sums(df: DataFrame, order: str, values: dict[str, Column], by: tuple[str, ...] = (), descending: bool = False, following: str | None = None) -> DataFrame:
    """For each distinct (by, order): sums of the value expressions (`<name>`), and over everything strictly before (`<name>_before`); on
    request the order value that comes next, under the name `following`.

    Equal order values are collapsed first, so ties never straddle ranges. Ranges of the order get totals, whose running sums (MOST_RANGES rows
    at most for each `by`) are joined to running sums within the range.
    """
    grouped = df.groupBy(*by, order).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    grouped = settle(grouped.filter(F.col(order).isNotNull()))
    grouped = grouped.withColumn("_range", range_of(grouped, order, descending))
    end = F.max(order) if descending else F.min(order)
    totals = grouped.groupBy(*by, "_range").agg(end.alias("_first"), *[F.sum(n).alias(f"_t_{n}") for n in values])
    ranges = Window.partitionBy(*by).orderBy("_range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, "_range", F.lead("_first").over(ranges).alias("_then"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    places = Window.partitionBy(*by, "_range").orderBy(F.col(order).desc() if descending else F.col(order))
    inside = places.rowsBetween(Window.unboundedPreceding, -1)
    out = grouped.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in values} | ({"_next": F.lead(order).over(places)} if following else {}))
    out = out.join(bases, [*by, "_range"])
    return out.select(*by, order, *values, *[(F.col(f"{n}_before") + F.col(f"_b_{n}")).alias(f"{n}_before") for n in values], *([F.coalesce("_next", "_then").alias(following)] if following else []))


def long_quantiles(long: DataFrame, value: str, at: list[float], by: str) -> dict[str, list[float]]:
    """Exact linear-interpolated quantiles of each group of a long table, from running counts: no task holds a group's values."""
    rows = long.filter(F.col(value).isNotNull())
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each group
    if not sizes:
        return {}
    places = {g: [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1)) for p in at] for g, n in sizes.items()}
    wanted = sorted((g, k) for g, ps in places.items() for k in {x for lo, hi, _ in ps for x in (lo, hi)})
    table = rows.sparkSession.createDataFrame(wanted, f"_g {long.schema[by].dataType.simpleString()}, _k long")
    steps = prefix_sums(rows, value, {"_n": F.lit(1)}, (by,))
    hit = steps.join(F.broadcast(table), (F.col(by) == F.col("_g")) & (F.col("_n_before") <= F.col("_k")) & (F.col("_k") < F.col("_n_before") + F.col("_n")))
    found = {(r["_g"], r["_k"]): float(r[value]) for r in hit.select("_g", "_k", value).collect()}
    return {g: [found[g, lo] + (found[g, hi] - found[g, lo]) * (x - lo) for lo, hi, x in ps] for g, ps in places.items()}


def average_ranks(df: DataFrame, value: str, out: str = "rank", by: tuple[str, ...] = (), share: bool = False) -> DataFrame:
    """Rank from 1, ties sharing their mean rank, NULL for NULL; as a share of the ranked rows on request."""
    table = prefix_sums(df, value, {"_n": F.lit(1)}, by)
    table = table.select(*by, F.col(value).alias("_v"), (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(out))
    if share:
        sizes = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_all")) if by else df.agg(F.count(value).alias("_all"))
        table = table.join(sizes, list(by)) if by else table.crossJoin(F.broadcast(sizes))  # one row
        table = table.withColumn(out, F.col(out) / F.col("_all")).drop("_all")
    table = table.select(F.col("_v").alias("_k0"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by, 1)], F.col(out).alias("_rank"))
    condition = F.col(value) == F.col("_k0")
    for i, b in enumerate(by, 1):
        condition = condition & (F.col(b) == F.col(f"_k{i}"))
    return df.join(table, condition, "left").select(*df.columns, F.col("_rank").alias(out))


def top(df: DataFrame, k: int, by: str, tie: str = "ID", within: tuple[str, ...] = ()) -> DataFrame:
    """The k rows with the largest values, of each group if asked for; NULLs last, ties by key."""
    order = [F.col(by).desc_nulls_last(), F.col(tie)]
    if not within:
        return df.orderBy(*order).limit(k)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col("_nth") <= k).drop("_nth")


def first_by_key(df: DataFrame, key: str | list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in a total order."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def row_statistics(long: DataFrame, value: str, key: str = "ID") -> DataFrame:
    """Mean, sample deviation and mean magnitude of a long table's values by key."""
    return long.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg(F.abs(value)).alias("mean_abs"))


def latest(runs: DataFrame, name: str = "run_id", at: str = "created_at") -> DataFrame:
    """The run that was created last."""
    return runs.orderBy(F.col(at).desc(), F.col(name).desc()).limit(1)


def last_known(df: DataFrame, order: str, then: str, value: str, out: str) -> DataFrame:
    """The value of the last row at or before each row, in the order of two columns, that has one. Ranges of the order hand on their last value."""
    rows = settle(df)
    rows = rows.withColumn("_range", range_of(rows, order))
    inside = Window.partitionBy("_range").orderBy(order, then).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order, then))).alias("_end"))
    ends = ends.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # MOST_RANGES rows at most
    return rows.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(ends, "_range").select(*df.columns, F.coalesce("_own", "_carried").alias(out))

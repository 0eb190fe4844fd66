"""Keyed joins and set operations between tables. Sizes are left to Spark: it broadcasts a side whose measured size is small, and splits skewed partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(a: DataFrame, b: DataFrame, key: str = "ID") -> DataFrame:
    return a.join(b, key, "inner")


def stack(tables: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Tables one under the other by column name, with a column that says which; missing columns are NULL."""
    parts = [t.withColumn(tag, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def add_new_columns(base: DataFrame, extra: DataFrame, key: str = "ID") -> DataFrame:
    """Left join that brings only columns that the base lacks."""
    new = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(key, *new), key, "left") if new else base


def outer_blocks(blocks: list[DataFrame], key: str = "ID") -> DataFrame:
    """Full outer join of blocks on the key, missing numbers as 0: rows are stacked and aggregated once, one shuffle for all blocks."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), blocks)
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in names]).na.fill(0)


def lookup(rows: DataFrame, dimension: DataFrame, key: Column, dimension_key: str, fallback: Column | None = None) -> DataFrame:
    """Columns of a dimension by an expression key, and by a second expression where the first finds nothing."""
    values = [c for c in dimension.columns if c != dimension_key]
    first = dimension.select(F.col(dimension_key).alias("_k1"), *[F.col(c).alias(f"_a_{c}") for c in values])
    out = rows.withColumn("_key", key).join(first, F.col("_key") == F.col("_k1"), "left")
    if fallback is None:
        return out.select(*rows.columns, *[F.col(f"_a_{c}").alias(c) for c in values])
    second = dimension.select(F.col(dimension_key).alias("_k2"), *[F.col(c).alias(f"_b_{c}") for c in values])
    out = out.withColumn("_key2", F.when(F.col("_k1").isNull(), fallback)).join(second, F.col("_key2") == F.col("_k2"), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in values])


def fill_from(rows: DataFrame, values: DataFrame, column: str, value: str, key: str = "ID") -> DataFrame:
    """A column's empty or missing entries taken from a joined table."""
    given = values.select(key, F.col(value).alias("_fill"))
    blank = F.coalesce(F.trim(F.col(column)), F.lit("")) == ""
    return rows.join(given, key, "left").withColumn(column, F.when(blank, F.col("_fill")).otherwise(F.col(column))).drop("_fill")


def added_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts by key of both tables together, over the union of keys."""
    return a.select(key).unionByName(b.select(key)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that only one table has: `added` (only b) and `removed` (only a)."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    return y.join(x, column, "left_anti").select(column, F.lit("added").alias("change")).unionByName(x.join(y, column, "left_anti").select(column, F.lit("removed").alias("change")))


def common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))

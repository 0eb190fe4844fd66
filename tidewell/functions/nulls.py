"""Missing values: NULL is the only marker; NaN and infinities are turned into it where data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def no_nan(c: Column) -> Column:
    """NaN becomes NULL, since NaN compares as larger than everything in Spark."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def number(c: Column) -> Column:
    """A double where the value reads as a finite one, else NULL."""
    return finite(c.try_cast("double"))


def blank_as_null(c: Column, *tokens: str) -> Column:
    """Empty text and the given tokens become NULL. They are looked for in a constant, as comparisons for many columns make a method that Java won't compile."""
    if not tokens:
        return F.when(F.trim(c) != "", c)
    return F.when(~F.array_contains(F.array(*map(F.lit, ("", *tokens))), F.trim(c)), c)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or can't be told."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]


def clean_doubles(df: DataFrame) -> DataFrame:
    """All floating columns without NaN and infinities, in one projection."""
    names = set(doubles(df))
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])

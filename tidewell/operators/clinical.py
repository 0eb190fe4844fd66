"""Features of the clinical measures: one projection, no shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import finite, flag

_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "==": Column.__eq__}


def ratios(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """Quotients; NULL where the denominator is 0 or missing."""
    return {name: F.try_divide(F.col(a), F.col(b)) for name, (a, b) in pairs.items()}


def thresholds(rules: dict[str, tuple[str, str, float]]) -> dict[str, Column]:
    """1 or 0; 0 where the value is missing."""
    return {name: flag(_OPS[op](F.col(c), F.lit(float(v)))) for name, (c, op, v) in rules.items()}


def missing_flags(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}


def log_columns(columns: list[str]) -> dict[str, Column]:
    """log1p of values from 0 on."""
    return {f"log_{c}": F.when(F.col(c) >= 0, F.log1p(F.col(c))) for c in columns}


def clinical_features(
    df: DataFrame, measures: list[str], pairs: dict[str, tuple[str, str]], rules: dict[str, tuple[str, str, float]],
    scores: dict[str, list[str]], score_flags: dict[str, tuple[str, int]], logs: list[str] | None = None,
) -> DataFrame:
    """All blocks: indicators, all-missing flag, ratios, thresholds, scores (where all components exist), flags on scores, logs."""
    have = [c for c in measures if c in df.columns]
    df = df.withColumns({c: finite(F.col(c)) for c in have})
    usable = {n: p for n, p in pairs.items() if set(p) <= set(have)}
    tests = {n: r for n, r in rules.items() if r[0] in have}
    new = missing_flags(have) | ratios(usable) | thresholds(tests)
    if have:
        new["clinical_all_missing"] = reduce(Column.__and__, [F.col(c).isNull() for c in have]).cast("int")
    made = thresholds(tests)
    sums = {n: reduce(Column.__add__, [made[p] for p in parts]) for n, parts in scores.items() if set(parts) <= set(made)}
    new |= sums
    new |= {n: flag(sums[s] >= least) for n, (s, least) in score_flags.items() if s in sums}
    return df.withColumns(new | log_columns([c for c in logs or [] if c in have]))


def formula(text: str) -> tuple[str, Column]:
    """A column from `A/B`, `A-B`, `A+B`, `A*B`, `A<B` or `logA` over plain column names; the name is the formula."""
    if m := re.fullmatch(r"log(\w+)", text):
        return text, F.when(F.col(m[1]) > -1, F.log1p(F.col(m[1])))
    m = re.fullmatch(r"(\w+)([-+*/<])(\w+)", text)
    if not m:
        raise ValueError(f"not a formula: {text}")
    a, b = F.col(m[1]), F.col(m[3])
    return text, {"/": F.try_divide(a, b), "-": a - b, "+": a + b, "*": a * b, "<": flag(a < b)}[m[2]]


def formulas(df: DataFrame, texts: list[str]) -> DataFrame:
    """Formula columns added; a column that a formula takes the logarithm of goes."""
    out = df.withColumns(dict(formula(t) for t in texts))
    return out.drop(*[t[3:] for t in texts if t.startswith("log")])


def percent_of(total: str, percent: str) -> Column:
    """A cell count from a total and its percentage."""
    return F.col(total) * F.col(percent) / F.lit(100.0)

"""Fitted transformers. fit() is an aggregation whose result has the size of the schema; transform() is one projection."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import flag
from tidewell.operators.ordered import long_quantiles, prefix_sums
from tidewell.operators.risk import added_up, matrix


#: Rows up to which one aggregation may hold a column's distinct values; larger tables take running counts instead, with equal results.
IN_ONE = 1_000_000


def quantiles(df: DataFrame, columns: list[str], at: list[float], exact: bool = True) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of all columns, or approximate ones (a fixed sketch) on request."""
    if not columns:
        return {}
    probs = F.array(*[F.lit(float(p)) for p in at])
    if exact and df.count() > IN_ONE:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
        return long_quantiles(long, "value", at, "feature")
    row = df.agg(*[(F.percentile(F.col(c), probs) if exact else F.percentile_approx(c, probs, 10_000)).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None and row[c][0] is not None}


@dataclass
class ClipModel:
    limits: dict[str, list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in self.limits.items()})


def fit_clip(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, exact: bool = True) -> ClipModel:
    return ClipModel(quantiles(df, columns, [lower, upper], exact))


@dataclass
class ImputeModel:
    values: dict[str, float | str]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.values.items()})


def fit_median(df: DataFrame, columns: list[str]) -> ImputeModel:
    """Medians; a column without any value gets 0."""
    found = quantiles(df, columns, [0.5])
    return ImputeModel({c: found.get(c, [0.0])[0] for c in columns})


def constant(columns: list[str], value: float | str) -> ImputeModel:
    return ImputeModel(dict.fromkeys(columns, value))


@dataclass
class ScaleModel:
    center: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.center.items()})


def fit_robust(df: DataFrame, columns: list[str]) -> ScaleModel:
    """(x - median) / interquartile range; a range of 0 counts as 1."""
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    return ScaleModel({c: v[1] for c, v in q.items()}, {c: (v[2] - v[0]) or 1.0 for c, v in q.items()})


def fit_standard(df: DataFrame, columns: list[str]) -> ScaleModel:
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    have = [c for c in columns if row[f"m_{c}"] is not None]
    return ScaleModel({c: row[f"m_{c}"] for c in have}, {c: row[f"s_{c}"] or 1.0 for c in have})


@dataclass
class OneHotModel:
    values: dict[str, list[str]]

    def transform(self, df: DataFrame, keep: bool = False) -> DataFrame:
        out = df.withColumns({f"{c}_{v}": flag(F.col(c) == v) for c, vs in self.values.items() for v in vs})
        return out if keep else out.drop(*self.values)


def fit_one_hot(df: DataFrame, columns: list[str], most: int = 1000) -> OneHotModel:
    """Values of each column, sorted; unseen ones later set no flag. More than `most` values are an error and not a silent cut."""
    found = {}
    for c in columns:
        rows = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{c} has more than {most} values; group the rare ones first")
        found[c] = sorted(r[0] for r in rows)
    return OneHotModel(found)


def group_rare(df: DataFrame, column: str, fit_on: DataFrame, least: int, other: str, out: str | None = None) -> DataFrame:
    """Values with fewer than `least` rows in the fitting table (or none) become `other`; missing ones, too."""
    common = fit_on.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("_v")
    joined = df.join(common, df[column] == common["_v"], "left")
    return joined.withColumn(out or column, F.coalesce("_v", F.lit(other))).drop("_v")


def crosstab_rare(df: DataFrame, key: str, column: str, least: int, rare: str) -> DataFrame:
    """Counts by key and value, rare values merged."""
    return group_rare(df, column, df, least, rare, "value").groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class PreprocessModel:
    """Continuous: clip, impute, scale. Binary: 0. Count and ordinal: median. Categorical: 'Unknown' and one-hot."""

    clip: ClipModel
    impute: ImputeModel
    scale: ScaleModel
    rest: ImputeModel
    one_hot: OneHotModel
    log: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.one_hot.transform(self.rest.transform(self.scale.transform(self.impute.transform(self.clip.transform(df)))))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> PreprocessModel:
        x = json.loads(text)
        return cls(ClipModel(**x["clip"]), ImputeModel(**x["impute"]), ScaleModel(**x["scale"]), ImputeModel(**x["rest"]), OneHotModel(**x["one_hot"]), x["log"])


def fit_preprocess(df: DataFrame, kinds: dict[str, list[str]]) -> PreprocessModel:
    cont = kinds.get("continuous", [])
    clip = fit_clip(df, cont)
    clipped = clip.transform(df)
    impute = fit_median(clipped, cont)
    scale = fit_robust(impute.transform(clipped), cont)
    rest = fit_median(df, [*kinds.get("count", []), *kinds.get("ordinal", [])]).values | dict.fromkeys(kinds.get("binary", []), 0) | dict.fromkeys(kinds.get("categorical", []), "Unknown")
    filled = ImputeModel(rest).transform(df)
    return PreprocessModel(clip, impute, scale, ImputeModel(rest), fit_one_hot(filled, kinds.get("categorical", [])))


def preprocessed_by(df: DataFrame, cohort: str, kinds: dict[str, list[str]]) -> tuple[DataFrame, dict[str, PreprocessModel]]:
    """Each cohort preprocessed by a model of its own, and the models by cohort; columns that only some cohorts have come out NULL elsewhere."""
    names = sorted(r[0] for r in df.select(cohort).distinct().limit(101).collect() if r[0] is not None)
    if len(names) > 100:
        raise ValueError(f"{cohort} has more than 100 values")
    models = {n: fit_preprocess(df.filter(F.col(cohort) == n), kinds) for n in names}
    parts = [m.transform(df.filter(F.col(cohort) == n)) for n, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else df, models


#: Rows of a split that are looked at first, and columns of one aggregation.
FIRST_ROWS, COLUMNS = 4096, 16


def zero_variance(df: DataFrame, columns: list[str], split: str, protected: tuple[str, ...] = ()) -> list[str]:
    """Columns with one distinct value at most (NULL counting as one) in any of the splits.

    A column that varies within some rows varies within all, so the first rows of each split settle most columns; the others are aggregated over all
    rows, few at a time."""
    open_ = [c for c in columns if c not in protected]
    splits = [r[0] for r in df.select(split).distinct().collect()]  # one row for each split
    flat: set[str] = set()
    for s in splits:
        own = df.filter(F.col(split).eqNullSafe(F.lit(s)))
        left = _flat(own.select(*open_).limit(FIRST_ROWS), open_, len(open_))
        flat |= set(_flat(own, left, COLUMNS))
    return [c for c in open_ if c in flat]


def _flat(df: DataFrame, columns: list[str], many: int) -> list[str]:
    """Columns of a table that have one distinct value at most, so many looked at together."""
    varies = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False)) | (F.bool_or(F.col(c).isNull()) & F.bool_or(F.col(c).isNotNull()))
    out = []
    for i in range(0, len(columns), max(many, 1)):
        some = columns[i : i + many]
        row = df.agg(*[varies(c).alias(c) for c in some]).first()
        out += [c for c in some if not row[c]]
    return out


def correlations(df: DataFrame, columns: list[str]) -> tuple[list[str], list[list[float]]]:
    """Pearson matrix of the columns that vary; each pair is taken over the rows that have both (NaN where these don't vary).

    One pass gathers, for all pairs at once, the co-moments of their common rows: four matrix products of the values and of what is present."""
    spread = df.agg(*[(F.max(c) > F.min(c)).alias(f"v{i}") for i, c in enumerate(columns)], *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    usable = [(c, float(spread[f"m{i}"])) for i, c in enumerate(columns) if spread[f"v{i}"]]
    if len(usable) < 2:
        return [c for c, _ in usable], [[1.0]] * len(usable)
    p = len(usable)
    x = F.array(*[F.coalesce(F.col(c).cast("double") - F.lit(m), F.lit(float("nan"))) for c, m in usable])

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((4, p, p))
        for b in batches:
            v = matrix(b)
            have = ~np.isnan(v)
            v, have = np.where(have, v, 0.0), have.astype(float)
            out += np.stack([have.T @ have, v.T @ have, (v * v).T @ have, v.T @ v])
        return out.ravel()

    n, s, q, c = added_up(df.select(x.alias("x")), 4 * p * p, partial).reshape(4, p, p)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread_of = np.maximum(q - s * s / n, 0.0)
        r = np.clip((c - s * s.T / n) / np.sqrt(spread_of * spread_of.T), -1, 1)
    return [c for c, _ in usable], r.tolist()


def correlated_drops(names: list[str], matrix: list[list[float]], limit: float, rules: list[tuple[str, str]] = (), ignored: tuple[str, ...] = (), keep: str = "last") -> list[str]:
    """Which columns to drop: first by priority rules (of a pair, the one that matches `drop` where the other matches `keep`), then of every
    pair that is left above the limit the earlier one (keep='last') or the later one (keep='first')."""
    gone: list[str] = []
    pairs = [(i, j) for j in range(len(names)) for i in range(j) if abs(matrix[i][j]) > limit and not any(names[k].startswith(p) for p in ignored for k in (i, j))]
    for i, j in pairs:
        a, b = names[i], names[j]
        for wanted, unwanted in rules:
            if unwanted == "":
                hit = a.removeprefix(wanted) if b == wanted + a else b if a == wanted + b else None
            else:
                hit = b if wanted in a and unwanted in b else a if wanted in b and unwanted in a else None
            if hit and hit not in gone and not {a, b} & set(gone):
                gone.append(hit)
                break
    for i, j in pairs:
        if keep == "first":  # a column above the limit with any earlier one goes, whether that one goes or not
            if names[j] not in gone:
                gone.append(names[j])
        elif names[i] not in gone and names[j] not in gone:
            gone.append(names[i])
    return gone


def uncorrelated(df: DataFrame, columns: list[str], limit: float, least_variance: float = 0.0) -> list[str]:
    """Columns that stay: a variance not below the floor, and not above the limit of correlation with any earlier such column."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    varied = [c for c in columns if row[c] is not None and row[c] >= least_variance]
    names, matrix = correlations(df, varied)
    gone = set(correlated_drops(names, matrix, limit, keep="first"))
    return [c for c in varied if c not in gone]


def rare_binary(df: DataFrame, columns: list[str], split: str, share: float, protected: tuple[str, ...] = ()) -> list[str]:
    """0/1 columns that are set in less than a share of the rows of any split."""
    rows = df.groupBy(split).agg(*[F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(True))).alias(f"b_{c}") for c in columns], *[F.avg(c).alias(f"m_{c}") for c in columns]).collect()
    return [c for c in columns if c not in protected and all(r[f"b_{c}"] for r in rows) and any((r[f"m_{c}"] or 0.0) < share for r in rows)]


def rare_aggregates(df: DataFrame, specs: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Any or sum over groups of rare columns, before those are dropped."""
    new: dict[str, Column] = {}
    for out, (columns, mode) in specs.items():
        have = [F.coalesce(F.col(c), F.lit(0)) for c in columns if c in df.columns]
        if have:
            total = sum(have[1:], have[0])
            new[out] = total if mode == "sum" else flag(total > 0)
    return df.withColumns(new)


def stratified_split(df: DataFrame, stratum: str, share: float, key: str = "ID", order: Column | None = None) -> DataFrame:
    """`part` = 'test' for the given share of each stratum's rows, in the order of a hash of the key, 'train' for the rest."""
    rows = df.withColumn("_o", order if order is not None else F.xxhash64(key))
    place = prefix_sums(rows, "_o", {"_n": F.lit(1)}, (stratum,)).select(F.col(stratum).alias("_s"), F.col("_o").alias("_oo"), "_n_before")
    sizes = rows.groupBy(F.col(stratum).alias("_z")).agg(F.count(F.lit(1)).alias("_all"))
    out = rows.join(place, (F.col(stratum) == F.col("_s")) & (F.col("_o") == F.col("_oo"))).join(sizes, F.col(stratum) == F.col("_z"))
    return out.select(*df.columns, F.when(F.col("_n_before") < F.floor(F.col("_all") * share), "test").otherwise("train").alias("part"))

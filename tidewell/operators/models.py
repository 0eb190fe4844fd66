"""Survival models, imputation by models, and trials. All sums run on executors; the driver solves systems of the number of features."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.fitted import quantiles
from tidewell.operators.neighbours import knn_impute  # noqa: F401
from tidewell.operators.ordered import average_ranks, prefix_sums, settle
from tidewell.operators.risk import EVENT, TIME, Fit, Fitted, RiskTable, added_up, boosted_lines, fit_all, matrix, penalty_path, risk_table
from tidewell.operators.survival import concordance, k_folds
from tidewell.operators.trees import Growth, TreeRisk, fit_boosted, fit_forests


def _linear(features: list[str], beta: np.ndarray) -> Column:
    return sum((F.col(c) * F.lit(float(b)) for c, b in zip(features, beta, strict=True)), F.lit(0.0))


@dataclass
class LinearRisk:
    """A model that scores by a weighted sum."""

    features: list[str]
    beta: list[float]
    center: list[float] = field(default_factory=list)

    def score(self) -> Column:
        shift = sum(b * m for b, m in zip(self.beta, self.center or [0.0] * len(self.beta), strict=True))
        return _linear(self.features, np.array(self.beta)) - F.lit(float(shift))

    def transform(self, df: DataFrame, out: str = "risk") -> DataFrame:
        return df.withColumn(out, self.score())

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> LinearRisk:
        return cls(**json.loads(text))


def _risk(table: RiskTable, found: Fitted) -> LinearRisk:
    return LinearRisk(table.features, found.beta.tolist(), found.center.tolist())


# Fitters take rows with a fold column (or None), the folds to leave out (-1: none) and any number of parameter rows, and return the models by
# parameter row and fold. Those of linear models advance together, in the same passes over the rows.


def cox_models(df: DataFrame, features: list[str], folds: list[int], fold: Column | None, key: str | None, params: list[dict]) -> list[list[LinearRisk]]:
    """Cox regression with a ridge penalty `alpha` on standardised coefficients."""
    table = risk_table(df, features, fold, key)
    found = fit_all(table, [Fit(f, 0.0, p.get("alpha", 0.01)) for p in params for f in folds])
    return [[_risk(table, found[i * len(folds) + j]) for j in range(len(folds))] for i in range(len(params))]


def coxnet_models(df: DataFrame, features: list[str], folds: list[int], fold: Column | None, key: str | None, params: list[dict]) -> list[list[LinearRisk]]:
    """The elastic net at one penalty for each row, `penalty` being a share of the smallest one at which all coefficients are zero."""
    table = risk_table(df, features, fold, key)
    fits = [penalty_path(table, p.get("mixing", 0.95), 2, p.get("penalty", 0.1), f)[-1] for p in params for f in folds]
    found = fit_all(table, fits)
    return [[_risk(table, found[i * len(folds) + j]) for j in range(len(folds))] for i in range(len(params))]


def componentwise_models(df: DataFrame, features: list[str], folds: list[int], fold: Column | None, key: str | None, params: list[dict]) -> list[list[LinearRisk]]:
    """Boosting with one feature's linear term for each round, the one that explains the residuals best."""
    table = risk_table(df, features, fold, key)
    return [[_risk(table, x) for x in boosted_lines(table, [Fit(f) for f in folds], p.get("rounds", 200), p.get("rate", 0.1), p.get("share", 0.7), p.get("seed", 42))] for p in params]


def boosting_models(df: DataFrame, features: list[str], folds: list[int], fold: Column | None, key: str | None, params: list[dict]) -> list[list[TreeRisk]]:
    """Gradient boosting of the Cox loss by trees with Newton steps, each grown on a share of the rows."""
    of = lambda p: {"rounds": 200, "depth": 3, "rate": 0.1, "share": 0.7, "leaf": 20, "seed": 42} | p
    return [fit_boosted(df, features, folds, fold, **of(p), key=key) for p in params]


def forest_models(df: DataFrame, features: list[str], folds: list[int], fold: Column | None, key: str | None, params: list[dict]) -> list[list[TreeRisk]]:
    """A survival forest with log-rank splits; a node looks at the square root of the number of features."""
    looks = max(1, int(len(features) ** 0.5))
    of = lambda p: Growth(**({"looks": looks} | {k: v for k, v in p.items() if k != "trees"}))
    return [fit_forests(df, features, folds, fold, p.get("trees", 400), of(p), key) for p in params]


FITTERS = {"cox": cox_models, "coxnet": coxnet_models, "componentwise": componentwise_models, "boosting": boosting_models, "forest": forest_models}


def fit(kind: str, df: DataFrame, features: list[str], key: str | None = None, **params) -> LinearRisk | TreeRisk:
    """One model of all rows."""
    return FITTERS[kind](df, features, [-1], None, key, [params])[0][0]


def fit_cox(df: DataFrame, features: list[str], alpha: float = 0.01) -> LinearRisk:
    return fit("cox", df, features, alpha=alpha)


def fit_coxnet(df: DataFrame, features: list[str], mixing: float = 0.95, path: int = 100, least: float = 0.01) -> list[tuple[float, LinearRisk]]:
    """The elastic-net path: models by falling penalty (for each row), all fitted to the optimality conditions in the same passes."""
    table = risk_table(df, features)
    found = fit_all(table, penalty_path(table, mixing, path, least))
    return [(f.fit.lasso / mixing / max(table.n[-1], 1), _risk(table, f)) for f in found]


def cox_residuals(df: DataFrame, score: str = "risk") -> DataFrame:
    """df with `residual`: event - exp(score) x cumulative hazard at the row's time, the negative gradient of the Cox loss."""
    w = F.exp(F.least(F.col(score), F.lit(50.0)))
    sums = prefix_sums(df.select(TIME, EVENT, score), TIME, {"_d": F.col(EVENT).cast("double"), "_s0": w}, descending=True)
    rate = settle(sums.select(TIME, (F.col("_d") / (F.col("_s0") + F.col("_s0_before"))).alias("_r")))
    hazard = prefix_sums(rate, TIME, {"_h": F.col("_r")}).select(F.col(TIME).alias("_t"), (F.col("_h") + F.col("_h_before")).alias("_hz"))
    return df.join(hazard, df[TIME] == hazard["_t"]).withColumn("residual", F.col(EVENT) - w * F.col("_hz")).drop("_t", "_hz")


def _scored(rows: DataFrame, found: dict[str, list], folds: list[int], keep: list[str]) -> DataFrame:
    """(`keep`, fold, model, pred) of each fold's rows by the models that left it out; all linear models score in one scan of the rows."""
    linear = {name: ms for name, ms in found.items() if all(isinstance(m, LinearRisk) for m in ms)}
    parts = []
    if linear:
        pred = {name: reduce(lambda c, fm: c.when(F.col("fold") == fm[0], fm[1].score()), zip(folds, ms, strict=True), F) for name, ms in linear.items()}
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), p.cast("double").alias("pred")) for name, p in pred.items()])).alias("_m")
        parts.append(rows.filter(F.col("fold").isin(folds)).select(*keep, "fold", each).select(*keep, "fold", "_m.*"))
    for name in found.keys() - linear.keys():
        parts += [m.transform(rows.filter(F.col("fold") == f), "pred").select(*keep, "fold", F.lit(name).alias("model"), F.col("pred").cast("double").alias("pred")) for f, m in zip(folds, found[name], strict=True)]
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(df: DataFrame, features: list[str], models: dict[str, dict], folds: int = 5, key: str = "ID", seed: int = 42) -> DataFrame:
    """(key, fold, model, pred): each row scored by models that were fitted without its fold. The folds of a model advance in the same passes, and so do
    all models of one linear kind. A fit that fails is an error."""
    rows, every = settle(k_folds(df, folds, seed, key)), list(range(folds))
    parts = []
    for kind in dict.fromkeys(p.get("kind", name) for name, p in models.items()):
        same = {name: {k: v for k, v in p.items() if k != "kind"} for name, p in models.items() if p.get("kind", name) == kind}
        found = FITTERS[kind](rows, features, every, F.col("fold"), key, list(same.values()))
        parts.append(_scored(rows, dict(zip(same, found, strict=True)), every, [key]))
    return settle(reduce(DataFrame.unionByName, parts))


def fold_scores(oof: DataFrame, target: DataFrame, tau: float | None = 7.0, key: str = "ID") -> DataFrame:
    """(model, fold, score) by censoring-weighted concordance; the target is joined to predictions that come without it."""
    return concordance(oof if {TIME, EVENT} <= set(oof.columns) else oof.join(target, key), "pred", train=target, tau=tau, by=("model", "fold")).select("model", "fold", F.col("c_index").alias("score"))


def fit_stacking(oof: DataFrame, target: DataFrame, models: list[str], key: str = "ID", alpha: float = 0.1) -> LinearRisk:
    """A Cox model on the out-of-fold predictions of the base models."""
    wide = oof.groupBy(key).agg(*[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models])
    return fit_cox(wide.na.drop().join(target, key), models, alpha)


def trials(space: dict[str, list], done: DataFrame | None, spark, most: int | None = None) -> DataFrame:
    """Parameter rows (trial id, params as JSON) of a grid that a log of finished trials doesn't have yet."""
    rows = [json.dumps(dict(zip(space, v, strict=True)), sort_keys=True) for v in product(*space.values())][:most]
    table = spark.createDataFrame([(r,) for r in rows], "params string").select(F.sha2("params", 256).substr(1, 16).alias("trial"), "params")
    return table.join(done.select("trial"), "trial", "left_anti") if done is not None else table


def run_trials(df: DataFrame, features: list[str], kind: str, space: dict[str, list], log: DataFrame | None = None, folds: int = 5, tau: float | None = 7.0, most: int | None = None, key: str = "ID", halving: bool = False) -> DataFrame:
    """(trial, params, fold, score): every parameter row of the grid that the log lacks is fitted and scored out of fold; rows of the log stay.

    All open trials of a linear kind are fitted on all folds in the same passes, and all are scored by one concordance. With halving, trials are first
    scored on one fold, the better half of them on another, and so on; the log then has fewer folds of the others."""
    rows = settle(k_folds(df, folds, 42, key))
    open_ = [(r["trial"], r["params"]) for r in trials(space, log, df.sparkSession, most).orderBy("params").collect()]  # one row for each trial
    target, done, left = df.select(key, TIME, EVENT), [log] if log is not None else [], list(range(folds))
    names = df.sparkSession.createDataFrame(open_, "trial string, params string") if open_ else None
    while open_ and left:
        now, left = (left[:1], left[1:]) if halving and len(open_) > 1 else (left, [])
        found = FITTERS[kind](rows, features, now, F.col("fold"), key, [json.loads(p) for _, p in open_])
        oof = _scored(rows, {trial: m for (trial, _), m in zip(open_, found, strict=True)}, now, [TIME, EVENT])
        score = settle(fold_scores(oof, target, tau, key).withColumnRenamed("model", "trial").join(F.broadcast(names), "trial").select("trial", "params", "fold", "score"))
        done.append(score)
        if left:
            so_far = reduce(DataFrame.unionByName, done[1 if log is not None else 0 :])
            best = {r["trial"] for r in best_trial(so_far.join(F.broadcast(df.sparkSession.createDataFrame(open_, "trial string, params string").select("trial")), "trial")).limit(-(-len(open_) // 2)).collect()}
            open_ = [t for t in open_ if t[0] in best]
    return reduce(DataFrame.unionByName, done) if done else df.sparkSession.createDataFrame([], "trial string, params string, fold int, score double")


def retrained_without(df: DataFrame, outliers: DataFrame, features: list[str], models: dict[str, dict], folds: int = 5, tau: float | None = 7.0, key: str = "ID") -> DataFrame:
    """(model, fold, score) of out-of-fold fits on the rows that aren't among the outliers."""
    rows = settle(df.join(outliers.select(key), key, "left_anti"))
    return fold_scores(out_of_fold(rows, features, models, folds, key), rows.select(key, TIME, EVENT), tau, key)


def best_trial(log: DataFrame) -> DataFrame:
    """trial, params, mean score and folds, the best first."""
    return log.groupBy("trial", "params").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("folds")).orderBy(F.desc("mean_score"), "trial")


def importances(model: TreeRisk, spark, k: int = 20) -> DataFrame:
    """The k features with the largest share of what splits gained."""
    rows = sorted(zip(model.features, map(float, model.gains), strict=True), key=lambda x: (-x[1], x[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def coefficients(model: LinearRisk, spark, k: int = 20) -> DataFrame:
    """The k coefficients of a linear model that are largest in size."""
    rows = sorted(zip(model.features, map(float, model.beta), map(abs, map(float, model.beta)), strict=True), key=lambda x: (-x[2], x[0]))[:k]
    return spark.createDataFrame(rows, "feature string, coefficient double, magnitude double")


def save_models(models: dict[str, LinearRisk | TreeRisk], path: str, spark) -> None:
    """Models by name as one table at the path, in place of models of the same names; the others stay."""
    made = {"LinearRisk": LinearRisk, "TreeRisk": TreeRisk}
    rows = [(n, next(k for k, c in made.items() if isinstance(m, c)), m.to_json()) for n, m in models.items()]
    spark.createDataFrame(rows, "name string, class string, model string").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("name").parquet(path)


def load_models(path: str, spark, names: list[str] | None = None) -> dict[str, LinearRisk | TreeRisk]:
    """The named models (or all) of a table; a name that it lacks is an error."""
    rows = spark.read.schema("class string, model string, name string").parquet(path)
    found = {r["name"]: (TreeRisk if r["class"] == "TreeRisk" else LinearRisk).from_json(r["model"]) for r in (rows if names is None else rows.filter(F.col("name").isin(names))).collect()}
    if missing := set(names or ()) - set(found):
        raise KeyError(f"no saved model {', '.join(sorted(missing))}")
    return dict(sorted(found.items()))


def scored_by(df: DataFrame, models: dict[str, LinearRisk | TreeRisk], key: str = "ID") -> DataFrame:
    """(key, risk_score): the mean over models of the rank that each gives a row."""
    for i, m in enumerate(models.values()):
        df = m.transform(df, f"_m{i}")
    rows = settle(df.select(key, *[f"_m{i}" for i in range(len(models))]))
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"_m{i}").alias("pred")) for i in range(len(models))])).alias("m")).select(key, "m.*")
    return average_ranks(long, "pred", by=("model",)).groupBy(key).agg(F.avg("rank").alias("risk_score"))


# imputation by models


def bayesian_ridge(gram: np.ndarray, tolerance: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and intercept of a regression whose noise and weight precisions maximise the evidence. gram: sums of products of the predictors, the
    target and 1, in that order, which is all that the rows are needed for: each step works on the eigenvalues of the centred predictors."""
    n, p = gram[-1, -1], len(gram) - 2
    mean = gram[-1, :-1] / max(n, 1)
    centred = gram[:-1, :-1] - n * np.outer(mean, mean)
    xx, xy, yy = centred[:p, :p], centred[:p, p], centred[p, p]
    values, vectors = np.linalg.eigh(xx)
    values, turned, beta = np.maximum(values, 0), vectors.T @ xy, np.zeros(p)
    noise, weight, prior = n / max(yy, 1e-12), 1.0, 1e-6
    for _ in range(rounds):
        before, beta = beta, vectors @ (turned / (values + weight / noise))
        left = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
        used = (noise * values / (weight + noise * values)).sum()
        weight, noise = (used + 2 * prior) / (beta @ beta + 2 * prior), (n - used + 2 * prior) / (left + 2 * prior)
        if np.abs(beta - before).sum() < tolerance * max(np.abs(beta).sum(), 1e-12):
            break
    return np.append(beta, mean[p] - mean[:p] @ beta)


def _by_regression(work: DataFrame, others: list[str], target: str, alpha: float | None) -> Column:
    """The prediction of a column with gaps: Bayesian ridge, or a ridge of fixed share alpha."""
    x = F.array(*[F.col(c).cast("double") for c in (*others, target)], F.lit(1.0))
    m = len(others) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((m, m))
        for b in batches:
            v = matrix(b)
            out += v.T @ v if len(v) else 0.0
        return out.ravel()

    gram = added_up(work.filter(~F.col(f"_miss_{target}")).select(x.alias("x")), m * m, partial).reshape(m, m)
    if alpha is None:
        beta = bayesian_ridge(gram)
    else:
        keep = [*range(m - 2), m - 1]
        own = gram[np.ix_(keep, keep)]
        beta = np.linalg.solve(own + alpha * np.diag([*(np.diag(own)[:-1] + 1e-9), 1e-9]), gram[keep, m - 2])
    return _linear(others, beta[:-1]) + F.lit(float(beta[-1]))


#: Tree models that may predict a column with gaps.
TREE_IMPUTERS = {
    "forest": lambda label: RandomForestRegressor(featuresCol="_x", labelCol=label, predictionCol="_guess", numTrees=50, maxDepth=8, seed=42),
    "boosting": lambda label: GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="_guess", maxIter=30, maxDepth=4, seed=42),
}


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = 100, tolerance: float = 1e-3, model: str = "bayes", alpha: float = 1e-3) -> DataFrame:
    """Chained equations: from medians on, each column with gaps is predicted from the others, round by round, until no imputed value moves by more than
    the tolerance (in deviations of its column) or the rounds are over.

    model: bayes (Bayesian ridge), ridge (of a fixed share alpha), forest or boosting. A step of a regression is one pass over the rows."""
    if model not in ("bayes", "ridge", *TREE_IMPUTERS):
        raise ValueError(f"no model {model}; there are bayes, ridge, {', '.join(TREE_IMPUTERS)}")
    medians = quantiles(df, columns, [0.5])
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    order = sorted((c for c in columns if gaps[c]), key=lambda c: (gaps[c], c))
    work = df.withColumns({f"_miss_{c}": F.col(c).isNull() for c in columns}).withColumns({c: F.coalesce(F.col(c), F.lit(float(medians.get(c, [0.0])[0]))) for c in columns})
    work = settle(work)
    spread = work.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    for _ in range(rounds):
        change = 0.0
        for target in order:
            others = [c for c in columns if c != target]
            if model in TREE_IMPUTERS:
                rows = VectorAssembler(inputCols=others, outputCol="_x").transform(work)
                new = TREE_IMPUTERS[model](target).fit(rows.filter(~F.col(f"_miss_{target}"))).transform(rows).drop("_x")
            else:
                new = work.withColumn("_guess", _by_regression(work, others, target, alpha if model == "ridge" else None))
            new = new.withColumn("_new", F.when(F.col(f"_miss_{target}"), F.col("_guess")).otherwise(F.col(target)))
            moved = new.agg(F.max(F.abs(F.col("_new") - F.col(target)))).first()[0] or 0.0
            change = max(change, moved / (spread[target] or 1.0))
            work = new.withColumn(target, F.col("_new")).drop("_new", "_guess")
        work = settle(work)
        if change < tolerance:
            break
    return work.drop(*[f"_miss_{c}" for c in columns])


def supervised_impute(df: DataFrame, target: str, features: list[str], least_rows: int = 50, cap: str | None = None, upper: float = 0.995, seed: int = 42) -> DataFrame:
    """Gaps of one non-negative column predicted by boosted trees on log1p of the observed rows, kept at or above 0, at or below `cap`, and
    below a high quantile of the predictions; `<target>_imputed` says where. Too few observed rows leave the table as it is."""
    mark = df.withColumn(f"{target}_imputed", F.col(target).isNull().cast("int"))
    medians = quantiles(df, features, [0.5])
    filled = mark.select("*", *[F.coalesce(F.col(c), F.lit(float(medians.get(c, [0.0])[0]))).alias(f"_f_{c}") for c in features])
    rows = settle(VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_x").transform(filled).drop(*[f"_f_{c}" for c in features]))
    seen = rows.filter(F.col(target).isNotNull())
    if seen.count() < least_rows:
        return mark.withColumn(f"{target}_imputed", F.lit(0))
    model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=10, maxDepth=3, seed=seed, predictionCol="_p").fit(seen.withColumn("_y", F.log1p(F.col(target))))
    out = model.transform(rows).withColumn("_p", F.greatest(F.expm1("_p"), F.lit(0.0)))
    limit = quantiles(out.filter(F.col(target).isNull()), ["_p"], [upper]).get("_p", [None])[0]
    guess = F.least(F.col("_p"), F.lit(float(limit))) if limit is not None else F.col("_p")
    if cap:
        guess = F.least(guess, F.coalesce(F.col(cap), guess))
    return out.withColumn(target, F.coalesce(F.col(target), guess)).select(*mark.columns)


def baseline(clinical: DataFrame, mutation_rows: DataFrame, target: DataFrame, columns: tuple[str, ...] = ("BM_BLAST", "HB", "PLT"), key: str = "ID") -> DataFrame:
    """key, the columns filled by medians, the number of mutations, and the target: what the naive model is fitted on."""
    from tidewell.operators.fitted import fit_median

    n = mutation_rows.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n_mut"))
    rows = clinical.select(key, *columns).join(n, key, "left").na.fill(0.0, subset=["n_mut"]).join(target, key)
    return fit_median(rows, list(columns)).transform(rows)


def impute_class(df: DataFrame, target: str, features: list[str], unknown: float = 0.5, trees: int = 20, seed: int = 42) -> DataFrame:
    """Rows whose 0/1 column has the `unknown` mark get the class that a forest fitted on the known rows predicts."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.na.fill(0.0, subset=features))
    known = rows.filter(F.col(target).isin(0.0, 1.0))
    if known.select(target).distinct().count() < 2:
        return df
    model = RandomForestClassifier(featuresCol="_x", labelCol=target, predictionCol="_p", probabilityCol="_q", rawPredictionCol="_r", numTrees=trees, seed=seed).fit(known)
    out = model.transform(rows).withColumn(target, F.when(F.col(target) == unknown, F.col("_p")).otherwise(F.col(target)))
    return out.select(*df.columns)


def early_impute(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]], auxiliary: list[str] = (), rounds: int = 100) -> DataFrame:
    """Chained equations with auxiliary columns as predictors, imputed values kept within their ranges."""
    filled = iterative_impute(df, [*columns, *auxiliary], rounds)
    return filled.withColumns({c: F.least(F.greatest(F.col(c), F.lit(float(lo))), F.lit(float(hi))) for c, (lo, hi) in ranges.items() if c in columns})

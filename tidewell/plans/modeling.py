"""Queries that fit models; SQL can't express them, so their tests compare with brute force or with what they have to recover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import clean, models
from tidewell.operators.ordered import settle, shared_path
from tidewell.plans.features import _clinical, _round
from tidewell.plans.fixtures import oracle, view

FEATURES = ["BM_BLAST", "HB", "PLT", "n_mut"]


def _baseline(spark: SparkSession, d: str) -> DataFrame:
    return models.baseline(_clinical(spark, d), view(spark, d, "fx_molecular"), clean.clean_target(view(spark, d, "fx_target")))


def baseline_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(_baseline(spark, d))


def cox_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_baseline(spark, d))
    return models.fit_cox(rows, FEATURES).transform(rows).select("ID", F.round("risk", 5).alias("risk"))


def coxnet_path(spark: SparkSession, d: str) -> DataFrame:
    path = models.fit_coxnet(_baseline(spark, d), FEATURES)
    return spark.createDataFrame([(float(lam), f, float(b)) for lam, m in path for f, b in zip(m.features, m.beta, strict=True)], "penalty double, feature string, beta double")


def boost_linear(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_baseline(spark, d))
    return models.fit("componentwise", rows, FEATURES, "ID").transform(rows).select("ID", F.round("risk", 5).alias("risk"))


def boost_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = settle(_baseline(spark, d))
    return models.fit("boosting", rows, FEATURES, "ID").transform(rows).select("ID", "risk")


def survival_forest(spark: SparkSession, d: str) -> DataFrame:
    """400 trees of depth 15."""
    rows = settle(_baseline(spark, d))
    return models.fit("forest", rows, FEATURES, "ID").transform(rows).select("ID", "risk")


def oof_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fold scores of a Cox model, an elastic net and a forest; 80 trees for each fold, 400 in all."""
    rows = settle(_baseline(spark, d))
    oof = models.out_of_fold(rows, FEATURES, {"cox": {}, "coxnet": {}, "forest": {"trees": 80}})
    return models.fold_scores(oof, rows.select("ID", "OS_YEARS", "OS_STATUS"))


def iterative_impute(spark: SparkSession, d: str) -> DataFrame:
    return models.iterative_impute(_clinical(spark, d).select("ID", "BM_BLAST", "WBC", "ANC", "HB", "PLT"), ["BM_BLAST", "WBC", "ANC", "HB", "PLT"])


def knn_impute(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of three embedding-like columns by their nearest rows."""
    e = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("ID"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("a"), (F.col("c_custkey") % 13).cast("double").alias("b"), F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 29).cast("double")).alias("c"))
    return _round(models.knn_impute(e, ["a", "b", "c"]))


def supervised_impute(spark: SparkSession, d: str) -> DataFrame:
    rows = _clinical(spark, d).select("ID", "BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT")
    return models.supervised_impute(rows, "MONOCYTES", ["WBC", "ANC", "HB", "PLT", "BM_BLAST"], cap="WBC")


def trial_search(spark: SparkSession, d: str) -> DataFrame:
    """A grid of ridge penalties, each fitted and scored out of fold, the best first."""
    space = {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 3000.0, 10000.0]}
    return _round(models.best_trial(models.run_trials(settle(_baseline(spark, d)), FEATURES, "cox", space)), 5)


def retrained_scores(spark: SparkSession, d: str) -> DataFrame:
    """Fold scores of a Cox model without the 50 patients that the given scores miss most."""
    from tidewell.plans.ranking import outlier_ids

    return _round(models.retrained_without(_baseline(spark, d), outlier_ids(spark, d), FEATURES, {"cox": {}}), 5)


def stacked_scores(spark: SparkSession, d: str) -> DataFrame:
    """A Cox model on the three given scores."""
    from tidewell.operators.survival import long_scores

    target = clean.clean_target(view(spark, d, "fx_target"))
    oof = long_scores(view(spark, d, "fx_scores"), ["m_a", "m_b", "m_c"])
    wide = view(spark, d, "fx_scores")
    return models.fit_stacking(oof, target, ["m_a", "m_b", "m_c"]).transform(wide).select("ID", F.round("risk", 5).alias("risk"))


def forest_importances(spark: SparkSession, d: str) -> DataFrame:
    return _round(models.importances(models.fit("forest", settle(_baseline(spark, d)), FEATURES, "ID"), spark))


def cox_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return _round(models.coefficients(models.fit_cox(settle(_baseline(spark, d)), FEATURES), spark))


def saved_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean ranks by two saved models that are chosen by name."""
    rows, at = settle(_baseline(spark, d)), shared_path(spark, "models")
    models.save_models({"ridge": models.fit_cox(rows, FEATURES, 10.0), "net": models.fit("coxnet", rows, FEATURES), "other": models.fit_cox(rows, FEATURES[:2])}, at, spark)
    return _round(models.scored_by(rows, models.load_models(at, spark, ["ridge", "net"])), 5)


QUERIES = {f.__name__: f for f in (baseline_features, cox_fit, coxnet_path, boost_linear, boost_tree, survival_forest, oof_scores, iterative_impute, knn_impute, supervised_impute, trial_search, retrained_scores, stacked_scores, forest_importances, cox_coefficients, saved_model_scores)}

_R = "r AS (SELECT ID, " + ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in {"BM_BLAST": (0, 100), "HB": (2, 25), "PLT": (0, 3000)}.items()) + " FROM fx_clinical)"

#: The donors of each gap in order; common columns are counted by hand, as b is always there.
_KNN = """WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS ID, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS a, CAST(c_custkey % 13 AS DOUBLE) AS b,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 29 AS DOUBLE) END AS c FROM customer),
  p AS (SELECT r.ID, 'a' AS col, q.a AS v, ((r.b - q.b) * (r.b - q.b) + coalesce((r.c - q.c) * (r.c - q.c), 0)) * 3 / (1 + (r.c IS NOT NULL AND q.c IS NOT NULL)::INT) AS d
      FROM e r JOIN e q ON r.a IS NULL AND q.a IS NOT NULL
    UNION ALL SELECT r.ID, 'c', q.c, (coalesce((r.a - q.a) * (r.a - q.a), 0) + (r.b - q.b) * (r.b - q.b)) * 3 / (1 + (r.a IS NOT NULL AND q.a IS NOT NULL)::INT)
      FROM e r JOIN e q ON r.c IS NULL AND q.c IS NOT NULL),
  k AS (SELECT ID, avg(v) FILTER (col = 'a') AS a, avg(v) FILTER (col = 'c') AS c FROM (SELECT *, row_number() OVER (PARTITION BY ID, col ORDER BY d, v) AS nth FROM p) WHERE nth <= 4 GROUP BY ID)
  SELECT ID, round(coalesce(e.a, k.a), 6) AS a, b, round(coalesce(e.c, k.c), 6) AS c FROM e LEFT JOIN k USING (ID)"""
ORACLES = {
    "knn_impute": _KNN,
    "baseline_features": oracle(f"WITH {_R}, j AS (SELECT r.*, OS_YEARS, OS_STATUS, coalesce(n, 0)::DOUBLE AS n_mut FROM r JOIN fx_target t USING (ID) LEFT JOIN (SELECT ID, count(*) AS n FROM fx_molecular GROUP BY ID) m USING (ID) WHERE OS_YEARS > 0 AND OS_STATUS IS NOT NULL), q AS (SELECT median(BM_BLAST) AS a, median(HB) AS b, median(PLT) AS c FROM j) SELECT ID, coalesce(BM_BLAST, a) AS BM_BLAST, coalesce(HB, b) AS HB, coalesce(PLT, c) AS PLT, n_mut, OS_YEARS, OS_STATUS FROM j, q", "fx_clinical", "fx_target", "fx_molecular"),
}

"""Queries of fitted transformers and of drift and quality reports."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import config as C
from tidewell.operators import clean, drift, fitted
from tidewell.plans.features import _RANGED, _clinical, _round
from tidewell.plans.fixtures import SHUFFLED, oracle, view

_NUM = C.MEASURES


def _test() -> Column:
    return F.expr(_SQL_TEST)


_SQL_TEST = "CAST(substr(ID, 2) AS BIGINT) % 4 = 0"


def clip_quantiles(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return _round(fitted.fit_clip(c, _NUM).transform(c))


def impute_median(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return _round(fitted.fit_median(c.filter(~_test()), _NUM).transform(c))


def robust_scale(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return _round(fitted.fit_robust(c, _NUM).transform(c))


def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return _round(fitted.fit_standard(c, _NUM).transform(c))


def rare_category_grouping(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "fx_clinical").select("ID", "CENTER")
    return fitted.group_rare(c, "CENTER", c.filter(~_test()), C.RARE_CENTER, C.OTHER_CENTER, "CENTER_GROUP")


def one_hot(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular").select("ID", "EFFECT")
    return fitted.fit_one_hot(m, ["EFFECT"]).transform(m).distinct()


def rare_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return fitted.crosstab_rare(view(spark, d, "fx_molecular"), "ID", "GENE", 2500, "rare")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    t = clean.clean_target(view(spark, d, "fx_target"))
    return fitted.stratified_split(t, "OS_STATUS", 0.2, order=F.expr(SHUFFLED)).select("ID", "OS_STATUS", "part")


def preprocess_full(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return _round(fitted.fit_preprocess(c, {"continuous": _NUM}).transform(c))


def variable_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "fx_clinical").withColumns({"has_wbc": F.col("WBC").isNotNull().cast("int"), "n_events": F.length("CYTOGENETICS"), "grade": F.col("HB").cast("int")})
    kinds = clean.variable_kinds(c, _NUM)
    return spark.createDataFrame([(k, x) for k, xs in kinds.items() for x in xs], "kind string, feature string")


#: Breadth of what is added to a measure for a chain of columns: neighbours are correlated above 0.9, the ends aren't.
_CHAIN = 5


def _wide(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *_NUM)
    return fitted.fit_median(c, _NUM).transform(c).withColumns({"WBC2": F.col("WBC") * 2 + F.col("HB") / 100, "HB2": F.col("HB") + F.expr("CAST(substr(ID, 2) AS BIGINT) * 7919 % 1000 / 1000D") * _CHAIN, "HB3": F.col("HB") + F.expr("(CAST(substr(ID, 2) AS BIGINT) * 7919 % 1000 + CAST(substr(ID, 2) AS BIGINT) * 104729 % 1000) / 1000D") * _CHAIN, "zero": F.lit(0.0), "rare": (F.expr("CAST(substr(ID, 2) AS BIGINT) % 997") == 0).cast("int"), "half": F.expr("CAST(substr(ID, 2) AS INT) % 2"), "split": F.when(_test(), "test").otherwise("train")})


def zero_variance_list(spark: SparkSession, d: str) -> DataFrame:
    names = fitted.zero_variance(_wide(spark, d), [*_NUM, "WBC2", "zero", "rare", "half"], "split")
    return spark.createDataFrame([(n,) for n in names], "feature string")


def correlation_prune_list(spark: SparkSession, d: str) -> DataFrame:
    names, m = fitted.correlations(_wide(spark, d), [*_NUM, "WBC2", "zero"])
    return spark.createDataFrame([(n,) for n in fitted.correlated_drops(names, m, C.CORRELATION_LIMIT, C.PRIORITY_RULES, ("CENTER_",))], "feature string")


def uncorrelated_list(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in fitted.uncorrelated(_wide(spark, d), [*_NUM, "WBC2", "HB2", "HB3", "zero"], 0.9, 1e-9)], "feature string")


def rare_binary_list(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in fitted.rare_binary(_wide(spark, d), ["rare", "half", "HB"], "split", C.RARE_SHARE)], "feature string")


def _long(spark: SparkSession, d: str) -> DataFrame:
    return drift.long_values(_clinical(spark, d).select("ID", *_NUM), _NUM, _test())


def ks_drift(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.distances(_long(spark, d)).select("feature", "n_a", "n_b", "ks"))


def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.distances(_long(spark, d)).select("feature", "wasserstein"))


def moment_drift(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.moments(_long(spark, d)))


def prevalence_shift(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).select("ID", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in _NUM])
    return _round(drift.prevalence(drift.long_values(c, [f"{x}_missing" for x in _NUM], _test())))


def js_distance(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.jensen_shannon(view(spark, d, "fx_clinical"), "CENTER", _test()))


def missing_rates(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.missing_rates(_clinical(spark, d), _NUM))


def missing_shift(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.missing_shift(_clinical(spark, d), _NUM, _test()))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return _clinical(spark, d).withColumn("fold", F.expr("CAST((CAST(substr(ID, 2) AS BIGINT) * 7919 + 42) % 104729 % 5 AS INT)"))


def fold_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = _folded(spark, d).withColumn("few", (F.col("PLT") < 100).cast("int"))
    return _round(drift.fold_drift(rows, ["ANC", "HB", "PLT"], center="CENTER", binary=("few",)))


def most_drifted(spark: SparkSession, d: str) -> DataFrame:
    """The measures are tenths, so their drift is told in hundredths of a unit as whole numbers: sums are exact, in whatever order."""
    rows = _folded(spark, d)
    return _round(drift.most_drifted(rows.withColumns({c: F.round(F.col(c) * 100) for c in _NUM}), _NUM, k=4))


def preprocess_by_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Two cohorts, each clipped, filled and scaled by its own quantiles."""
    c = _clinical(spark, d).select("ID", *_NUM, F.when(F.col("CENTER") == "CTR_2", "extra").otherwise("main").alias("cohort"))
    return _round(fitted.preprocessed_by(c, "cohort", {"continuous": _NUM})[0])


def corr_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.correlated_pairs(_wide(spark, d), [*_NUM, "WBC2"], 0.5))


def group_diff(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).withColumn("wbc_missing", F.col("WBC").isNull().cast("int"))
    return _round(drift.group_differences(c, ["ANC", "HB", "PLT", "wbc_missing"], F.col("CENTER") == "CTR_1"))


def sanity_report(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.sanity(_clinical(spark, d), _NUM))


def value_shares(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.value_shares(view(spark, d, "fx_target"), ["OS_STATUS", "OS_YEARS"]))


def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows against the ranges and two rules between columns."""
    c = view(spark, d, "fx_clinical")
    rules = {f"{n} in range": F.col(n).between(float(lo), float(hi)) for n, (lo, hi) in C.RANGES.items()} | {"ANC below WBC": F.col("ANC") <= F.col("WBC"), "normal has no count": ~F.col("CYTOGENETICS").contains("complex") | (F.col("PLT") > 50)}
    return drift.violations(c, rules)


def cohort_means(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d)
    return _round(drift.summaries({"a": c.filter(~_test()), "b": c.filter(_test())}, _NUM))


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _round(drift.spearman_and_pearson(view(spark, d, "fx_scores"), "m_a", "m_c"))


QUERIES = {
    f.__name__: f
    for f in (
        clip_quantiles, impute_median, robust_scale, standard_scale, rare_category_grouping, one_hot, rare_crosstab, stratified_split, preprocess_full, variable_kinds, zero_variance_list, correlation_prune_list,
        uncorrelated_list, rare_binary_list, ks_drift, wasserstein, moment_drift, prevalence_shift, js_distance, missing_rates, missing_shift, fold_drift, most_drifted, preprocess_by_cohort, corr_pairs, group_diff, sanity_report, value_shares,
        rule_violations, cohort_means, spearman,
    )
}

_R = f"WITH r AS ({_RANGED})"
_UNPIVOT = f"{_R}, l AS (UNPIVOT (SELECT ID, {', '.join(_NUM)} FROM r) ON {', '.join(_NUM)} INTO NAME feature VALUE value)"
_CLIP = f"{_R}, q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in _NUM) + " FROM r), c AS (SELECT ID, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, {c}_lo), {c}_hi) END AS {c}" for c in _NUM) + " FROM r, q)"
_ROBUST = "round((({c}) - {c}_m) / CASE WHEN {c}_b = {c}_a THEN 1 ELSE {c}_b - {c}_a END, 6) AS {c}"
_QUARTERS = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_a, median({c}) AS {c}_m, quantile_cont({c}, 0.75) AS {c}_b" for c in _NUM)
_ECDF = f"""{_UNPIVOT}, s AS (SELECT feature, value, {_SQL_TEST} AS b FROM l WHERE value IS NOT NULL), z AS (SELECT feature, count(*) FILTER (NOT b) AS n_a, count(*) FILTER (b) AS n_b FROM s GROUP BY feature),
  v AS (SELECT feature, value, count(*) FILTER (NOT b) AS a, count(*) FILTER (b) AS c FROM s GROUP BY feature, value),
  g AS (SELECT feature, n_a, n_b, abs(sum(a) OVER w * n_b - sum(c) OVER w * n_a) AS gap, n_a * n_b AS unit, lead(value) OVER w - value AS step FROM v JOIN z USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY value))"""
_FOLDS = f"""WITH r AS ({_RANGED}), k AS (SELECT *, CASE WHEN PLT < 100 THEN 1 WHEN PLT >= 100 THEN 0 END::DOUBLE AS few, (CAST(substr(ID, 2) AS BIGINT) * 7919 + 42) % 104729 % 5 AS fold FROM r), o AS (SELECT k.*, f, fold = f AS b FROM k, range(5) t(f))"""
_FOLD_KS = """l AS (UNPIVOT (SELECT f, b, {cols} FROM o) ON {cols} INTO NAME feature VALUE value), z AS (SELECT f, feature, count(*) FILTER (NOT b) AS n_a, count(*) FILTER (b) AS n_b FROM l GROUP BY ALL),
  v AS (SELECT f, feature, value, count(*) FILTER (NOT b) AS a, count(*) FILTER (b) AS c FROM l GROUP BY ALL), g AS (SELECT f, feature, abs(sum(a) OVER w * n_b - sum(c) OVER w * n_a) AS gap, n_a * n_b AS unit, lead(value) OVER w - value AS step FROM v JOIN z USING (f, feature) WINDOW w AS (PARTITION BY f, feature ORDER BY value)),
  ks AS (SELECT f, feature, max(gap) / unit AS ks, sum(gap * step) / unit AS w1 FROM g GROUP BY f, feature, unit)"""


def _own_scale(where: str, cohort: str) -> str:
    """SQL of the clipped, filled and scaled measures of some rows by their own quantiles."""
    r = f"(SELECT * FROM r WHERE {where})"
    clip = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM {r})), (SELECT quantile_cont({c}, 0.99) FROM {r})) END AS {c}" for c in _NUM)
    fill = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in _NUM)
    scale = ", ".join(f"round(({c} - median({c}) OVER ()) / CASE WHEN quantile_cont({c}, 0.75) OVER () = quantile_cont({c}, 0.25) OVER () THEN 1 ELSE quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER () END, 6) AS {c}" for c in _NUM)
    return f"SELECT ID, {scale}, '{cohort}' AS cohort FROM (SELECT ID, {fill} FROM (SELECT ID, {clip} FROM {r}))"


_WIDE = f"{_R}, m AS (SELECT " + ", ".join(f"median({c}) AS {c}_m" for c in _NUM) + f" FROM r), w AS (SELECT ID, " + ", ".join(f"coalesce({c}, {c}_m) AS {c}" for c in _NUM) + f", CASE WHEN {_SQL_TEST} THEN 'test' ELSE 'train' END AS split FROM r, m), x AS (SELECT *, WBC * 2 + HB / 100 AS WBC2, HB + (CAST(substr(ID, 2) AS BIGINT) * 7919 % 1000) / 1000 * {_CHAIN} AS HB2, HB + (CAST(substr(ID, 2) AS BIGINT) * 7919 % 1000 + CAST(substr(ID, 2) AS BIGINT) * 104729 % 1000) / 1000 * {_CHAIN} AS HB3, 0::DOUBLE AS zero, (CAST(substr(ID, 2) AS BIGINT) % 997 = 0)::INT AS rare, (CAST(substr(ID, 2) AS INT) % 2) AS half FROM w)"

ORACLES = {
    "fold_drift": oracle(_FOLDS + ", " + _FOLD_KS.format(cols="ANC, HB, PLT") + """, n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY ks DESC, feature) AS nth FROM ks), d AS (SELECT f, avg(ks) AS ks_mean, median(ks) AS ks_median, avg(ks) FILTER (nth <= 5) AS ks_top5, avg(w1) AS w1_mean FROM n GROUP BY f),
      p AS (SELECT f, abs(avg(few) FILTER (b) - avg(few) FILTER (NOT b)) AS prevalence_shift FROM o GROUP BY f),
      h AS (SELECT f, coalesce(list_avg([""" + ", ".join(f"CASE WHEN bool_or({c} IS NULL) THEN abs(avg(({c} IS NULL)::INT) FILTER (b) - avg(({c} IS NULL)::INT) FILTER (NOT b)) END" for c in ("ANC", "HB", "PLT", "few")) + """]), 0) AS missing_shift FROM o GROUP BY f),
      c AS (SELECT f, CENTER, count(*) FILTER (NOT b) AS a, count(*) FILTER (b) AS c FROM o GROUP BY ALL), q AS (SELECT f, (a / sum(a) OVER u + 1e-9) / (1 + 1e-9 * count(*) OVER u) AS p, (c / sum(c) OVER u + 1e-9) / (1 + 1e-9 * count(*) OVER u) AS q FROM c WINDOW u AS (PARTITION BY f)),
      j AS (SELECT f, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2), 0)) AS js FROM q GROUP BY f)
      SELECT f AS fold, round(ks_mean, 6) AS ks_mean, round(ks_median, 6) AS ks_median, round(ks_top5, 6) AS ks_top5, round(w1_mean, 6) AS w1_mean, round(prevalence_shift, 6) AS prevalence_shift, round(missing_shift, 6) AS missing_shift, round(js, 6) AS js FROM d JOIN p USING (f) JOIN h USING (f) JOIN j USING (f)""", "fx_clinical"),
    "most_drifted": oracle(_FOLDS.replace("o AS (SELECT k.*", "o AS (SELECT k.* REPLACE (" + ", ".join(f"round({c} * 100) AS {c}" for c in _NUM) + ")") + ", " + _FOLD_KS.format(cols=", ".join(_NUM)) + ", e AS (SELECT f, feature, avg(value) FILTER (b) - avg(value) FILTER (NOT b) AS d_mean, stddev_samp(value) FILTER (b) - stddev_samp(value) FILTER (NOT b) AS d_std FROM l GROUP BY ALL) SELECT f AS fold, feature, round(ks, 6) AS ks, round(w1, 6) AS wasserstein, round(d_mean, 6) AS d_mean, round(d_std, 6) AS d_std FROM ks JOIN e USING (f, feature) QUALIFY row_number() OVER (PARTITION BY f ORDER BY ks DESC, w1 DESC, feature) <= 4", "fx_clinical"),
    "preprocess_by_cohort": oracle(f"{_R} " + _own_scale("CENTER = 'CTR_2'", "extra") + " UNION ALL " + _own_scale("CENTER <> 'CTR_2'", "main"), "fx_clinical"),
    "zero_variance_list": oracle(_WIDE + ", v AS (SELECT split, " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in (*_NUM, "WBC2", "zero", "rare", "half")) + " FROM x GROUP BY split), l AS (UNPIVOT v ON " + ", ".join((*_NUM, "WBC2", "zero", "rare", "half")) + " INTO NAME feature VALUE n) SELECT DISTINCT feature FROM l WHERE n <= 1", "fx_clinical"),
    "rare_binary_list": oracle(_WIDE + f", v AS (SELECT split, avg(rare) AS rare, avg(half) AS half FROM x GROUP BY split), l AS (UNPIVOT v ON rare, half INTO NAME feature VALUE p) SELECT DISTINCT feature FROM l WHERE p < {C.RARE_SHARE}", "fx_clinical"),
    "correlation_prune_list": oracle(_WIDE + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, corr({a}, {b}) AS r FROM x" for a, b in combinations((*_NUM, "WBC2"), 2)) + f") SELECT DISTINCT a AS feature FROM p WHERE abs(r) > {C.CORRELATION_LIMIT}", "fx_clinical"),
    "uncorrelated_list": oracle(_WIDE + ", p AS (" + " UNION ALL ".join(f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM x" for a, b in combinations((*_NUM, "WBC2", "HB2", "HB3"), 2)) + ") SELECT feature FROM (SELECT unnest([" + ", ".join(f"'{c}'" for c in (*_NUM, "WBC2", "HB2", "HB3")) + "]) AS feature) WHERE feature NOT IN (SELECT b FROM p WHERE abs(r) > 0.9)", "fx_clinical"),
    "variable_kinds": oracle("WITH n AS (SELECT count(DISTINCT (WBC IS NOT NULL)) AS h, count(DISTINCT length(CYTOGENETICS)) AS e, count(DISTINCT CAST(HB AS INT)) AS g FROM fx_clinical) SELECT 'continuous' AS kind, unnest([" + ", ".join(f"'{c}'" for c in _NUM) + "]) AS feature UNION ALL SELECT 'categorical', unnest(['CENTER', 'CYTOGENETICS']) UNION ALL SELECT CASE WHEN h <= 2 THEN 'binary' ELSE 'ordinal' END, 'has_wbc' FROM n UNION ALL SELECT 'count', 'n_events' FROM n UNION ALL SELECT 'ordinal', 'grade' FROM n", "fx_clinical"),
    "corr_pairs": oracle(_WIDE + ", p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM x" for a, b in combinations((*_NUM, "WBC2"), 2)) + ") SELECT a, b, round(r, 6) AS r FROM p WHERE abs(r) > 0.5", "fx_clinical"),
    "clip_quantiles": oracle(_CLIP + " SELECT ID, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUM) + " FROM c", "fx_clinical"),
    "impute_median": oracle(f"{_R}, q AS (SELECT " + ", ".join(f"median({c}) AS {c}_m" for c in _NUM) + f" FROM r WHERE NOT ({_SQL_TEST})) SELECT ID, " + ", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in _NUM) + " FROM r, q", "fx_clinical"),
    "robust_scale": oracle(f"{_R}, q AS (SELECT {_QUARTERS} FROM r) SELECT ID, " + ", ".join(_ROBUST.format(c=c) for c in _NUM) + " FROM r, q", "fx_clinical"),
    "standard_scale": oracle(f"{_R}, q AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _NUM) + " FROM r) SELECT ID, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in _NUM) + " FROM r, q", "fx_clinical"),
    "rare_category_grouping": oracle(f"WITH k AS (SELECT CENTER FROM fx_clinical WHERE NOT ({_SQL_TEST}) GROUP BY CENTER HAVING count(*) >= 40) SELECT ID, CENTER, CASE WHEN CENTER IN (SELECT CENTER FROM k) THEN CENTER ELSE 'CENTER_OTHER' END AS CENTER_GROUP FROM fx_clinical", "fx_clinical"),
    "one_hot": oracle("SELECT DISTINCT ID, " + ", ".join(f"CASE WHEN EFFECT = '{e}' THEN 1 ELSE 0 END AS EFFECT_{e}" for e in ("ITD", "PTD", "frameshift_variant", "non_synonymous_codon", "splice_site_variant", "stop_gained")) + " FROM fx_molecular", "fx_molecular"),
    "rare_crosstab": oracle("WITH k AS (SELECT GENE FROM fx_molecular GROUP BY GENE HAVING count(*) >= 2500) SELECT ID, CASE WHEN GENE IN (SELECT GENE FROM k) THEN GENE ELSE 'rare' END AS value, count(*) AS n FROM fx_molecular GROUP BY ALL", "fx_molecular"),
    "stratified_split": oracle("WITH v AS (SELECT ID, OS_STATUS, CAST(substr(ID, 2) AS BIGINT) AS k FROM fx_target WHERE OS_YEARS > 0 AND OS_STATUS IS NOT NULL) SELECT ID, OS_STATUS, CASE WHEN row_number() OVER (PARTITION BY OS_STATUS ORDER BY (k * 7919 + 42) % 104729, k) <= floor(count(*) OVER (PARTITION BY OS_STATUS) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM v", "fx_target"),
    "preprocess_full": oracle(_CLIP + ", m AS (SELECT " + ", ".join(f"median({c}) AS {c}_d" for c in _NUM) + " FROM c), i AS (SELECT ID, " + ", ".join(f"coalesce({c}, {c}_d) AS {c}" for c in _NUM) + f" FROM c, m), s AS (SELECT {_QUARTERS} FROM i) SELECT ID, " + ", ".join(_ROBUST.format(c=c) for c in _NUM) + " FROM i, s", "fx_clinical"),
    "ks_drift": oracle(_ECDF + " SELECT feature, n_a, n_b, round(max(gap) / unit, 6) AS ks FROM g GROUP BY feature, n_a, n_b, unit", "fx_clinical"),
    "wasserstein": oracle(_ECDF + " SELECT feature, round(sum(gap * step) / unit, 6) AS wasserstein FROM g GROUP BY feature, unit", "fx_clinical"),
    "moment_drift": oracle(f"{_UNPIVOT} SELECT feature, round(avg(value) FILTER ({_SQL_TEST}) - avg(value) FILTER (NOT ({_SQL_TEST})), 6) AS d_mean, round(stddev_samp(value) FILTER ({_SQL_TEST}) - stddev_samp(value) FILTER (NOT ({_SQL_TEST})), 6) AS d_std FROM l GROUP BY feature", "fx_clinical"),
    "prevalence_shift": oracle(f"{_R}, m AS (SELECT ID, " + ", ".join(f"({c} IS NULL)::INT AS {c}_missing" for c in _NUM) + " FROM r), l AS (UNPIVOT m ON " + ", ".join(f"{c}_missing" for c in _NUM) + f" INTO NAME feature VALUE value), p AS (SELECT feature, avg(value) FILTER (NOT ({_SQL_TEST})) AS p_train, avg(value) FILTER ({_SQL_TEST}) AS p_test FROM l GROUP BY feature) SELECT feature, round(p_train, 6) AS p_train, round(p_test, 6) AS p_test, round(p_test - p_train, 6) AS delta, round(abs(p_test - p_train), 6) AS abs_delta FROM p", "fx_clinical"),
    "js_distance": oracle(f"WITH c AS (SELECT CENTER, count(*) FILTER (NOT ({_SQL_TEST})) AS a, count(*) FILTER ({_SQL_TEST}) AS b FROM fx_clinical GROUP BY CENTER), s AS (SELECT (a / (SELECT sum(a) FROM c) + 1e-9) / (1 + 1e-9 * (SELECT count(*) FROM c)) AS p, (b / (SELECT sum(b) FROM c) + 1e-9) / (1 + 1e-9 * (SELECT count(*) FROM c)) AS q FROM c) SELECT round(sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) / 2 + q * ln(q / ((p + q) / 2)) / 2), 0)), 6) AS js FROM s", "fx_clinical"),
    "missing_rates": oracle(f"{_R}, m AS (SELECT " + ", ".join(f"({c} IS NULL)::INT AS {c}" for c in _NUM) + " FROM r), l AS (UNPIVOT m ON " + ", ".join(_NUM) + " INTO NAME \"column\" VALUE v) SELECT \"column\", sum(v)::BIGINT AS missing, round(avg(v), 6) AS rate FROM l GROUP BY 1", "fx_clinical"),
    "missing_shift": oracle(f"{_R}, m AS (SELECT ID, " + ", ".join(f"({c} IS NULL)::INT AS {c}" for c in _NUM) + " FROM r), l AS (UNPIVOT m ON " + ", ".join(_NUM) + f" INTO NAME f VALUE v), d AS (SELECT f, avg(v) FILTER ({_SQL_TEST}) - avg(v) FILTER (NOT ({_SQL_TEST})) AS d FROM l GROUP BY f HAVING sum(v) > 0) SELECT round(avg(d), 6) AS missing_delta_mean FROM d", "fx_clinical"),
    "group_diff": oracle(f"{_R}, w AS (SELECT CENTER = 'CTR_1' AS g, ANC, HB, PLT, (WBC IS NULL)::INT::DOUBLE AS wbc_missing FROM r), l AS (UNPIVOT w ON ANC, HB, PLT, wbc_missing INTO NAME feature VALUE value), s AS (SELECT feature, bool_and(value IN (0, 1)) AS is_binary, avg(value) FILTER (g) AS mg, avg(value) FILTER (NOT g) AS mr, stddev_samp(value) FILTER (NOT g) AS sr FROM l GROUP BY feature) SELECT feature, is_binary, round(mg, 6) AS mean_group, round(mr, 6) AS mean_rest, round(CASE WHEN is_binary THEN mg - mr ELSE (mg - mr) / sr END, 6) AS effect FROM s", "fx_clinical"),
    "sanity_report": oracle(f"{_R}, l AS (SELECT * FROM (SELECT {', '.join(_NUM)} FROM r) UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(_NUM)}))) SELECT feature, count(*) AS rows, round(avg((value IS NULL)::INT), 6) AS missing, count(DISTINCT value) AS \"distinct\", round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, count(DISTINCT value) <= 1 AS constant FROM l GROUP BY feature", "fx_clinical"),
    "value_shares": oracle("SELECT 'OS_STATUS' AS feature, OS_STATUS::DOUBLE AS value, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_target WHERE OS_STATUS IS NOT NULL GROUP BY OS_STATUS", "fx_target"),
    "rule_violations": oracle(" UNION ALL ".join([f"SELECT ID, '{n} in range' AS rule FROM fx_clinical WHERE NOT ({n} BETWEEN {lo} AND {hi})" for n, (lo, hi) in C.RANGES.items()] + ["SELECT ID, 'ANC below WBC' FROM fx_clinical WHERE NOT (ANC <= WBC)", "SELECT ID, 'normal has no count' FROM fx_clinical WHERE NOT (NOT contains(CYTOGENETICS, 'complex') OR PLT > 50)"]), "fx_clinical"),
    "cohort_means": oracle(f"{_UNPIVOT} SELECT CASE WHEN {_SQL_TEST} THEN 'b' ELSE 'a' END AS dataset, feature, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM l GROUP BY ALL", "fx_clinical"),
    "spearman": oracle("WITH r AS (SELECT m_a, m_c, rank() OVER (ORDER BY m_a) + (count(*) OVER (PARTITION BY m_a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY m_c) + (count(*) OVER (PARTITION BY m_c) - 1) / 2.0::DOUBLE AS rc FROM fx_scores) SELECT round(corr(m_a, m_c), 6) AS pearson, round(corr(ra, rc), 6) AS spearman, count(*) AS n FROM r", "fx_scores"),
}

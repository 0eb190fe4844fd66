"""Queries against their SQL on DuckDB, and what holds for those that SQL can't express."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import models, ordered
from tidewell.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if pd.isna(v):
        return None
    return v if isinstance(v, (str, bool, np.bool_)) else float(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_stratified_split_of_large_keys_equals_sql(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.withColumn("o_orderkey", F.col("o_orderkey") * 104_743).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got, want = catalog.queries()["stratified_split"](spark, str(tmp_path)).toPandas(), con.execute(catalog.oracle_sql()["stratified_split"]).df()
    assert rows(got) == rows(want)


def test_every_name_is_known():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_cox_recovers_a_coefficient(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    t = rng.exponential(1 / np.exp(0.8 * x[:, 0]))
    e = (rng.random(600) < 0.8).astype(int)
    df = spark.createDataFrame([(str(i), float(np.ceil(t[i] * 50) / 50), int(e[i]), float(x[i, 0]), float(x[i, 1])) for i in range(600)], "ID string, OS_YEARS double, OS_STATUS int, a double, b double")
    model = models.fit_cox(df, ["a", "b"])
    assert abs(model.beta[0] - 0.8) < 0.2 and abs(model.beta[1]) < 0.15
    again = models.LinearRisk.from_json(model.to_json())
    assert math.isclose(again.transform(df).first().risk, model.transform(df).first().risk)
    path = models.fit_coxnet(df, ["a", "b"], path=2, least=0.05)
    assert path[0][1].beta == [0, 0] and path[-1][1].beta[0] > 0
    linear = models.fit("componentwise", df, ["a", "b"], rounds=3, rate=0.3, share=1.0)
    assert linear.beta[0] > 0.2 and linear.beta[1] == 0


def test_cox_residuals_sum_to_zero(spark):
    df = spark.createDataFrame([(str(i), float(1 + i % 7), i % 2, float(i % 5) / 10) for i in range(60)], "ID string, OS_YEARS double, OS_STATUS int, risk double")
    assert abs(models.cox_residuals(df).agg(F.sum("residual")).first()[0]) < 1e-9


def test_knn_impute_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 3)), 3)
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(f"{i:03d}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "ID string, a double, b double, c double")
    got = {r.ID: tuple(r)[1:] for r in models.knn_impute(df, ["a", "b", "c"], k=4, blocks=3).collect()}
    for i, r in enumerate(x):
        for j in range(3):
            if not np.isnan(r[j]):
                assert got[f"{i:03d}"][j] == r[j]
                continue
            found = []
            for k, q in enumerate(x):
                both = ~np.isnan(r) & ~np.isnan(q)
                if not np.isnan(q[j]) and both.any():
                    found.append((((r[both] - q[both]) ** 2).sum() * 3 / both.sum(), q[j], k))
            found.sort()
            if found:
                assert math.isclose(got[f"{i:03d}"][j], np.mean([v for _, v, _ in found[:4]]), abs_tol=1e-9)


def test_iterative_impute_recovers_a_linear_relation(spark):
    df = spark.createDataFrame([(str(i), float(i), 2.0 * i + 1 if i % 5 else None) for i in range(50)], "ID string, a double, b double")
    out = models.iterative_impute(df, ["a", "b"], rounds=3).filter("CAST(ID AS INT) % 5 = 0").collect()
    assert all(abs(r.b - (2 * r.a + 1)) < 0.5 for r in out)


def test_trials_go_on_from_their_log(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", float(np.ceil(20 * rng.exponential(np.exp(-x)))), int(rng.random() < 0.8), float(x)) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "ID string, OS_YEARS double, OS_STATUS int, a double")
    first = models.run_trials(df, ["a"], "cox", {"alpha": [0.1]}, folds=2, tau=None)
    both = models.run_trials(df, ["a"], "cox", {"alpha": [0.1, 5.0]}, first, folds=2, tau=None)
    assert first.count() == 2 and both.count() == 4 and models.best_trial(both).first().mean_score > 0.6
    kept = models.retrained_without(df, df.filter("a > 1"), ["a"], {"cox": {}}, folds=2, tau=None)
    assert kept.count() == 2


def test_folds_are_balanced_and_seeded(spark, sf_dir):
    from tidewell.plans.ranking import kfold

    n = [r["count"] for r in kfold(spark, sf_dir).groupBy("fold").count().collect()]
    assert max(n) - min(n) <= 1


def test_ranks_add_up(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("ID"), (F.col("id") % 37).cast("double").alias("x"))
    assert ordered.average_ranks(df, "x").agg(F.sum("rank")).first()[0] == 300 * 301 / 2


def test_row_level_features_run_on_a_stream(spark, sf_dir, tmp_path):
    """Projections hold no state, so a stream of records gets the same features as a table."""
    from tidewell import config as C
    from tidewell.operators.clinical import clinical_features
    from tidewell.plans.fixtures import view

    table = view(spark, sf_dir, "fx_clinical").limit(50)
    table.write.parquet(str(tmp_path / "in"))
    make = lambda df: clinical_features(df, C.MEASURES, C.RATIOS, C.THRESHOLDS, C.SCORES, C.SCORE_FLAGS)
    q = make(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == 50 and set(spark.table("streamed").columns) == set(make(table).columns)


def test_unknown_class_is_predicted(spark):
    df = spark.createDataFrame([(str(i), float(i % 2) if i % 5 else 0.5, float(i % 2) * 3 + i / 100) for i in range(60)], "ID string, sex double, x double")
    out = {r.ID: r.sex for r in models.impute_class(df, "sex", ["x"]).collect()}
    assert all(out[str(i)] == i % 2 for i in range(60))


def test_early_impute_keeps_ranges(spark):
    df = spark.createDataFrame([(str(i), float(i), 2.0 * i if i % 4 else None) for i in range(40)], "ID string, a double, b double")
    got = models.early_impute(df, ["b"], {"b": (0, 30)}, ["a"], rounds=2)
    assert got.filter("b IS NULL OR b < 0 OR b > 30").count() == 0

"""Models against numpy, and what they promise at size."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tidewell.operators import estimators, models, neighbours, risk, trees
from tidewell.operators.ordered import settle

NAMES = list("abcd")


def survival_rows(n=400, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)).round(2)
    x[:, p - 1] = x[:, p - 1] > 0
    t, c = rng.exponential(np.exp(-x[:, 0] - 1.5 * x[:, p - 1])).round(2) + 0.01, rng.exponential(1.5, n).round(2) + 0.01
    return x, np.minimum(t, c), (t <= c).astype(int)


def table(spark, x, t, e, names=NAMES):
    return settle(spark.createDataFrame(pd.DataFrame(x, columns=names).assign(ID=[str(i) for i in range(len(x))], OS_YEARS=t, OS_STATUS=e)))


def likelihood(x, t, e, beta):
    """Log likelihood and gradient (Breslow)."""
    w, value, g = np.exp(x @ beta), 0.0, np.zeros(x.shape[1])
    for i in np.flatnonzero(e):
        at = t >= t[i]
        value += x[i] @ beta - np.log(w[at].sum())
        g += x[i] - (w[at, None] * x[at]).sum(axis=0) / w[at].sum()
    return value, g


def test_every_penalty_meets_its_optimality_conditions(spark):
    x, t, e = survival_rows(300, 40, 1)
    x[:, 1] += x[:, 0]
    names = [f"f{i}" for i in range(40)]
    tab = risk.risk_table(table(spark, x, t, e, names), names)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    found = risk.fit_all(tab, [*risk.penalty_path(tab, 0.95, 12, 0.02), risk.Fit(ridge=2.0)])
    assert (found[0].beta == 0).all() and (found[8].beta != 0).any()
    for f in found:
        b = f.beta * x.std(axis=0)
        pull = likelihood(z, t, e, b)[1] - f.fit.ridge * b
        off = np.where(b != 0, np.abs(pull - f.fit.lasso * np.sign(b)), np.maximum(np.abs(pull) - f.fit.lasso, 0))
        assert off.max() / len(x) < 1e-6


def test_linear_boosting_takes_one_pass_a_round_over_blocks_of_rows(spark, monkeypatch):
    x, t, e = survival_rows(300, 4, 3)
    df = table(spark, x, t, e).withColumn("fold", F.col("ID").cast("int") % 3)
    tab = risk.risk_table(df, NAMES, F.col("fold"), "ID")
    assert tab.rows.count() <= 8  # 300 rows before
    passes, add = [], risk.added_up
    monkeypatch.setattr(risk, "added_up", lambda *a: passes.append(1) or add(*a))
    fits = [risk.Fit(-1), risk.Fit(0), risk.Fit(2)]
    once = risk.boosted_lines(tab, fits, 10, 0.1, 0.7)
    assert len(passes) == 12  # 22 before
    monkeypatch.setattr(risk, "FEW", 0)
    for a, b in zip(once, risk.boosted_lines(tab, fits, 10, 0.1, 0.7), strict=True):
        assert (b.beta != 0).any() and np.allclose(a.beta, b.beta, rtol=0, atol=1e-12)


def test_folds_together_equal_folds_apart(spark):
    x, t, e = survival_rows(200)
    df = table(spark, x, t, e).withColumn("fold", (F.col("ID").cast("int") % 3))
    both = models.cox_models(df, NAMES, [0, 1, 2], F.col("fold"), "ID", [{"alpha": 0.1}, {"alpha": 5.0}])
    for i, alpha in enumerate((0.1, 5.0)):
        for f in range(3):
            alone = models.fit_cox(df.filter(F.col("fold") != f), NAMES, alpha)
            assert np.allclose(alone.beta, both[i][f].beta, atol=1e-6) and np.allclose(alone.center, both[i][f].center)


def test_gaps_are_an_error(spark):
    df = spark.createDataFrame([("1", 1.0, 1, 2.0), ("2", 2.0, 1, None)], "ID string, OS_YEARS double, OS_STATUS int, a double")
    with pytest.raises(ValueError, match="gaps"):
        models.fit_cox(df, ["a"])


def test_boosting_equals_numpy(spark):
    x, t, e = survival_rows(300)
    df = table(spark, x, t, e)
    model = models.fit("boosting", df, NAMES, "ID", rounds=23, share=1.0, rate=0.2)  # past a storing of scores
    b, k = trees.bins_of(x, model.cuts).astype(int), np.unique(t, return_inverse=True)[1]
    score, losses = np.zeros(len(x)), []
    for _ in range(23):
        w = np.exp(score)
        at_risk, d = (np.array([v[k >= i].sum() if v is w else v[k == i].sum() for i in range(k.max() + 1)]) for v in (w, e))
        g = e - w * np.cumsum(d / at_risk)[k]
        h = np.maximum(w * np.cumsum(d / at_risk)[k] - w * w * np.cumsum(d / at_risk**2)[k], 1e-12)
        losses.append(float((d * np.log(at_risk)).sum() - (e * score).sum()))
        step = np.zeros(len(x))

        def grow(rows, depth, step=step, g=g, h=h):
            worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
            best = (1e-12, None)
            for j in range(4 if depth else 0):
                for c in range(trees.BINS):
                    left, right = rows[b[rows, j] <= c], rows[b[rows, j] > c]
                    if min(len(left), len(right)) >= 20 and (gain := worth(left) + worth(right) - worth(rows)) > best[0] + 1e-12:
                        best = (gain, left, right)
            if best[1] is None:
                step[rows] = g[rows].sum() / (h[rows].sum() + 1)
            else:
                grow(best[1], depth - 1)
                grow(best[2], depth - 1)

        grow(np.arange(len(x)), 3)
        score = score + 0.2 * step
    got = {r.ID: r.risk for r in model.transform(df).collect()}
    assert np.allclose([got[str(i)] for i in range(len(x))], score, atol=1e-9) and np.allclose(losses, model.losses)
    assert all(a > b for a, b in zip(losses, losses[1:], strict=False))


def test_log_rank_split_equals_brute_force():
    x, t, e = survival_rows(120, 3, 4)
    b = trees.bins_of(x, [sorted(set(np.quantile(x[:, j], [0.2, 0.4, 0.6, 0.8]))) for j in range(3)])
    k = np.unique(t, return_inverse=True)[1]
    w = np.random.default_rng(1).integers(0, 3, len(x))
    best = (-1.0, 0, 0)
    for j in range(3):
        for c in range(trees.BINS):
            left = b[:, j] <= c
            if min(w[left].sum(), w[~left].sum()) < 10:
                continue
            u = v = 0.0
            for i in range(k.max() + 1):
                n, n1, d, d1 = w[k >= i].sum(), w[(k >= i) & left].sum(), (w * e)[k == i].sum(), (w * e)[(k == i) & left].sum()
                if d and n > 1:
                    u, v = u + d1 - n1 * d / n, v + n1 / n * (1 - n1 / n) * d * (n - d) / (n - 1)
            if v > 1e-12 and abs(u) / v**0.5 > best[0] + 1e-9:
                best = (abs(u) / v**0.5, j, c)
    got = trees.log_rank_split(trees.histogram(b, k, e, w, k.max() + 1), 10)
    assert got[1:] == best[1:] and abs(got[0] - best[0]) < 1e-9


def test_forest_is_the_same_however_it_is_cut(spark, monkeypatch):
    x, t, e = survival_rows(300)
    x[5, 1] = np.nan
    df = table(spark, x, t, e).withColumn("b", F.nanvl("b", F.lit(None)))
    grown = {}
    for local, parts in ((50_000, 1), (100, 1), (40, 5)):
        monkeypatch.setattr(trees, "LOCAL", local)
        grown[local] = models.fit("forest", df.repartition(parts), NAMES, "ID", trees=6, depth=5)
    for other in (100, 40):
        for p, q in zip(grown[50_000].trees, grown[other].trees, strict=True):
            assert np.array_equal(p.feature, q.feature) and np.array_equal(p.bin, q.bin) and np.allclose(p.value, q.value)
    assert max(len(tree.feature) for tree in grown[40].trees) > 7 and grown[40].transform(df).filter("risk IS NULL").count() == 0


def test_rows_stand_in_the_order_of_their_nodes(monkeypatch):
    rng = np.random.default_rng(4)
    x, t, e = rng.integers(0, trees.BINS + 1, (5000, 4)).astype(np.uint8), rng.integers(0, 20, 5000).astype(np.uint8), rng.integers(0, 2, 5000).astype(np.uint8)
    w, g = trees.row_weights(rng.integers(0, 2**62, 5000), 7, 42), trees.Growth(depth=6)
    assert w.dtype == np.uint8 and w.max() > 3 and abs(w.mean() - 1) < 0.06
    found = {h: v for h, *v in zip(*trees.grown(x, t, e, w, 20, 7, 1, g), strict=True)}
    upper = {h: tuple(v) for h, v in found.items()}
    heaps = trees._heaps(upper, x)
    for h in [h for h, v in found.items() if v[0] >= 0]:  # each node splits as its own rows tell
        at = heaps.copy()
        while (at > h).any():
            at = np.where(at > h, at >> 1, at)
        own = np.flatnonzero(at == h)
        looks = trees.looked_at(g, 7, int(h), 4)
        stat, j, b = trees.log_rank_split(trees.histogram(x[np.ix_(own, looks)], t[own], e[own].astype(int), w[own].astype(float), 20), g.leaf)
        assert (looks[j], b) == tuple(found[h][:2]) and stat == found[h][3]


def test_tree_tables_hold_blocks_and_nodes_grow_together(spark, monkeypatch):
    x, t, e = survival_rows(300)
    df = table(spark, x, t, e).repartition(2)
    assert trees.binned(df, NAMES, np.unique(t), key="ID").rows.count() <= 2  # 300 rows before
    one = models.fit("forest", df, NAMES, "ID", trees=3, depth=6)
    boosted = models.fit("boosting", df, NAMES, "ID", rounds=22)
    monkeypatch.setattr(trees, "BLOCK", 16)
    monkeypatch.setattr(trees, "AT_ONCE", 1)
    for p, q in zip(one.trees, models.fit("forest", df, NAMES, "ID", trees=3, depth=6).trees, strict=True):
        assert np.array_equal(p.feature, q.feature) and np.array_equal(p.bin, q.bin) and np.array_equal(p.value, q.value)
    assert np.allclose(boosted.score(x), models.fit("boosting", df, NAMES, "ID", rounds=22).score(x))


def test_forest_and_boosting_rank_held_out_rows_as_well_as_cox(spark):
    x, t, e = survival_rows(900, seed=2)
    df = table(spark, x, t, e)
    oof = models.out_of_fold(df, NAMES, {"cox": {}, "net": {"kind": "coxnet", "penalty": 0.05}, "forest": {"trees": 40}, "boosting": {"rounds": 25}}, folds=2)
    score = {r.model: r.s for r in models.fold_scores(oof, df.select("ID", "OS_YEARS", "OS_STATUS"), None).groupBy("model").agg(F.avg("score").alias("s")).collect()}
    assert oof.filter("pred IS NULL").count() == 0 and score["cox"] > 0.7
    assert all(score[m] > score["cox"] - 0.03 for m in ("net", "forest", "boosting"))


@pytest.mark.parametrize("error", [ArithmeticError, np.linalg.LinAlgError])
def test_a_fit_that_fails_is_an_error(spark, monkeypatch, error):
    x, t, e = survival_rows(60)
    df = table(spark, x, t, e)

    def failing(*_):
        raise error("no fit")

    monkeypatch.setattr(models, "fit_all", failing)
    with pytest.raises(error):
        models.out_of_fold(df, NAMES, {"cox": {}}, folds=2)
    with pytest.raises(error):
        models.retrained_without(df, df.limit(5), NAMES, {"cox": {}}, folds=2)


def test_halving_drops_the_worse_half(spark):
    x, t, e = survival_rows(200)
    log = models.run_trials(table(spark, x, t, e), NAMES, "cox", {"alpha": [0.1, 1.0, 10.0, 1e5]}, folds=3, tau=None, halving=True)
    assert sorted(r["count"] for r in log.groupBy("trial").count().collect()) == [1, 1, 2, 3]


def test_estimators_stand_in_pipelines_and_are_saved(spark, tmp_path):
    x, t, e = survival_rows(200)
    df = table(spark, x, t, e)
    config = {"Cox": {"kind": "cox", "params": {"alpha": 0.5}}, "RSF": {"kind": "forest", "params": {"trees": 4, "depth": 3}}, "Off": {"kind": "cox", "enabled": False}}
    made = estimators.registry(config, NAMES)
    assert list(made) == ["Cox", "RSF"]
    for name, estimator in made.items():
        fitted = Pipeline(stages=[estimator]).fit(df)
        fitted.write().overwrite().save(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name))
        assert again.transform(df).select("risk").collect() == fitted.transform(df).select("risk").collect()
        estimator.write().overwrite().save(str(tmp_path / f"{name}-open"))
        assert json.loads(estimators.RiskEstimator.load(str(tmp_path / f"{name}-open")).getOrDefault("settings")) == config[name]["params"]
    with pytest.raises(ValueError, match="no model of kind"):
        estimators.RiskEstimator(kind="none", features=NAMES).fit(df)


def test_saved_models_by_name(spark, tmp_path):
    x, t, e = survival_rows(150)
    df, at = table(spark, x, t, e), str(tmp_path / "models")
    one, two = models.fit_cox(df, NAMES), models.fit("forest", df, NAMES, "ID", trees=3, depth=3)
    models.save_models({"one": one, "two": two}, at, spark)
    models.save_models({"one": models.fit_cox(df, NAMES[:1])}, at, spark)
    found = models.load_models(at, spark)
    assert list(found) == ["one", "two"] and found["one"].features == NAMES[:1] and found["two"].to_json() == two.to_json()
    with pytest.raises(KeyError, match="three"):
        models.load_models(at, spark, ["one", "three"])
    ranks = models.scored_by(df, found).agg(F.sum("risk_score")).first()[0]
    assert abs(ranks - 150 * 151 / 2) < 1e-9
    assert models.coefficients(one, spark, 2).count() == 2 and models.importances(two, spark).first().importance > 0


def test_correlations_use_the_rows_that_each_pair_has(spark):
    from tidewell.operators import fitted

    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 30))
    x[:, 1] += 2 * x[:, 0]
    x[rng.random(x.shape) < 0.3] = np.nan
    names = [f"c{i}" for i in range(30)]
    frame = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names))
    got, r = fitted.correlations(df.withColumn("flat", F.lit(1.0)), [*names, "flat"])
    assert got == names and np.allclose(r, frame.corr().to_numpy())


def test_a_later_column_goes_even_if_its_partner_went(spark):
    from tidewell.operators import fitted

    names = ["a", "b", "c"]
    chain = [[1.0, 0.95, 0.8], [0.95, 1.0, 0.95], [0.8, 0.95, 1.0]]
    assert fitted.correlated_drops(names, chain, 0.9, keep="first") == ["b", "c"]
    df = spark.createDataFrame([(float(i), 2.0) for i in range(9)], "x double, flat double")
    assert fitted.uncorrelated(df, ["x", "flat"], 0.9) == ["x", "flat"] and fitted.uncorrelated(df, ["x", "flat"], 0.9, 1e-6) == ["x"]


def test_every_named_feature_is_made(spark, sf_dir):
    from tidewell import config as C
    from tidewell.plans.complete import full_features

    assert set(C.EXPLORATORY_FEATURES) <= set(full_features(spark, sf_dir).columns)


def test_bayesian_ridge_equals_numpy_on_the_rows():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 5)) * [1, 2, 3, 1, 1] + 4
    y = x @ [1.0, 0, -2, 0.5, 0] + 3 + rng.normal(size=150)
    v = np.column_stack([x, y, np.ones(150)])
    got = models.bayesian_ridge(v.T @ v, tolerance=1e-12)
    xc, yc, noise, weight, b = x - x.mean(axis=0), y - y.mean(), 1 / y.var(), 1.0, np.zeros(5)
    for _ in range(300):
        cov = np.linalg.inv(weight * np.eye(5) + noise * xc.T @ xc)
        b = noise * cov @ xc.T @ yc
        used = 5 - weight * np.trace(cov)
        weight, noise = (used + 2e-6) / (b @ b + 2e-6), (150 - used + 2e-6) / (((yc - xc @ b) ** 2).sum() + 2e-6)
    assert np.allclose(got, [*b, y.mean() - x.mean(axis=0) @ b], atol=1e-8)


@pytest.mark.parametrize("model,near", [("bayes", 0.2), ("ridge", 0.5), ("forest", 12), ("boosting", 12)])
def test_chained_equations_with_each_model(spark, model, near):
    df = spark.createDataFrame([(str(i), float(i), 2.0 * i + 1 if i % 5 else None) for i in range(60)], "ID string, a double, b double")
    out = models.iterative_impute(df, ["a", "b"], rounds=4, model=model).filter("CAST(ID AS INT) % 5 = 0").collect()
    assert all(abs(r.b - (2 * r.a + 1)) < near for r in out)
    with pytest.raises(ValueError, match="no model"):
        models.iterative_impute(df, ["a"], model="none")


def nearest_by_hand(x, k):
    """Gaps as the mean of the k nearest donors, by (distance, value); the column's mean where no donor has a column in common."""
    out = x.copy()
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        found = []
        for q in x[~np.isnan(x[:, j])]:
            both = ~np.isnan(x[i]) & ~np.isnan(q)
            if both.any():
                found.append((sum((a - b) ** 2 for a, b in zip(x[i][both], q[both], strict=True)) * x.shape[1] / both.sum(), q[j]))
        out[i, j] = np.mean([v for _, v in sorted(found)[:k]]) if found else np.nanmean(x[:, j])
    return out


@pytest.mark.parametrize("kind", ["clusters", "ties", "empty rows"])
def test_neighbours_equal_brute_force_and_look_at_few_pairs(spark, kind):
    rng = np.random.default_rng(7)
    n = 1200
    if kind == "ties":
        x = rng.integers(0, 4, size=(n, 4)).astype(float)
    else:
        x = rng.normal(size=(40, 4))[rng.integers(0, 40, n)] * 20 + rng.normal(size=(n, 4))
    x[rng.random(x.shape) < 0.08] = np.nan
    if kind == "empty rows":
        x[::50], x[:, 3] = np.nan, np.nan
    pdf = pd.DataFrame(x, columns=NAMES).assign(ID=[f"{i:05d}" for i in range(n)])
    df = settle(spark.createDataFrame(pdf).replace(float("nan"), None))
    got = neighbours.knn_impute(df, NAMES, 4, blocks=40).orderBy("ID").toPandas()[NAMES].to_numpy(float)
    want = nearest_by_hand(x, 4) if kind != "empty rows" else np.column_stack([nearest_by_hand(x, 4)[:, :3], x[:, 3]])
    np.testing.assert_allclose(got, want, rtol=1e-9)
    if kind == "clusters":
        search = neighbours.Search(df, NAMES, 4, "ID", 30)
        search.run()
        assert search.share() < 0.2


def test_neighbours_of_an_empty_table_and_of_one_without_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "ID string, a double, b double")
    assert neighbours.knn_impute(df.filter("false"), ["a", "b"]).count() == 0
    assert sorted(map(tuple, neighbours.knn_impute(df, ["a", "b"]).collect())) == [("a", 1.0, 2.0), ("b", 3.0, 4.0)]


def test_gaps_of_one_kind_have_donors_of_their_own(spark):
    """Values of the missing column, spread widest, would cut all blocks, and ties of the others fill them: every gap had to search them all."""
    n = 900
    x = np.array([[i * 37 % 901 * 10.0, i % 3, i % 5] for i in range(n)])
    x[::6, 0] = np.nan
    df = settle(spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(ID=[f"{i:05d}" for i in range(n)])).replace(float("nan"), None))
    got = neighbours.knn_impute(df, list("abc"), 4, blocks=30).orderBy("ID").toPandas()[list("abc")].to_numpy(float)
    np.testing.assert_allclose(got, nearest_by_hand(x, 4), rtol=1e-9)
    search = neighbours.Search(df, list("abc"), 4, "ID", 30)
    search.run()
    assert search.share() < 0.1

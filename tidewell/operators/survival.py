"""Survival estimates and the evaluation of risk scores."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import average_ranks, last_known, prefix_sums, range_of, settle

#: Distinct times that are broadcast at most.
SMALL = 100_000


def kaplan_meier(df: DataFrame, time: str = "OS_YEARS", event: str = "OS_STATUS", censoring: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """By distinct time: at_risk, events, censored and the product-limit estimate up to and including it. With `censoring`, the estimate is of
    the censoring distribution: at equal times events leave the risk set before censored rows do."""
    long = df.select(*by, time, F.coalesce(F.col(event), F.lit(0)).alias("_e"))
    steps = prefix_sums(long, time, {"_events": F.col("_e"), "_rows": F.lit(1)}, by)
    sizes = long.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")) if by else long.agg(F.count(F.lit(1)).alias("_all"))
    steps = steps.join(sizes, list(by)) if by else steps.crossJoin(F.broadcast(sizes))  # one row
    at_risk, d = F.col("_all") - F.col("_rows_before"), F.col("_events")
    q = F.col("_rows") - d
    factor = 1 - (q / F.greatest(at_risk - d, F.lit(1)) if censoring else d / at_risk)
    steps = settle(steps.select(*by, time, at_risk.alias("at_risk"), d.alias("events"), q.alias("censored"), factor.alias("_f")))
    logs = prefix_sums(steps, time, {"_log": F.when(F.col("_f") > 0, F.ln("_f")).otherwise(0.0), "_zero": (F.col("_f") <= 0).cast("int")}, by)
    survival = F.when(F.col("_zero") + F.col("_zero_before") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_log") + F.col("_log_before")))
    return steps.drop("_f").join(logs.select(*by, time, survival.alias("survival")), [*by, time])


def censoring_weights(test: DataFrame, train: DataFrame, tau: float | None, time: str = "OS_YEARS", event: str = "OS_STATUS") -> DataFrame:
    """time and weight 1 / G(time)^2 for the event times of `test` below tau, G being `train`'s censoring distribution (1 before its first time)."""
    g = kaplan_meier(train, time, event, censoring=True).select(F.col(time).alias("_t"), F.lit(0).alias("_ask"), F.col("survival").alias("_g"))
    asked = test.filter((F.col(event) == 1) & ((F.col(time) < tau) if tau is not None else F.lit(True))).select(F.col(time).alias("_t")).distinct()
    both = g.unionByName(asked.select("_t", F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("_g")))
    filled = last_known(both, "_t", "_ask", "_g", "_last").filter("_ask = 1")
    return filled.select(F.col("_t").alias(time), (1 / F.pow(F.coalesce("_last", F.lit(1.0)), 2)).alias("weight"))


def concordance(df: DataFrame, score: str, train: DataFrame | None = None, tau: float | None = None, time: str = "OS_YEARS", event: str = "OS_STATUS", by: tuple[str, ...] = ()) -> DataFrame:
    """Concordance weighted by the inverse probability of censoring, by group: c_index, concordant and tied (weighted), comparable (pairs).

    Pairs (i, j): i has an event before tau, and j's time is later, or equal without an event. The higher score of i is concordant, an equal
    one counts half. Pairs are never formed. Times and events make one number, larger for every j that i may be paired with. Scores are cut into
    slices: rows of different slices meet as sums by slice and number, rows of one slice in one task. A score that has many rows is a slice of its
    own, and its rows are all ties.
    """
    rows = df.select(*by, F.col(time).alias("_t"), F.coalesce(F.col(event), F.lit(0)).alias("_e"), F.round(F.col(score), 8).alias("_s")).filter("_t IS NOT NULL AND _s IS NOT NULL")
    cells = settle(rows.groupBy(*by, "_t", "_e", "_s").agg(F.count(F.lit(1)).alias("_n")))  # distinct (time, event, score)
    times = prefix_sums(cells.select("_t").distinct(), "_t", {"_one": F.lit(1)}).select("_t", F.col("_one_before").cast("long").alias("_k"))
    weights = censoring_weights(cells.select(F.col("_t").alias(time), F.col("_e").alias(event)), train if train is not None else df, tau, time, event)
    times = settle(times.join(weights.select(F.col(time).alias("_t"), "weight"), "_t", "left"))
    last = times.agg(F.max("_k")).first()[0] or 0
    cells = cells.join(F.broadcast(times) if last < SMALL else times, "_t")
    weight = F.when(F.col("_e") == 1, F.col("weight"))
    cells = cells.select(*by, (2 * F.col("_k") + (F.col("_e") == 0).cast("long")).alias("_k"), "_s", range_of(cells, "_s", apart=True).alias("_slice"), "_n", (weight * F.col("_n")).alias("_w"), F.when(weight.isNotNull(), F.col("_n")).alias("_firsts"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", "_w", "_firsts")]
    # all pairs
    slices = settle(cells.groupBy(*by, "_slice", "_k").agg(*sums))
    after = prefix_sums(slices, "_k", {c: F.col(c) for c in ("_n", "_w", "_firsts")}, by, descending=True)
    total = after.groupBy(*by).agg(F.sum(F.col("_w") * F.col("_n_before")).alias("n"), F.sum(F.col("_firsts") * F.col("_n_before")).alias("pairs"))
    # rows of different slices: at each bit level, numbers that share all higher bits meet in one group, and any two numbers meet in exactly one
    node = [*by, "_level", "_high"]
    spread = slices.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit((2 * last + 1).bit_length() - 1))))
    second = F.expr("shiftright(_k, _level) & 1") == 1
    per_slice = spread.groupBy(*node[:-1], F.expr("shiftright(_k, _level + 1)").alias("_high"), "_slice").agg(F.sum(F.when(second, F.col("_n")).otherwise(0)).alias("_later"), F.sum(F.when(second, 0.0).otherwise(F.col("_w"))).alias("_weight"))
    parts = [_strictly_below(per_slice, node).groupBy(*by).agg(F.sum(F.col("_weight") * F.col("_below")).alias("c"), F.lit(0.0).alias("e"))]
    # rows of one slice
    own = Window.partitionBy(*by, "_s").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    parts.append(cells.filter("_slice % 2 = 1").withColumn("_later", F.sum("_n").over(own)).groupBy(*by).agg(F.lit(0.0).alias("c"), F.coalesce(F.sum(F.col("_w") * F.col("_later")), F.lit(0.0)).alias("e")))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cells.select(*by).schema.fields) + "c double, e double"
    parts.append(cells.filter("_slice % 2 = 0").select(*by, "_slice", "_k", "_s", "_n", "_w").groupBy("_slice").applyInPandas(lambda pdf: _within(pdf, list(by)), kinds))
    found = reduce(DataFrame.unionByName, parts).groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.sum("c").alias("c"), F.sum("e").alias("e"))
    total = total.join(found, reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)])) if by else total.crossJoin(F.broadcast(found))  # one row
    return total.select(*by, F.try_divide(F.col("c") + F.col("e") / 2, F.col("n")).alias("c_index"), F.col("c").alias("concordant"), F.col("e").alias("tied"), F.col("pairs").cast("long").alias("comparable"))


def _within(cells: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """By group: c, the weighted pairs of these cells whose second has a larger number and a strictly lower score; e, those with an equal score."""
    group = cells.groupby(by, sort=False, dropna=False).ngroup().to_numpy("int64") if by else np.zeros(len(cells), "int64")
    order = np.lexsort((cells["_s"].to_numpy(float), group))
    g, s, k, n = (a[order] for a in (group, cells["_s"].to_numpy(float), cells["_k"].to_numpy("int64"), cells["_n"].to_numpy(float)))
    w, m = np.nan_to_num(cells["_w"].to_numpy(float, na_value=np.nan))[order], int(group.max()) + 1
    run = np.cumsum(np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])))
    c, e, bits = np.zeros(m), np.zeros(m), int(k.max()).bit_length()
    for level in range(bits):
        node = (g << bits) + (k >> (level + 1))
        o = np.argsort(node, kind="stable")
        second = (k[o] >> level) & 1 == 1
        later, weight, node, r = np.where(second, n[o], 0), np.where(second, 0, w[o]), node[o], run[o]
        before, new = np.cumsum(later) - later, np.append(True, node[1:] != node[:-1])
        step = new | np.append(True, r[1:] != r[:-1])
        at = lambda starts, before=before: before[np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]
        c += np.bincount(g[o], weight * (at(step) - at(new)), m)
        equal = np.cumsum(step) - 1
        e += np.bincount(g[o], weight * np.bincount(equal, later)[equal], m)
    first = np.unique(group, return_index=True)[1]
    return cells[by].iloc[first].reset_index(drop=True).assign(c=c, e=e)


def _strictly_below(cells: DataFrame, node: list[str]) -> DataFrame:
    """_below: later rows of the node in strictly lower slices."""
    w = Window.partitionBy(*node).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("_below", F.coalesce(F.sum("_later").over(w), F.lit(0)))


def k_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "ID", order: Column | None = None) -> DataFrame:
    """Equal folds by rank in an order of the rows, that of a seeded hash of the key unless another is given."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)) if order is None else order)
    order = prefix_sums(hashed, "_h", {"_n": F.lit(1)}).select("_h", (F.col("_n_before") % k).cast("int").alias("fold"))
    return hashed.join(order, "_h").drop("_h")


def group_folds(df: DataFrame, group: str, k: int = 5, most: int = 1_000_000) -> DataFrame:
    """Whole groups in folds of near-equal size: the largest group first, each to the lightest fold. Groups (not rows) are listed on the
    driver; more than `most` of them are an error, since a hash of the group then balances as well."""
    if df.select(group).distinct().limit(most + 1).count() > most:
        raise ValueError(f"{group} has more than {most} values")
    sizes = sorted(((r[group], r["n"]) for r in df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[1], str(x[0])))
    load, rows = [0] * k, []
    for g, n in sizes:
        f = load.index(min(load))
        load[f] += n
        rows.append((g, f))
    table = df.sparkSession.createDataFrame(rows, f"_g {df.schema[group].dataType.simpleString()}, fold int")
    return df.join(table, df[group].eqNullSafe(table["_g"])).drop("_g")


def stratified_folds(df: DataFrame, stratum: str, k: int = 5, seed: int = 42, key: str = "ID", order: Column | None = None) -> DataFrame:
    """Folds that are equal within each stratum, by rank in an order of the rows as in k_folds."""
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)) if order is None else order)
    order = prefix_sums(hashed, "_h", {"_n": F.lit(1)}, (stratum,)).select(stratum, "_h", (F.col("_n_before") % k).cast("int").alias("fold"))
    return hashed.join(order, [stratum, "_h"]).drop("_h")


def long_scores(wide: DataFrame, models: list[str], key: str = "ID") -> DataFrame:
    """(ID, model, pred) rows."""
    return wide.unpivot([key], models, "model", "pred")


def complete_models(long: DataFrame) -> DataFrame:
    """Only models without a missing prediction."""
    gaps = long.groupBy("model").agg(F.count_if(F.col("pred").isNull()).alias("gaps")).filter("gaps = 0").select("model")
    return long.join(gaps, "model", "left_semi")


def subsets(models: list[str], least: int = 2, most: int | None = None) -> list[tuple[str, ...]]:
    return [c for n in range(least, (most or len(models)) + 1) for c in combinations(models, n)]


def rank_average(wide: DataFrame, models: list[str], key: str = "ID") -> DataFrame:
    """risk_score: the mean over models of each one's average rank."""
    long = average_ranks(long_scores(wide, models, key), "pred", "rank", ("model",))
    return long.groupBy(key).agg(F.avg("rank").alias("risk_score"))


def ensembles(wide: DataFrame, target: DataFrame, models: list[str], tau: float, most: int | None = None, key: str = "ID") -> DataFrame:
    """name, size and c_index of every model and of every rank-averaged subset, in one pass over all subsets."""
    long = settle(average_ranks(long_scores(wide, models, key), "pred", "rank", ("model",)))
    sets = [(m,) for m in models] + subsets(models, 2, most)
    members = F.explode(F.array(*[F.struct(F.lit(" + ".join(s)).alias("name"), F.lit(len(s)).alias("size"), F.array(*map(F.lit, s)).alias("of")) for s in sets]))
    scored = long.select(key, "model", "rank", members.alias("m")).filter(F.array_contains("m.of", F.col("model")))
    scored = scored.groupBy(key, F.col("m.name").alias("name"), F.col("m.size").alias("size")).agg(F.avg("rank").alias("score")).join(target, key)
    return concordance(scored, "score", train=target, tau=tau, by=("name", "size")).select("name", "size", F.col("c_index").alias("score"))


def errors(wide: DataFrame, target: DataFrame, models: list[str], key: str = "ID", time: str = "OS_YEARS", event: str = "OS_STATUS") -> DataFrame:
    """(ID, model, error): percent rank of the prediction less the true rank. The true rank is that of minus the time among events, so only
    events have one; censored rows have a NULL error."""
    long = average_ranks(long_scores(wide, models, key), "pred", "rank", ("model",), share=True)
    events = target.filter(F.col(event) == 1).select(key, (-F.col(time)).alias("_neg"))
    truth = average_ranks(events, "_neg", "truth", share=True).select(key, "truth")
    return long.join(truth, key, "left").select(key, "model", F.col("rank"), "truth", (F.col("rank") - F.col("truth")).alias("error"))


def error_summary(errs: DataFrame, key: str = "ID") -> DataFrame:
    """By row: consensus and disagreement of the models, mean and mean absolute error."""
    return errs.groupBy(key).agg(F.avg("rank").alias("consensus"), F.stddev_samp("rank").alias("disagreement"), F.avg("error").alias("mean_error"), F.avg(F.abs("error")).alias("mean_abs_error"))


def model_bias(errs: DataFrame, margin: float = 0.2) -> DataFrame:
    """By model: bias, mean absolute error, rows that it takes for safer (optimistic) or riskier (pessimistic) than they were."""
    return errs.filter("error IS NOT NULL").groupBy("model").agg(F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"), F.count_if(F.col("error") < -margin).alias("optimistic"), F.count_if(F.col("error") > margin).alias("pessimistic"))

"""Differences between samples: distances of distributions, prevalence, missing rates, groups, and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.fitted import correlations, quantiles
from tidewell.operators.ordered import prefix_sums


def long_values(df: DataFrame, columns: list[str], split: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(feature, value, in_b) rows: `split` is true for the second sample."""
    wide = df.select(*keep, split.cast("int").alias("in_b"), *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot([*keep, "in_b"], columns, "feature", "value")


def distances(long: DataFrame, least: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """By feature: Kolmogorov-Smirnov statistic and Wasserstein-1 distance of two samples, where both have `least` values."""
    keys = (*by, "feature")
    sizes = long.groupBy(*keys).agg(F.count(F.when(F.col("in_b") == 0, F.col("value"))).alias("n_a"), F.count(F.when(F.col("in_b") == 1, F.col("value"))).alias("n_b"))
    sizes = sizes.filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
    steps = prefix_sums(long.filter("value IS NOT NULL"), "value", {"a": (F.col("in_b") == 0).cast("int"), "b": F.col("in_b")}, keys, following="_next")
    steps = steps.join(sizes, list(keys))
    # gaps between the two running shares as whole numbers, in units of 1 / (n_a * n_b): their sums don't depend on the order of rows
    gap = F.abs((F.col("a") + F.col("a_before")) * F.col("n_b") - (F.col("b") + F.col("b_before")) * F.col("n_a"))
    steps = steps.select(*keys, "n_a", "n_b", gap.alias("gap"), (F.col("_next") - F.col("value")).alias("step"))
    unit = F.col("n_a") * F.col("n_b")
    return steps.groupBy(*keys, "n_a", "n_b").agg((F.max("gap") / unit).alias("ks"), (F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)) / unit).alias("wasserstein"))


def moments(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """By feature: differences of mean and of sample deviation (second less first), NULL as 0."""
    side = lambda k, f: f(F.when(F.col("in_b") == k, F.col("value")))
    return long.groupBy(*by, "feature").agg(F.coalesce(side(1, F.avg) - side(0, F.avg), F.lit(0.0)).alias("d_mean"), F.coalesce(side(1, F.stddev_samp) - side(0, F.stddev_samp), F.lit(0.0)).alias("d_std"))


def prevalence(long: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """By 0/1 feature: shares of both samples, their difference and its magnitude."""
    p = lambda k: F.avg(F.when(F.col("in_b") == k, F.col("value")))
    out = long.groupBy(*by, "feature").agg(p(0).alias("p_train"), p(1).alias("p_test"))
    return out.withColumn("delta", F.col("p_test") - F.col("p_train")).withColumn("abs_delta", F.abs("delta"))


def jensen_shannon(df: DataFrame, category: str, split: Column, by: tuple[str, ...] = (), smoothing: float = 1e-9) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm, square root) of two samples' category distributions."""
    counts = df.select(*by, F.col(category).alias("_c"), split.cast("int").alias("_b")).filter("_c IS NOT NULL").groupBy(*by, "_c").agg(F.count_if(F.col("_b") == 0).alias("a"), F.count_if(F.col("_b") == 1).alias("b"))
    totals = counts.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k")) if by else counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("k"))
    both = counts.join(totals, list(by)) if by else counts.crossJoin(F.broadcast(totals))  # one row
    both = both.withColumns({"p": (F.col("a") / F.col("ta") + smoothing) / (1 + smoothing * F.col("k")), "q": (F.col("b") / F.col("tb") + smoothing) / (1 + smoothing * F.col("k"))})
    m = (F.col("p") + F.col("q")) / 2
    term = F.col("p") * F.ln(F.col("p") / m) / 2 + F.col("q") * F.ln(F.col("q") / m) / 2
    out = F.sqrt(F.greatest(F.sum(term), F.lit(0.0))).alias("js")
    return both.groupBy(*by).agg(out) if by else both.agg(out)


def missing_rates(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(column, missing, rate) from one pass."""
    names = [c for c in columns if c not in by]
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return agg.unpivot([*by, "_n"], names, "column", "missing").select(*by, "column", "missing", F.try_divide(F.col("missing"), F.col("_n")).alias("rate"))


def missing_shift(df: DataFrame, columns: list[str], split: Column) -> DataFrame:
    """Mean over columns with any missing value of the difference in missing rate."""
    rates = missing_rates(df.withColumn("_b", split.cast("int")), columns, ("_b",))
    wide = rates.groupBy("column").agg(F.sum("missing").alias("m"), F.sum(F.when(F.col("_b") == 1, F.col("rate")).otherwise(-F.col("rate"))).alias("d"))
    return wide.filter("m > 0").agg(F.avg("d").alias("missing_delta_mean"))


def _by_fold(df: DataFrame, fold: str, folds: int) -> DataFrame:
    """Each row once for each fold `of`, with `_in` telling whether it belongs to it."""
    return df.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("_in", F.col(fold) == F.col("of"))


def fold_drift(df: DataFrame, columns: list[str], fold: str = "fold", folds: int = 5, center: str | None = None, binary: tuple[str, ...] = (), scores: DataFrame | None = None) -> DataFrame:
    """By fold (its rows against all others): mean, median and top-5 mean of KS, mean Wasserstein distance, the sum of prevalence shifts of 0/1
    columns, the mean shift of missing rates, the JS distance of centers, and the fold's scores (a table of fold and score) where given."""
    spread = _by_fold(df, fold, folds)
    d = distances(long_values(spread, columns, F.col("_in"), ("of",)), 5, ("of",))
    d = d.withColumn("_nth", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("ks"), "feature")))  # one row for each feature
    out = d.groupBy("of").agg(F.avg("ks").alias("ks_mean"), F.median("ks").alias("ks_median"), F.avg(F.when(F.col("_nth") <= 5, F.col("ks"))).alias("ks_top5"), F.avg("wasserstein").alias("w1_mean"))
    if binary:
        shifts = prevalence(long_values(spread, list(binary), F.col("_in"), ("of",)), ("of",))
        out = out.join(shifts.groupBy("of").agg(F.coalesce(F.sum("abs_delta"), F.lit(0.0)).alias("prevalence_shift")), "of")
    every = [*columns, *binary]
    rate = lambda c, side: F.avg(F.when(F.col("_in") == side, F.col(c).isNull().cast("int")))
    gaps = spread.groupBy("of").agg(*[F.when(F.count_if(F.col(c).isNull()) > 0, F.abs(rate(c, True) - rate(c, False))).alias(f"_g{i}") for i, c in enumerate(every)])
    out = out.join(gaps.select("of", F.coalesce(F.expr("try_divide(aggregate(array_compact(array(" + ", ".join(f"_g{i}" for i in range(len(every))) + ")), 0D, (s, x) -> s + x), size(array_compact(array(" + ", ".join(f"_g{i}" for i in range(len(every))) + "))))"), F.lit(0.0)).alias("missing_shift")), "of")
    if center:
        out = out.join(jensen_shannon(spread, center, F.col("_in"), ("of",)), "of")
    out = out.withColumnRenamed("of", "fold")
    return out.join(scores, "fold", "left") if scores is not None else out


def most_drifted(df: DataFrame, columns: list[str], fold: str = "fold", folds: int = 5, k: int = 20) -> DataFrame:
    """(fold, feature, ks, wasserstein, d_mean, d_std): of each fold, the k features that differ most from all other folds."""
    long = long_values(_by_fold(df, fold, folds), columns, F.col("_in"), ("of",))
    table = distances(long, 5, ("of",)).join(moments(long, ("of",)), ["of", "feature"])
    nth = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("ks"), F.desc("wasserstein"), "feature"))  # one row for each feature
    return table.withColumn("_nth", nth).filter(F.col("_nth") <= k).select(F.col("of").alias("fold"), "feature", "ks", "wasserstein", "d_mean", "d_std")


def most_variable(df: DataFrame, columns: list[str], k: int = 30) -> list[str]:
    """The k columns with the largest sample variance, ties by name."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return sorted((c for c in columns if row[c] is not None), key=lambda c: (-row[c], c))[:k]


def correlated_pairs(df: DataFrame, columns: list[str], limit: float) -> DataFrame:
    """Pairs of columns above a correlation magnitude, the strongest first."""
    names, m = correlations(df, columns)
    rows = [(names[i], names[j], float(m[i][j])) for j in range(len(names)) for i in range(j) if abs(m[i][j]) > limit]
    out = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return out.orderBy(F.desc(F.abs("r")), "a", "b")


def group_differences(df: DataFrame, columns: list[str], group: Column) -> DataFrame:
    """By feature: for 0/1 features the difference in share, for others the mean difference over the rest's deviation; largest first."""
    long = long_values(df, columns, group)
    side = lambda k, f: f(F.when(F.col("in_b") == k, F.col("value")))
    g = long.groupBy("feature").agg(F.bool_and(F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(True))).alias("is_binary"), side(1, F.avg).alias("mean_group"), side(0, F.avg).alias("mean_rest"), side(0, F.stddev_samp).alias("std_rest"))
    diff = F.col("mean_group") - F.col("mean_rest")
    return g.select("feature", "is_binary", "mean_group", "mean_rest", F.when(F.col("is_binary"), diff).otherwise(F.try_divide(diff, F.col("std_rest"))).alias("effect"))


def sanity(df: DataFrame, columns: list[str]) -> DataFrame:
    """By feature: rows, missing share, distinct values, mean, deviation, least and largest value, and whether it never varies."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    out = long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.count_distinct("value").alias("distinct"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.withColumn("constant", F.col("distinct") <= 1)


def value_shares(df: DataFrame, columns: list[str], below: int = 10) -> DataFrame:
    """Shares of the values of features that have fewer than `below`."""
    counts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "value").filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("feature").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).filter(F.col("k") < below)
    return counts.join(per, "feature").select("feature", "value", (F.col("n") / F.col("all")).alias("share"))


def top_values(df: DataFrame, columns: list[str], k: int = 5, least: int = 10) -> DataFrame:
    """(feature, value, n): the k most frequent values, as text, of columns that have at least `least` (missing counts as one); ties by value."""
    long = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in columns]).unpivot([], columns, "feature", "value")
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    many = counts.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least).select("feature")
    nth = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), F.desc("value")))  # Spark keeps k rows of each task before it deals them
    return counts.join(F.broadcast(many), "feature").withColumn("nth", nth).filter(F.col("nth") <= k).select("feature", "value", "n")


def karyotype_rules() -> dict[str, Column]:
    """What has to hold between the flags of the karyotype block."""
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    adverse = ("complex_karyotype", "monosomal_karyotype", "monosomy_7_or_del7q", "del_5q_or_mono5", "del_17p_or_i17q", "rearr_3q26")
    rules = {f"{c} is adverse": ~on(c) | on("eln_cyto_adverse") for c in adverse}
    rules["not favorable and adverse"] = ~(on("eln_cyto_favorable") & on("eln_cyto_adverse"))
    rules["normal is intermediate"] = ~on("normal_karyotype") | on("eln_cyto_intermediate")
    rules["normal is not favorable"] = ~on("normal_karyotype") | ~on("eln_cyto_favorable")
    rules["normal is not adverse"] = ~on("normal_karyotype") | ~on("eln_cyto_adverse")
    return rules


def violations(df: DataFrame, rules: dict[str, Column], key: str = "ID") -> DataFrame:
    """(key, rule) for each row that breaks a rule; a rule that can't be told isn't broken. One pass for all rules."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def summaries(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(dataset, feature, mean, median) of several tables side by side."""
    parts = [t.select(F.lit(n).alias("dataset"), *[F.col(c).cast("double").alias(c) for c in columns]) for n, t in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    long = rows.unpivot(["dataset"], columns, "feature", "value")
    return long.groupBy("dataset", "feature").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


def spearman_and_pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """Both correlations of two columns; NULL where one of them doesn't vary or fewer than 3 rows are complete."""
    from tidewell.operators.ordered import average_ranks

    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    ranked = average_ranks(average_ranks(rows, "a", "ra"), "b", "rb")

    def corr(x: str, y: str) -> Column:
        varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y)) & (F.count(F.lit(1)) >= 3)
        cov = F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
        return F.when(varied, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))

    return ranked.agg(corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def subgroup_differences(df: DataFrame, columns: list[str], group: Column, burden: str, q: float, high: bool = True, least_share: float = 0.05, least_effect: float = 0.2) -> DataFrame:
    """Group differences within the rows whose burden lies above (or below) a quantile: 0/1 features with a share of at least `least_share` on
    a side and the others with an effect of at least `least_effect`."""
    cut = quantiles(df, [burden], [q])[burden][0]
    rows = df.filter(F.col(burden) >= cut) if high else df.filter(F.col(burden) <= cut)
    out = group_differences(rows, columns, group)
    wide = F.greatest("mean_group", "mean_rest") >= least_share
    return out.filter((F.col("is_binary") & wide) | (~F.col("is_binary") & (F.abs("effect") >= least_effect)))


def compared(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """(model, mean, largest and smallest score, best) of a table of scores; one model is best, ties going to the first by name."""
    table = scores.groupBy(model).agg(F.avg(score).alias("mean"), F.max(score).alias("most"), F.min(score).alias("least"))
    best = table.orderBy(F.desc("mean"), model).limit(1).select(F.col(model).alias("_best"))
    return table.join(F.broadcast(best), table[model] == F.col("_best"), "left").withColumn("best", F.col("_best").isNotNull()).drop("_best")

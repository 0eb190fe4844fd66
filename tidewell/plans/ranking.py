"""Ranks, windows, set operations, survival and evaluation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import config as C
from tidewell.operators import clean, joins, ordered, survival
from tidewell.plans.features import _round
from tidewell.plans.fixtures import SHUFFLED, oracle, view

MODELS = ["m_a", "m_b", "m_c"]
_VALID = "SELECT ID, OS_YEARS, OS_STATUS FROM fx_target WHERE OS_YEARS > 0 AND OS_STATUS IS NOT NULL"


def _target(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_target(view(spark, d, "fx_target"))


def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return _round(ordered.average_ranks(view(spark, d, "fx_scores"), "m_a").select("ID", "rank"))


def pct_rank(spark: SparkSession, d: str) -> DataFrame:
    long = survival.long_scores(view(spark, d, "fx_scores"), MODELS)
    return _round(ordered.average_ranks(long, "pred", "rank", ("model",), share=True).select("ID", "model", "rank"))


def truth_rank(spark: SparkSession, d: str) -> DataFrame:
    events = _target(spark, d).filter("OS_STATUS = 1").withColumn("neg", -F.col("OS_YEARS"))
    return _round(ordered.average_ranks(events, "neg", "truth", share=True).select("ID", "truth"))


def row_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(ordered.row_statistics(survival.long_scores(view(spark, d, "fx_scores"), MODELS), "pred"))


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return _round(ordered.top(view(spark, d, "fx_clinical").select("ID", "CENTER", "WBC"), 5, "WBC", within=("CENTER",)))


def topk(spark: SparkSession, d: str) -> DataFrame:
    return _round(ordered.top(view(spark, d, "fx_clinical").select("ID", "PLT"), 20, "PLT"))


def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Each patient's first mutation in a total order."""
    m = view(spark, d, "fx_molecular").select("ID", "GENE", "START", "DEPTH", "CHR", "ALT", "PROTEIN_CHANGE")
    return ordered.first_by_key(m, "ID", F.coalesce("START", F.lit(0.0)), "GENE", "DEPTH", "CHR", "ALT", "PROTEIN_CHANGE")


def dedup_best(spark: SparkSession, d: str) -> DataFrame:
    """Of equal variants of a patient, the deepest."""
    m = view(spark, d, "fx_molecular").select("ID", "GENE", "EFFECT", "DEPTH", "START")
    return ordered.first_by_key(m, ["ID", "GENE", "EFFECT"], F.col("DEPTH").desc(), "START")


def set_diff(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    return joins.differences(m.filter("CAST(CHR AS INT) % 3 < 2").withColumn("v", F.concat("GENE", F.lit("@"), "CHR")), m.filter("CAST(CHR AS INT) % 3 > 0").withColumn("v", F.concat("GENE", F.lit("@"), "CHR")), "v")


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "fx_clinical")
    return joins.common(c.filter("WBC > 100"), c.filter("PLT > 300"), "ID")


def outer_join_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    a = m.filter("GENE = 'TP53'").groupBy("ID").agg(F.count(F.lit(1)).alias("tp53"))
    b = m.filter("GENE = 'NPM1'").groupBy("ID").agg(F.count(F.lit(1)).alias("npm1"))
    return joins.outer_blocks([a, b])


def count_addition(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    return joins.added_counts(m.filter("CAST(CHR AS INT) % 2 = 1"), m.filter("CAST(CHR AS INT) % 2 = 0"), "GENE")


def merge_new_columns(spark: SparkSession, d: str) -> DataFrame:
    c, t = view(spark, d, "fx_clinical").select("ID", "HB"), view(spark, d, "fx_target").withColumn("HB", F.lit(-1.0))
    return _round(joins.add_new_columns(c, t))


def variant_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A dimension by a derived key, with a second derived key where the first finds nothing."""
    m = view(spark, d, "fx_molecular")
    dim = m.filter("GENE = 'TP53'").select(F.concat("CHR", F.lit("-"), "GENE").alias("k")).distinct().withColumn("note", F.concat(F.lit("by "), "k"))
    rows = m.select("ID", "CHR", "GENE", "ALT").distinct()
    return joins.lookup(rows, dim, F.concat("CHR", F.lit("-"), "GENE"), "k", F.when(F.col("ALT") == "CT", F.concat("CHR", F.lit("-TP53"))))


def fill_missing_text(spark: SparkSession, d: str) -> DataFrame:
    """Missing karyotypes filled with the sorted distinct effects of the patient's mutations."""
    events = view(spark, d, "fx_molecular").groupBy("ID").agg(F.array_join(F.sort_array(F.collect_set("EFFECT")), "; ").alias("events"))
    return joins.fill_from(view(spark, d, "fx_clinical").select("ID", "CYTOGENETICS"), events, "CYTOGENETICS", "events")


def km_censoring(spark: SparkSession, d: str) -> DataFrame:
    return _round(survival.kaplan_meier(_target(spark, d), censoring=True))


def km_events(spark: SparkSession, d: str) -> DataFrame:
    return _round(survival.kaplan_meier(_target(spark, d)))


def _km(censoring: bool) -> str:
    f = "1 - q::DOUBLE / greatest(r - e, 1)" if censoring else "1 - e::DOUBLE / r"
    return f"""WITH v AS ({_VALID}), g AS (SELECT OS_YEARS, sum(OS_STATUS)::BIGINT AS e, (count(*) - sum(OS_STATUS))::BIGINT AS q FROM v GROUP BY OS_YEARS),
      s AS (SELECT *, (sum(e + q) OVER (ORDER BY OS_YEARS DESC))::BIGINT AS r FROM g), f AS (SELECT *, {f} AS f FROM s)
      SELECT OS_YEARS, r AS at_risk, e AS events, q AS censored, round(CASE WHEN min(f) OVER (ORDER BY OS_YEARS) <= 0 THEN 0 ELSE exp(sum(CASE WHEN f > 0 THEN ln(f) ELSE 0 END) OVER (ORDER BY OS_YEARS)) END, 6) AS survival FROM f"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_scores").join(view(spark, d, "fx_target").filter("OS_STATUS IS NOT NULL"), "ID")


def cindex_ipcw(spark: SparkSession, d: str) -> DataFrame:
    return survival.concordance(_scored(spark, d), "m_a", tau=C.TAU).select(F.round("c_index", 8).alias("c_index"), "comparable")


_CINDEX = """WITH v AS (SELECT t.OS_YEARS AS t, t.OS_STATUS AS e, s.m_a AS s FROM fx_target t JOIN fx_scores s USING (ID) WHERE t.OS_STATUS IS NOT NULL),
  g AS (SELECT t, sum(e)::BIGINT AS e, (count(*) - sum(e))::BIGINT AS q FROM v GROUP BY t), r AS (SELECT *, (sum(e + q) OVER (ORDER BY t DESC))::BIGINT AS r FROM g),
  k AS (SELECT t, exp(sum(ln(1 - q::DOUBLE / greatest(r - e, 1) + CASE WHEN q = r - e AND q > 0 THEN 1 ELSE 0 END)) OVER (ORDER BY t)) AS surv FROM r),
  c AS (SELECT t, s, e, count(*) AS n FROM v GROUP BY t, s, e),
  i AS (SELECT c.t, c.s, c.n, 1 / (k.surv * k.surv) AS w FROM c JOIN k USING (t) WHERE c.e = 1 AND c.t < 7),
  p AS (SELECT i.w * i.n * j.n AS w, i.n * j.n AS m, CASE WHEN i.s > j.s THEN 1.0::DOUBLE WHEN i.s = j.s THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS c FROM i JOIN c j ON j.t > i.t OR (j.t = i.t AND j.e = 0))
  SELECT round(sum(w * c) / sum(w), 8) AS c_index, sum(m)::BIGINT AS comparable FROM p"""


def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    """Folds that keep centers whole."""
    return survival.group_folds(view(spark, d, "fx_clinical").select("ID", "CENTER"), "CENTER")


def kfold(spark: SparkSession, d: str) -> DataFrame:
    return survival.k_folds(view(spark, d, "fx_clinical").select("ID"), order=F.expr(SHUFFLED))


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return survival.stratified_folds(_target(spark, d).select("ID", "OS_STATUS"), "OS_STATUS", order=F.expr(SHUFFLED))


def rank_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return _round(survival.rank_average(view(spark, d, "fx_scores"), MODELS))


def ensemble_search(spark: SparkSession, d: str) -> DataFrame:
    target = _target(spark, d)
    wide = view(spark, d, "fx_scores").join(target.select("ID"), "ID")
    return _round(survival.ensembles(wide, target, MODELS, C.TAU))


def _ensembles_sql() -> str:
    """Every model and every rank-averaged subset, each pair of rows compared."""
    ranks = ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2.0::DOUBLE AS {m}" for m in MODELS)
    sets = " UNION ALL ".join(
        f"SELECT t, e, '{' + '.join(c)}' AS name, {len(c)} AS size, ({' + '.join(c)}) / {len(c)} AS s FROM r" for n in range(1, len(MODELS) + 1) for c in combinations(MODELS, n)
    )
    return f"""WITH v AS ({_VALID}), r AS (SELECT OS_YEARS AS t, OS_STATUS AS e, {ranks} FROM fx_scores JOIN v USING (ID)),
      g AS (SELECT t, sum(e)::BIGINT AS e, (count(*) - sum(e))::BIGINT AS q FROM r GROUP BY t), h AS (SELECT *, (sum(e + q) OVER (ORDER BY t DESC))::BIGINT AS r FROM g),
      k AS (SELECT t, exp(sum(ln(1 - q::DOUBLE / greatest(r - e, 1) + CASE WHEN q = r - e AND q > 0 THEN 1 ELSE 0 END)) OVER (ORDER BY t)) AS surv FROM h),
      c AS (SELECT name, size, t, s, e, count(*) AS n FROM ({sets}) GROUP BY ALL),
      i AS (SELECT name, size, c.t, c.s, c.n, 1 / (k.surv * k.surv) AS w FROM c JOIN k USING (t) WHERE c.e = 1 AND c.t < {C.TAU}),
      p AS (SELECT name, i.size, i.w * i.n * j.n AS w, CASE WHEN i.s > j.s THEN 1.0::DOUBLE WHEN i.s = j.s THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS c FROM i JOIN c j USING (name) WHERE j.t > i.t OR (j.t = i.t AND j.e = 0))
      SELECT name, size, round(sum(w * c) / sum(w), 6) AS score FROM p GROUP BY name, size"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    target = _target(spark, d)
    return survival.errors(view(spark, d, "fx_scores").join(target.select("ID"), "ID"), target, MODELS)


def error_analysis(spark: SparkSession, d: str) -> DataFrame:
    return _round(survival.error_summary(_errors(spark, d)))


def model_bias(spark: SparkSession, d: str) -> DataFrame:
    return _round(survival.model_bias(_errors(spark, d)))


def outlier_ids(spark: SparkSession, d: str) -> DataFrame:
    summary = survival.error_summary(_errors(spark, d)).withColumn("mean_abs_error", F.round("mean_abs_error", 6))
    return ordered.top(summary.filter("mean_abs_error IS NOT NULL").select("ID", "mean_abs_error"), 50, "mean_abs_error")


_RANKED = "WITH v AS ({valid}), w AS (SELECT s.* FROM fx_scores s JOIN v USING (ID)), l AS (UNPIVOT w ON m_a, m_b, m_c INTO NAME model VALUE pred), r AS (SELECT ID, model, (rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model) AS rank FROM l), u AS (SELECT ID, (rank() OVER (ORDER BY -OS_YEARS) + (count(*) OVER (PARTITION BY OS_YEARS) - 1) / 2.0::DOUBLE) / count(*) OVER () AS truth FROM v WHERE OS_STATUS = 1), x AS (SELECT r.ID, model, rank, rank - truth AS error FROM r LEFT JOIN u USING (ID))".replace("{valid}", _VALID)

QUERIES = {
    f.__name__: f
    for f in (
        avg_rank, pct_rank, truth_rank, row_stats, topk_per_group, topk, first_per_key, dedup_best, set_diff, set_intersection, outer_join_blocks, count_addition, merge_new_columns, variant_lookup,
        fill_missing_text, km_censoring, km_events, cindex_ipcw, group_kfold, kfold, stratified_folds, rank_ensemble, ensemble_search, error_analysis, model_bias, outlier_ids,
    )
}

_S = ("fx_scores",)
ORACLES = {
    "avg_rank": oracle("SELECT ID, rank() OVER (ORDER BY m_a) + (count(*) OVER (PARTITION BY m_a) - 1) / 2.0::DOUBLE AS rank FROM fx_scores", *_S),
    "pct_rank": oracle("WITH l AS (UNPIVOT fx_scores ON m_a, m_b, m_c INTO NAME model VALUE pred) SELECT ID, model, round((rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY model), 6) AS rank FROM l", *_S),
    "truth_rank": oracle(f"WITH v AS ({_VALID}) SELECT ID, round((rank() OVER (ORDER BY -OS_YEARS) + (count(*) OVER (PARTITION BY OS_YEARS) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS truth FROM v WHERE OS_STATUS = 1", "fx_target"),
    "row_stats": oracle("WITH l AS (UNPIVOT fx_scores ON m_a, m_b, m_c INTO NAME model VALUE pred) SELECT ID, round(avg(pred), 6) AS mean, round(stddev_samp(pred), 6) AS std, round(avg(abs(pred)), 6) AS mean_abs FROM l GROUP BY ID", *_S),
    "topk_per_group": oracle("SELECT ID, CENTER, round(WBC, 6) AS WBC FROM fx_clinical QUALIFY row_number() OVER (PARTITION BY CENTER ORDER BY WBC DESC NULLS LAST, ID) <= 5", "fx_clinical"),
    "topk": oracle("SELECT ID, PLT FROM fx_clinical ORDER BY PLT DESC NULLS LAST, ID LIMIT 20", "fx_clinical"),
    "first_per_key": oracle("SELECT ID, GENE, START, DEPTH, CHR, ALT, PROTEIN_CHANGE FROM fx_molecular QUALIFY row_number() OVER (PARTITION BY ID ORDER BY coalesce(START, 0), GENE, DEPTH, CHR, ALT, PROTEIN_CHANGE) = 1", "fx_molecular"),
    "dedup_best": oracle("SELECT ID, GENE, EFFECT, DEPTH, START FROM fx_molecular QUALIFY row_number() OVER (PARTITION BY ID, GENE, EFFECT ORDER BY DEPTH DESC, START) = 1", "fx_molecular"),
    "set_diff": oracle("WITH a AS (SELECT DISTINCT GENE || '@' || CHR AS v FROM fx_molecular WHERE CAST(CHR AS INT) % 3 < 2), b AS (SELECT DISTINCT GENE || '@' || CHR AS v FROM fx_molecular WHERE CAST(CHR AS INT) % 3 > 0) SELECT v, 'added' AS change FROM (SELECT v FROM b EXCEPT SELECT v FROM a) UNION ALL SELECT v, 'removed' FROM (SELECT v FROM a EXCEPT SELECT v FROM b)", "fx_molecular"),
    "set_intersection": oracle("SELECT ID FROM fx_clinical WHERE WBC > 100 INTERSECT SELECT ID FROM fx_clinical WHERE PLT > 300", "fx_clinical"),
    "outer_join_blocks": oracle("SELECT coalesce(a.ID, b.ID) AS ID, coalesce(tp53, 0) AS tp53, coalesce(npm1, 0) AS npm1 FROM (SELECT ID, count(*) AS tp53 FROM fx_molecular WHERE GENE = 'TP53' GROUP BY ID) a FULL JOIN (SELECT ID, count(*) AS npm1 FROM fx_molecular WHERE GENE = 'NPM1' GROUP BY ID) b ON a.ID = b.ID", "fx_molecular"),
    "count_addition": oracle("SELECT GENE, count(*) AS n FROM fx_molecular GROUP BY GENE", "fx_molecular"),
    "merge_new_columns": oracle("SELECT c.ID, c.HB, t.OS_YEARS, t.OS_STATUS FROM fx_clinical c LEFT JOIN fx_target t USING (ID)", "fx_clinical", "fx_target"),
    "variant_lookup": oracle("WITH dim AS (SELECT DISTINCT CHR || '-' || GENE AS k FROM fx_molecular WHERE GENE = 'TP53'), r AS (SELECT DISTINCT ID, CHR, GENE, ALT FROM fx_molecular) SELECT r.ID, r.CHR, r.GENE, r.ALT, coalesce('by ' || a.k, 'by ' || b.k) AS note FROM r LEFT JOIN dim a ON a.k = CHR || '-' || GENE LEFT JOIN dim b ON a.k IS NULL AND ALT = 'CT' AND b.k = CHR || '-TP53'", "fx_molecular"),
    "fill_missing_text": oracle("WITH e AS (SELECT ID, string_agg(DISTINCT EFFECT, '; ' ORDER BY EFFECT) AS events FROM fx_molecular GROUP BY ID) SELECT c.ID, CASE WHEN coalesce(trim(CYTOGENETICS), '') = '' THEN events ELSE CYTOGENETICS END AS CYTOGENETICS FROM fx_clinical c LEFT JOIN e USING (ID)", "fx_clinical", "fx_molecular"),
    "km_censoring": oracle(_km(True), "fx_target"),
    "km_events": oracle(_km(False), "fx_target"),
    "cindex_ipcw": oracle(_CINDEX, "fx_target", "fx_scores"),
    "ensemble_search": oracle(_ensembles_sql(), "fx_target", "fx_scores"),
    "rank_ensemble": oracle("WITH l AS (UNPIVOT fx_scores ON m_a, m_b, m_c INTO NAME model VALUE pred), r AS (SELECT ID, rank() OVER (PARTITION BY model ORDER BY pred) + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0::DOUBLE AS rank FROM l) SELECT ID, round(avg(rank), 6) AS risk_score FROM r GROUP BY ID", *_S),
    "error_analysis": oracle(_RANKED + " SELECT ID, round(avg(rank), 6) AS consensus, round(stddev_samp(rank), 6) AS disagreement, round(avg(error), 6) AS mean_error, round(avg(abs(error)), 6) AS mean_abs_error FROM x GROUP BY ID", "fx_target", "fx_scores"),
    "model_bias": oracle(_RANKED + " SELECT model, round(avg(error), 6) AS bias, round(avg(abs(error)), 6) AS mae, count(*) FILTER (error < -0.2) AS optimistic, count(*) FILTER (error > 0.2) AS pessimistic FROM x WHERE error IS NOT NULL GROUP BY model", "fx_target", "fx_scores"),
    "outlier_ids": oracle(_RANKED + " SELECT ID, round(avg(abs(error)), 6) AS mean_abs_error FROM x GROUP BY ID HAVING avg(abs(error)) IS NOT NULL ORDER BY mean_abs_error DESC, ID LIMIT 50", "fx_target", "fx_scores"),
    "kfold": oracle(f"SELECT ID, ((row_number() OVER (ORDER BY {SHUFFLED}) - 1) % 5)::INT AS fold FROM fx_clinical", "fx_clinical"),
    "stratified_folds": oracle(f"WITH v AS ({_VALID}) SELECT ID, OS_STATUS, ((row_number() OVER (PARTITION BY OS_STATUS ORDER BY {SHUFFLED}) - 1) % 5)::INT AS fold FROM v", "fx_target"),
    "group_kfold": oracle("""WITH RECURSIVE g AS (SELECT CENTER, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CENTER) AS i FROM fx_clinical GROUP BY CENTER),
      s AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0 AS fold UNION ALL SELECT g.i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN g.n ELSE 0 END), (list_position(loads, list_min(loads)) - 1)::INT FROM s JOIN g ON g.i = s.i + 1)
      SELECT ID, CENTER, fold FROM fx_clinical JOIN g USING (CENTER) JOIN s USING (i)""", "fx_clinical"),
}

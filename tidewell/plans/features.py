"""Cleaning, clinical, mutation and karyotype queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import config as C
from tidewell.operators import clean, clinical, joins, karyotype, mutations
from tidewell.operators.ordered import in_shares
from tidewell.plans.fixtures import SHUFFLED, oracle, view
from tidewell.plans.karyotypes import block


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few decimals, since engines add them up in different orders."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def _cases(rules: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in rules.items())


_RANGED = "SELECT ID, CENTER, CYTOGENETICS, " + ", ".join(f"CASE WHEN {c} BETWEEN {lo} AND {hi} THEN {c} END AS {c}" for c, (lo, hi) in C.RANGES.items()) + " FROM fx_clinical"
_VALID = "SELECT ID, OS_YEARS, OS_STATUS FROM fx_target WHERE OS_YEARS > 0 AND OS_STATUS IS NOT NULL"
_TRUSTED = """((VAF BETWEEN 0 AND 1 AND DEPTH >= 10) IS TRUE OR EFFECT = 'ITD' OR contains(PROTEIN_CHANGE, 'ITD')
  OR (GENE IN ('MLL', 'KMT2A') AND (contains(EFFECT, 'PTD') OR contains(PROTEIN_CHANGE, 'PTD'))))"""
_FLAGS = {n: f"CASE WHEN {c} {op} {v} THEN 1 ELSE 0 END" for n, (c, op, v) in C.THRESHOLDS.items()}
_FEATURES = f"""SELECT *, {_cases({f"{c}_missing": f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in C.MEASURES})},
  CASE WHEN {" AND ".join(f"{c} IS NULL" for c in C.MEASURES)} THEN 1 ELSE 0 END AS clinical_all_missing,
  {_cases({n: f"round({a} / nullif({b}, 0), 6)" for n, (a, b) in C.RATIOS.items()})}, {_cases(_FLAGS)},
  {_cases({n: " + ".join(_FLAGS[p] for p in parts) for n, parts in C.SCORES.items()})},
  CASE WHEN {" + ".join(_FLAGS[p] for p in C.SCORES["cytopenia_score"])} >= 3 THEN 1 ELSE 0 END AS pancytopenia FROM ranged"""


def _clinical(spark: SparkSession, d: str) -> DataFrame:
    return clean.within(clean.to_numbers(view(spark, d, "fx_clinical"), C.MEASURES), C.RANGES)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return clinical.clinical_features(_clinical(spark, d), C.MEASURES, C.RATIOS, C.THRESHOLDS, C.SCORES, C.SCORE_FLAGS)


def center_summary(spark: SparkSession, d: str) -> DataFrame:
    """By center: patients, event rate, mean cytopenia score and median WBC of valid patients."""
    rows = joins.inner(_features(spark, d), clean.clean_target(view(spark, d, "fx_target")))
    return _round(rows.groupBy("CENTER").agg(F.count(F.lit(1)).alias("patients"), F.avg("OS_STATUS").alias("event_rate"), F.avg("cytopenia_score").alias("cytopenia"), F.median("WBC").alias("wbc_median")))


def clean_clinical_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(joins.inner(_features(spark, d), clean.clean_target(view(spark, d, "fx_target"))))


def target_clean(spark: SparkSession, d: str) -> DataFrame:
    return _round(clean.clean_target(view(spark, d, "fx_target")))


def target_summary(spark: SparkSession, d: str) -> DataFrame:
    t = clean.clean_target(view(spark, d, "fx_target"))
    return _round(t.agg(F.count(F.lit(1)).alias("n"), F.avg("OS_STATUS").alias("event_rate"), F.median("OS_YEARS").alias("median_time")))


def scan_clinical(spark: SparkSession, d: str) -> DataFrame:
    return _round(view(spark, d, "fx_clinical"))


def scan_molecular(spark: SparkSession, d: str) -> DataFrame:
    return _round(view(spark, d, "fx_molecular"))


def range_to_null(spark: SparkSession, d: str) -> DataFrame:
    return _round(_clinical(spark, d))


def mutation_quality_filter(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    target = in_shares(clean.clean_target(view(spark, d, "fx_target")), "ID", m.count()).hint("merge")  # the join deals the mutations likewise
    rows = clean.clean_mutations(m, target)
    return _round(rows.groupBy("ID", "GENE").agg(F.count(F.lit(1)).alias("n"), F.max("VAF").alias("vaf"), F.sum("DEPTH").alias("depth")))


def semi_anti_ids(spark: SparkSession, d: str) -> DataFrame:
    c, t = view(spark, d, "fx_clinical"), clean.clean_target(view(spark, d, "fx_target"))
    return clean.of_patients(c, t).select("ID", F.lit("in").alias("side")).unionByName(clean.without_patients(c, t).select("ID", F.lit("out").alias("side")))


def schema_align_union(spark: SparkSession, d: str) -> DataFrame:
    """A cohort with fewer columns and overlapping ids, put under the main table."""
    main = view(spark, d, "fx_clinical").select("ID", "CENTER", "WBC", "HB").filter("CENTER <> 'CTR_0'")
    other = view(spark, d, "fx_clinical").select("ID", "WBC").filter("CENTER IN ('CTR_0', 'CTR_1')")
    return _round(joins.stack({"main": main, "cohort": clean.aligned(clean.without_patients(other, main), main)}, "cohort"))


def iqr_winsorize(spark: SparkSession, d: str) -> DataFrame:
    return _round(clean.winsorized(view(spark, d, "fx_clinical").select("ID", "WBC", "PLT"), ["WBC", "PLT"]))


def formula_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "fx_clinical").select("ID", "WBC", "ANC", "HB", "PLT")
    out = clinical.formulas(rows, ["ANC/WBC", "PLT-HB", "WBC*HB", "ANC<HB", "logPLT"])
    return _round(out.select("ID", F.col("`ANC/WBC`").alias("q"), F.col("`PLT-HB`").alias("diff"), F.col("`WBC*HB`").alias("prod"), F.col("`ANC<HB`").alias("less"), F.col("logPLT").alias("lg")))


def placeholder_targets(spark: SparkSession, d: str) -> DataFrame:
    return clean.placeholder_target(view(spark, d, "fx_clinical"))


def row_sample(spark: SparkSession, d: str) -> DataFrame:
    return clean.sampled(view(spark, d, "fx_clinical").select("ID", "CENTER"), 100, order=F.expr(SHUFFLED))


def _mutations(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_mutations(view(spark, d, "fx_molecular"))


def mutation_presence(spark: SparkSession, d: str) -> DataFrame:
    patients = view(spark, d, "fx_clinical").select("ID")
    return mutations.with_blocks(patients, mutations.by_patient(_mutations(spark, d), mutations.presence(C.GENES)))


def vaf_features(spark: SparkSession, d: str) -> DataFrame:
    return _round(mutations.by_patient(_mutations(spark, d), mutations.allele_fractions(C.VAF_THRESHOLDS)))


def mutation_types(spark: SparkSession, d: str) -> DataFrame:
    return mutations.by_patient(_mutations(spark, d), mutations.kinds(C.MUTATION_TYPES))


def pathway_features(spark: SparkSession, d: str) -> DataFrame:
    return mutations.by_patient(_mutations(spark, d), mutations.pathways(C.PATHWAYS))


def burden(spark: SparkSession, d: str) -> DataFrame:
    return _round(mutations.by_patient(_mutations(spark, d), mutations.burden()))


_EFFECTS = ["non_synonymous_codon", "stop_gained", "frameshift_variant", "ITD", "splice_site_variant", "PTD"]


def category_pivot(spark: SparkSession, d: str) -> DataFrame:
    return mutations.by_patient(_mutations(spark, d), mutations.categories("EFFECT", _EFFECTS, "impact_"))


def frequent_genes(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    return mutations.frequent(C.GENES, 5, m.filter("CAST(CHR AS INT) % 2 = 1"), m.filter("CAST(CHR AS INT) % 2 = 0"))


def base_counts(spark: SparkSession, d: str) -> DataFrame:
    return mutations.by_patient(view(spark, d, "fx_molecular"), mutations.base_counts("ALT"), mutations.spans())


def patient_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return _round(mutations.patient_totals(view(spark, d, "fx_molecular"), _EFFECTS))


def variant_ids(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_molecular")
    return m.select("ID", mutations.variant_id().alias("vid"), mutations.variant_id(snv_only=True).alias("snv"), mutations.chromosome_number().alias("chromosome"), mutations.amino_position().alias("aa")).distinct()


def _molecular(spark: SparkSession, d: str) -> DataFrame:
    m = mutations.by_patient(_mutations(spark, d), mutations.presence(C.GENES), mutations.allele_fractions(C.VAF_THRESHOLDS), mutations.kinds(C.MUTATION_TYPES))
    return mutations.with_blocks(view(spark, d, "fx_clinical").select("ID"), m)


def comutation(spark: SparkSession, d: str) -> DataFrame:
    out = mutations.comutations(_molecular(spark, d), C.COMUTATIONS, C.PATHWAYS)
    return _round(out.select("ID", "NPM1_pos_FLT3_neg", "double_hit_spliceosome_hits", "double_hit_spliceosome", "triple_hit_epigenetic_hits", "triple_hit_epigenetic", "vaf_ratio_FLT3_NPM1"))


def risk_label(spark: SparkSession, d: str) -> DataFrame:
    f, a = ([f"mut_{g}" for g in x] for x in (C.FAVORABLE_GENES, C.ADVERSE_GENES))
    return mutations.molecular_risk(_molecular(spark, d), f, a).select("ID", "eln_mol_favorable", "eln_mol_intermediate", "eln_mol_adverse")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    base = view(spark, d, "fx_clinical").select("ID", F.when(F.col("CYTOGENETICS").like("46,X_[20]"), 1).otherwise(0).alias("normal_karyotype"), F.when(F.col("CYTOGENETICS") == "complex", 1).otherwise(0).alias("complex_karyotype"))
    out, _ = mutations.interactions(base.join(_molecular(spark, d), "ID"), C.INTERACTIONS)
    return out.select("ID", "cyto_normal_mol_favorable", "cyto_normal_mol_adverse", "cyto_complex_and_mol_tp53")


def molecular_block(spark: SparkSession, d: str) -> DataFrame:
    """All mutation features in one aggregation, joined to all patients."""
    m = mutations.by_patient(_mutations(spark, d), mutations.presence(C.GENES), mutations.allele_fractions(C.VAF_THRESHOLDS), mutations.kinds(C.MUTATION_TYPES), mutations.pathways(C.PATHWAYS), mutations.burden(), mutations.categories("EFFECT", _EFFECTS, "impact_"), apart=mutations.APART)
    return _round(mutations.with_blocks(view(spark, d, "fx_clinical").select("ID"), m))


_KARYO_FLAGS = ["trisomy_8", "plus_21", "del_5q_or_mono5", "monosomy_7_or_del7q", "del_17p_or_i17q", "del_12p", "chromosome_count", "hypodiploidy", "hyperdiploidy", "SEX_XX", "SEX_XY", "cp_max", "cyto_is_missing", "sex_chromosome_loss_count"]


def karyotype_flags(spark: SparkSession, d: str) -> DataFrame:
    return karyotype.cytogenetics(view(spark, d, "fx_clinical")).select("ID", *[F.col(c).cast("double").alias(c) for c in _KARYO_FLAGS])


def _karyotypes(df: DataFrame) -> DataFrame:
    out = karyotype.cytogenetics(df)
    return _round(out.select("ID", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "ID"]))


def karyotype_clones(spark: SparkSession, d: str) -> DataFrame:
    return _karyotypes(view(spark, d, "fx_clinical"))


def karyotype_mixtures(spark: SparkSession, d: str) -> DataFrame:
    """The whole block for texts of many kinds: several clones, inherited events, ranges, rings, markers, pooled cells."""
    return _karyotypes(view(spark, d, "fx_karyotypes"))


def karyotype_quick_risk(spark: SparkSession, d: str) -> DataFrame:
    return karyotype.quick_risk(view(spark, d, "fx_clinical")).select("ID", "aux_cyto_adverse", "aux_cyto_favorable", "aux_cyto_intermediate")


_MT = f"mt AS (SELECT * FROM fx_molecular WHERE {_TRUSTED})"
_PRESENT = {f"mut_{g}": f"CAST(max(CASE WHEN GENE = '{g}' THEN 1 ELSE 0 END) AS INT)" for g in C.GENES}
_VAFS = {f"{g}_max_VAF": f"round(coalesce(max(CASE WHEN GENE = '{g}' THEN VAF END), 0), 6)" for g in C.VAF_THRESHOLDS} | {
    f"{g}_high_VAF": f"CASE WHEN max(CASE WHEN GENE = '{g}' THEN VAF END) >= {v}" + (" OR bool_or(GENE = 'FLT3' AND EFFECT = 'ITD')" if g == "FLT3" else "") + " THEN 1 ELSE 0 END" for g, v in C.VAF_THRESHOLDS.items()
}
_KINDS = {
    n: f"CASE WHEN count(*) FILTER (GENE = '{r['gene']}') >= {r['least']} THEN 1 ELSE 0 END" if "least" in r else f"CASE WHEN bool_or(GENE = '{r['gene']}' AND regexp_matches({r['column']}, '(?i){r['pattern']}')) THEN 1 ELSE 0 END"
    for n, r in C.MUTATION_TYPES.items()
}
_IN = {n: "(" + ", ".join(f"'{g}'" for g in gs) + ")" for n, gs in C.PATHWAYS.items()}
_PATHS = {k: v for n in C.PATHWAYS for k, v in ((f"{n}_altered", f"CASE WHEN bool_or(GENE IN {_IN[n]}) THEN 1 ELSE 0 END"), (f"{n}_count", f"count(*) FILTER (GENE IN {_IN[n]})"))} | {
    "pathway_diversity_score": "CAST(" + " + ".join(f"CASE WHEN bool_or(GENE IN {_IN[n]}) THEN 1 ELSE 0 END" for n in C.PATHWAYS) + " AS INT)"
}
_BURDEN = {
    "total_mutations": "count(*)", "vaf_mean": "round(avg(VAF), 6)", "vaf_median": "round(median(VAF), 6)", "vaf_max": "round(max(VAF), 6)",
    "vaf_std": "round(coalesce(stddev_samp(VAF), 0), 6)", "high_vaf_mutations": "count(*) FILTER (VAF > 0.4)", "high_vaf_ratio": "round(count(*) FILTER (VAF > 0.4) / count(*), 6)",
}
_IMPACT = {f"impact_{e}": f"count(*) FILTER (EFFECT = '{e}')" for e in _EFFECTS}


def _grouped(cols: dict[str, str], source: str = "mt") -> str:
    return f"WITH {_MT} SELECT ID, {_cases(cols)} FROM {source} GROUP BY ID"


def _zeroed(cols: dict[str, str]) -> str:
    return f"WITH {_MT}, g AS (SELECT ID, {_cases(cols)} FROM mt GROUP BY ID) SELECT c.ID, {', '.join(f'coalesce(g.{n}, 0) AS {n}' for n in cols)} FROM fx_clinical c LEFT JOIN g USING (ID)"


_MOL = f"{_MT}, g AS (SELECT ID, {_cases(_PRESENT | _VAFS | _KINDS)} FROM mt GROUP BY ID), mol AS (SELECT c.ID, {', '.join(f'coalesce(g.{n}, 0) AS {n}' for n in _PRESENT | _VAFS | _KINDS)} FROM fx_clinical c LEFT JOIN g USING (ID))"
_HITS = {n: " + ".join(f"mut_{g}" for g in C.PATHWAYS[p] if g in C.GENES) for n, p in (("s", "RNA_splicing"), ("e", "DNA_methylation"))}
_MAIN = ("fx_clinical", "fx_molecular", "fx_target")

QUERIES = {
    f.__name__: f
    for f in (
        center_summary, clean_clinical_features, target_clean, target_summary, scan_clinical, scan_molecular, range_to_null, mutation_quality_filter, semi_anti_ids, schema_align_union, iqr_winsorize,
        formula_columns, placeholder_targets, row_sample, mutation_presence, vaf_features, mutation_types, pathway_features, burden, category_pivot, frequent_genes, base_counts, patient_aggregates,
        variant_ids, comutation, risk_label, interactions, molecular_block, karyotype_flags, karyotype_clones, karyotype_mixtures, karyotype_quick_risk,
    )
}

ORACLES = {
    "center_summary": oracle(f"WITH ranged AS ({_RANGED}), f AS ({_FEATURES}), t AS ({_VALID}) SELECT CENTER, count(*) AS patients, round(avg(OS_STATUS), 6) AS event_rate, round(avg(cytopenia_score), 6) AS cytopenia, round(median(WBC), 6) AS wbc_median FROM f JOIN t USING (ID) GROUP BY CENTER", "fx_clinical", "fx_target"),
    "clean_clinical_features": oracle(f"WITH ranged AS ({_RANGED}), f AS ({_FEATURES}), t AS ({_VALID}) SELECT * REPLACE (round(WBC, 6) AS WBC) FROM f JOIN t USING (ID)", "fx_clinical", "fx_target"),
    "target_clean": oracle(_VALID, "fx_target"),
    "target_summary": oracle(f"SELECT count(*) AS n, round(avg(OS_STATUS), 6) AS event_rate, median(OS_YEARS) AS median_time FROM ({_VALID})", "fx_target"),
    "scan_clinical": oracle("SELECT * REPLACE (round(WBC, 6) AS WBC) FROM fx_clinical", "fx_clinical"),
    "scan_molecular": oracle("SELECT * REPLACE (round(VAF, 6) AS VAF) FROM fx_molecular", "fx_molecular"),
    "range_to_null": oracle(f"SELECT * REPLACE (round(WBC, 6) AS WBC) FROM ({_RANGED})", "fx_clinical"),
    "mutation_quality_filter": oracle(f"SELECT ID, GENE, count(*) AS n, round(max(VAF), 6) AS vaf, sum(DEPTH) AS depth FROM fx_molecular WHERE {_TRUSTED} AND ID IN (SELECT ID FROM ({_VALID})) GROUP BY ID, GENE", "fx_molecular", "fx_target"),
    "semi_anti_ids": oracle(f"SELECT ID, CASE WHEN ID IN (SELECT ID FROM ({_VALID})) THEN 'in' ELSE 'out' END AS side FROM fx_clinical", "fx_clinical", "fx_target"),
    "schema_align_union": oracle("SELECT ID, CENTER, round(WBC, 6) AS WBC, HB, 'main' AS cohort FROM fx_clinical WHERE CENTER <> 'CTR_0' UNION ALL SELECT ID, NULL, round(WBC, 6), NULL, 'cohort' FROM fx_clinical WHERE CENTER = 'CTR_0'", "fx_clinical"),
    "iqr_winsorize": oracle("WITH q AS (SELECT quantile_cont(WBC, 0.25) AS a, quantile_cont(WBC, 0.75) AS b, quantile_cont(PLT, 0.25) AS c, quantile_cont(PLT, 0.75) AS d FROM fx_clinical) SELECT ID, CASE WHEN WBC IS NOT NULL THEN round(least(greatest(WBC, a - 1.5::DOUBLE * (b - a)), b + 1.5::DOUBLE * (b - a)), 6) END AS WBC, CASE WHEN PLT IS NOT NULL THEN round(least(greatest(PLT, c - 1.5::DOUBLE * (d - c)), d + 1.5::DOUBLE * (d - c)), 6) END AS PLT FROM fx_clinical, q", "fx_clinical"),
    "formula_columns": oracle("SELECT ID, round(ANC / nullif(WBC, 0), 6) AS q, round(PLT - HB, 6) AS diff, round(WBC * HB, 6) AS prod, CASE WHEN ANC < HB THEN 1 ELSE 0 END AS less, round(ln(1 + PLT), 6) AS lg FROM fx_clinical", "fx_clinical"),
    "placeholder_targets": oracle("SELECT ID, 1.0::DOUBLE AS OS_YEARS, 0 AS OS_STATUS FROM fx_clinical", "fx_clinical"),
    "row_sample": oracle(f"SELECT ID, CENTER FROM fx_clinical ORDER BY {SHUFFLED} LIMIT 100", "fx_clinical"),
    "mutation_presence": oracle(_zeroed(_PRESENT), *_MAIN[:2]),
    "vaf_features": oracle(_grouped(_VAFS), "fx_molecular"),
    "mutation_types": oracle(_grouped(_KINDS), "fx_molecular"),
    "pathway_features": oracle(_grouped(_PATHS), "fx_molecular"),
    "burden": oracle(_grouped(_BURDEN), "fx_molecular"),
    "category_pivot": oracle(_grouped(_IMPACT), "fx_molecular"),
    "frequent_genes": oracle("SELECT GENE, count(*) AS n FROM fx_molecular WHERE GENE IN (" + ", ".join(f"'{g}'" for g in C.GENES) + ") GROUP BY GENE HAVING count(*) >= 5", "fx_molecular"),
    "base_counts": oracle("SELECT ID, " + ", ".join(f"CAST(sum(length(ALT) - length(replace(ALT, '{x}', ''))) AS BIGINT) AS ALT_{x}" for x in "ACGT") + ', sum(coalesce("END" - START + 1, 0)) AS span_sum FROM fx_molecular GROUP BY ID', "fx_molecular"),
    "patient_aggregates": oracle("WITH r AS (SELECT *, \"END\" - START + 1 AS len, TRY_CAST(nullif(regexp_extract(PROTEIN_CHANGE, 'p\\.[A-Za-z*]+(\\d+)', 1), '') AS DOUBLE) AS aa FROM fx_molecular) SELECT ID, " + ", ".join(f"count(*) FILTER (EFFECT = '{e}') AS effect_{e}" for e in _EFFECTS) + ", sum(len) AS mut_length_sum, avg(len) AS mut_length_mean, max(len) AS mut_length_max, sum(aa) AS aa_sum, round(avg(aa), 6) AS aa_mean, min(aa) AS aa_min, max(aa) AS aa_max, count(*) AS n_mutations, count(DISTINCT GENE) AS n_genes, round(avg(CASE WHEN VAF > 0.3 THEN 1 ELSE 0 END), 6) AS share_high_vaf FROM r GROUP BY ID", "fx_molecular"),
    "variant_ids": oracle("WITH v AS (SELECT *, concat('chr', CHR, ':g.', CAST(CAST(START AS BIGINT) AS VARCHAR), REF, '>', ALT) AS vid FROM fx_molecular) SELECT DISTINCT ID, vid, CASE WHEN length(REF) = 1 AND length(ALT) = 1 THEN vid END AS snv, CAST(CHR AS INT) AS chromosome, TRY_CAST(nullif(regexp_extract(PROTEIN_CHANGE, 'p\\.[A-Za-z*]+(\\d+)', 1), '') AS DOUBLE) AS aa FROM v", "fx_molecular"),
    "comutation": oracle(f"WITH {_MOL} SELECT ID, CASE WHEN mut_NPM1 = 1 AND mut_FLT3 = 0 THEN 1 ELSE 0 END AS NPM1_pos_FLT3_neg, {_HITS['s']} AS double_hit_spliceosome_hits, CASE WHEN {_HITS['s']} >= 2 THEN 1 ELSE 0 END AS double_hit_spliceosome, {_HITS['e']} AS triple_hit_epigenetic_hits, CASE WHEN {_HITS['e']} >= 3 THEN 1 ELSE 0 END AS triple_hit_epigenetic, CASE WHEN FLT3_max_VAF > 0 AND NPM1_max_VAF > 0 THEN round(FLT3_max_VAF / (NPM1_max_VAF + 1e-6), 6) ELSE 0 END AS vaf_ratio_FLT3_NPM1 FROM mol", *_MAIN[:2]),
    "risk_label": oracle(f"WITH {_MOL}, l AS (SELECT ID, CASE WHEN greatest({', '.join(f'mut_{g}' for g in C.ADVERSE_GENES if g in C.GENES)}) = 1 THEN 'a' WHEN greatest(mut_NPM1, mut_CEBPA) = 1 THEN 'f' ELSE 'i' END AS l FROM mol) SELECT ID, CAST(l = 'f' AS INT) AS eln_mol_favorable, CAST(l = 'i' AS INT) AS eln_mol_intermediate, CAST(l = 'a' AS INT) AS eln_mol_adverse FROM l", *_MAIN[:2]),
    "interactions": oracle(f"WITH {_MOL} SELECT ID, CASE WHEN CYTOGENETICS LIKE '46,X_[20]' AND (mut_NPM1 = 1 OR CEBPA_biallelic = 1) AND FLT3_ITD = 0 THEN 1 ELSE 0 END AS cyto_normal_mol_favorable, CASE WHEN CYTOGENETICS LIKE '46,X_[20]' AND FLT3_ITD = 1 THEN 1 ELSE 0 END AS cyto_normal_mol_adverse, CASE WHEN CYTOGENETICS = 'complex' AND mut_TP53 = 1 THEN 1 ELSE 0 END AS cyto_complex_and_mol_tp53 FROM mol JOIN fx_clinical USING (ID)", *_MAIN[:2]),
    "molecular_block": oracle(_zeroed(_PRESENT | _VAFS | _KINDS | _PATHS | _BURDEN | _IMPACT), *_MAIN[:2]),
    "karyotype_flags": oracle(
        r"""WITH k AS (SELECT ID, CYTOGENETICS AS raw, regexp_replace(regexp_replace(regexp_replace(CYTOGENETICS, '([+-]\s*[xyXY])\s*\[[0-9]+\]', '\1', 'g'), '(?i)([+-]\s*m(?:ar)?[a-z0-9]*)\s*\[[0-9]+\]', '\1', 'g'), '(?i)([+-]\s*r[a-z0-9]*)\s*\[[0-9]+\]', '\1', 'g') AS t FROM fx_clinical),
        f AS (SELECT ID, t, regexp_matches(t, '\+\s*8([^0-9]|$)') AS a, regexp_matches(t, '\+\s*21([^0-9]|$)') AS b, regexp_matches(t, '-\s*5([^0-9]|$)|del\s*\(\s*5\s*\)\s*\(q') AS c, regexp_matches(t, '-\s*7([^0-9]|$)|del\s*\(\s*7\s*\)\s*\(q') AS d,
          regexp_matches(t, 'del\s*\(\s*17\s*\)\s*\(p|i\s*\(\s*17\s*\)\s*\(q|17p-') AS e, regexp_matches(t, 'del\s*\(\s*12\s*\)\s*\(p') AS g, TRY_CAST(nullif(regexp_extract(t, '^\s*(\d+)', 1), '') AS DOUBLE) AS n FROM k)
        SELECT ID, COLUMNS(* EXCLUDE (ID))::DOUBLE FROM (SELECT ID, CASE WHEN t IS NULL THEN 1 ELSE 0 END AS cyto_is_missing, CAST(a AS INT) AS trisomy_8, CAST(b AS INT) AS plus_21, CAST(c AS INT) AS del_5q_or_mono5, CAST(d AS INT) AS monosomy_7_or_del7q, CAST(e AS INT) AS del_17p_or_i17q, CAST(g AS INT) AS del_12p,
          n AS chromosome_count, CASE WHEN t IS NOT NULL THEN CAST(coalesce(n < 46, false) AS INT) END AS hypodiploidy, CASE WHEN t IS NOT NULL THEN CAST(coalesce(n >= 49, false) AS INT) END AS hyperdiploidy,
          CAST(regexp_matches(t, '(?i)XX') AND NOT regexp_matches(t, '(?i)XY') AS INT) AS SEX_XX, CAST(regexp_matches(t, '(?i)XY') AS INT) AS SEX_XY,
          CASE WHEN t IS NOT NULL THEN coalesce(TRY_CAST(nullif(regexp_extract(t, '\[cp(\d+)\]', 1), '') AS INT), 0) END AS cp_max, len(regexp_extract_all(t, '(?i)-\s*[xy]')) AS sex_chromosome_loss_count FROM f)""",
        "fx_clinical",
    ),
    "karyotype_clones": block("fx_clinical"),
    "karyotype_mixtures": block("fx_karyotypes"),
    "karyotype_quick_risk": oracle(r"""WITH k AS (SELECT ID, coalesce(CYTOGENETICS, '') AS t FROM fx_clinical), f AS (SELECT ID, t, regexp_matches(t, '(?i)complex|-\s*7([^0-9]|$)|-\s*5([^0-9]|$)|del\s*\(\s*17\s*\)\s*\(p|inv\s*\(\s*3\s*\)') AS a, regexp_matches(t, '(?i)t\s*\(\s*8\s*;\s*21\s*\)|inv\s*\(\s*16\s*\)|t\s*\(\s*16\s*;\s*16\s*\)|t\s*\(\s*15\s*;\s*17\s*\)') AS v FROM k) SELECT ID, CAST(t <> '' AND a AS INT) AS aux_cyto_adverse, CAST(t <> '' AND v AND NOT a AS INT) AS aux_cyto_favorable, CAST(t <> '' AND NOT v AND NOT a AS INT) AS aux_cyto_intermediate FROM f""", "fx_clinical"),
}

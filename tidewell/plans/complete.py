"""Queries of whole feature sets and of the older variants."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import clinical, drift, genes, legacy, mutations, prepare, survival
from tidewell.operators.ordered import settle, shared_path
from tidewell.plans.features import _RANGED, _TRUSTED, _VALID, _clinical, _round
from tidewell.plans.fixtures import oracle, view
from tidewell.plans.karyotypes import summaries
from tidewell.sources import cohorts


def karyotype_summary_v1(spark: SparkSession, d: str) -> DataFrame:
    out = legacy.karyotype_summary(view(spark, d, "fx_clinical").select("ID", "CYTOGENETICS"), version=1)
    return _round(out.select("ID", *[F.col(c).cast("double").alias(c) for c in ("num_subclones", "num_translocations", "num_deletions", "num_inversions", "num_additions", "num_monosomies", "num_trisomies", "total_mitoses")]))


def karyotype_summary_v3(spark: SparkSession, d: str) -> DataFrame:
    return _round(legacy.karyotype_summary(view(spark, d, "fx_clinical").select("ID", "CYTOGENETICS"), version=3))


def karyotype_summaries(spark: SparkSession, d: str) -> DataFrame:
    """All four versions of the older summary, every column, for karyotypes of many kinds."""
    texts = view(spark, d, "fx_karyotypes")
    made = [legacy.karyotype_summary(texts, version=v).drop("CYTOGENETICS").withColumn("version", F.lit(v)) for v in (1, 2, 3, 4)]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)
    return _round(out.select("ID", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "ID"]))


def full_features(spark: SparkSession, d: str) -> DataFrame:
    """All blocks, with gene flags, tiers and arms, significances and scores that follow from the mutation rows."""
    m = view(spark, d, "fx_molecular")
    of_gene = genes.gene_dimension(m.withColumns({"is_oncogene": F.length("GENE") % 2, "is_tumor_suppressor": 1 - F.length("GENE") % 2, "cosmic_has_missense_common": F.lit(1), "tier": F.length("GENE") % 2 + 1, "band": F.lit("17p13.1")}), "GENE", ["is_oncogene", "is_tumor_suppressor", "cosmic_has_missense_common"], "tier", ("band",))
    vid = m.select(mutations.variant_id().alias("vid"), "DEPTH").groupBy("vid").agg(F.max("DEPTH").alias("depth"))
    said = vid.select("vid", F.when(F.col("depth") > 25, "Pathogenic").otherwise("Benign").alias("CLNSIG"), F.col("depth").alias("score"))
    known = prepare.Annotations(settle(of_gene.withColumn("arm", genes.arm("band")).drop("band")), said, said)
    impact = F.element_at(F.array(*map(F.lit, mutations.IMPACTS)), (1 + F.col("DEPTH") % 4).cast("int"))
    return prepare.features(_clinical(spark, d).drop("CENTER"), m.withColumn("IMPACT", impact), known, extra=True)


def preprocessed_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = view(spark, d, "fx_clinical")
    out, _ = prepare.matrix(c, view(spark, d, "fx_molecular"), view(spark, d, "fx_target"), c.filter("CAST(substr(ID, 2) AS BIGINT) % 4 = 0"))
    return out


def integrated_scores(spark: SparkSession, d: str) -> DataFrame:
    t = view(spark, d, "fx_scores")
    rows = t.select("ID", F.floor("m_a").cast("int").alias("total_mutations"), (F.col("m_b") % 4).cast("int").alias("cytopenia_score"), (F.col("m_c") % 3).cast("int").alias("proliferation_score"), (F.col("m_a") % 2).cast("int").alias("normal_karyotype"), (F.col("m_b") % 3).alias("eln_molecular_risk"), (F.col("m_c") % 3).alias("eln_cyto_risk"))
    return _round(legacy.integrated_scores(rows))


def harmonised_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Mutation rows written in another cohort's layout and brought back; rows of unknown samples go."""
    m = view(spark, d, "fx_molecular")
    other = m.select(
        F.concat(F.lit("S-"), "ID").alias("Tumor_Sample_Barcode"), F.col("DEPTH").cast("int").cast("string").alias("t_ref_count"), F.lit("5").alias("t_alt_count"), F.col("REF").alias("Tumor_Seq_Allele1"), F.when(F.col("ALT") != "CT", F.col("ALT")).otherwise("-").alias("Tumor_Seq_Allele2"),
        F.when(F.col("PROTEIN_CHANGE") != "p.R882H", F.col("PROTEIN_CHANGE")).alias("HGVSp_Short"), F.lit("p.Arg882His").alias("HGVSp"), F.concat(F.lit("chr"), "CHR").alias("Chromosome"), F.col("START").cast("string").alias("Start_Position"), F.col("END").cast("string").alias("End_Position"),
        F.col("REF").alias("Reference_Allele"), F.col("GENE").alias("Hugo_Symbol"), F.col("EFFECT").alias("Consequence"),
    )
    samples = view(spark, d, "fx_clinical").filter("CENTER <> 'CTR_3'").select(F.concat(F.lit("S-"), "ID").alias("SAMPLE_ID"), F.col("ID").alias("PATIENT_ID"))
    out = genes.harmonised_mutations(other, samples, "Tumor_Sample_Barcode", "SAMPLE_ID", "PATIENT_ID")
    return _round(out.groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.sum("DEPTH").alias("depth"), F.count_if(F.col("PROTEIN_CHANGE") == "p.R882H").alias("r882h")))


def subgroup_drivers(spark: SparkSession, d: str) -> DataFrame:
    c = _clinical(spark, d).withColumns({"wbc_missing": F.col("WBC").isNull().cast("int"), "burden": F.expr("CAST(CAST(substr(ID, 2) AS BIGINT) % 10 AS DOUBLE)")})
    return _round(drift.subgroup_differences(c, ["ANC", "HB", "wbc_missing"], F.col("CENTER") == "CTR_1", "burden", 0.5, least_effect=0.0))


def compared_models(spark: SparkSession, d: str) -> DataFrame:
    long = survival.long_scores(view(spark, d, "fx_scores"), ["m_a", "m_b", "m_c"])
    return _round(drift.compared(long.withColumnRenamed("pred", "score")))


def harmonised_clinic(spark: SparkSession, d: str) -> DataFrame:
    """Patients and structural events of a cohort with sample barcodes, in the common layout."""
    c, m = view(spark, d, "fx_clinical"), view(spark, d, "fx_molecular")
    sv = m.filter("EFFECT IN ('ITD', 'PTD')").select(F.concat("ID", F.lit("-03")).alias("Sample_Id"), F.col("GENE").alias("Site1_Hugo_Symbol"), F.lit("GENE2").alias("Site2_Hugo_Symbol"), F.lit("SOMATIC").alias("SV_Status"), F.concat("GENE", F.lit(" "), "EFFECT").alias("Event_info"))
    events = genes.structural_events(sv, genes.patient_of_barcode(F.col("Sample_Id")), {"Site1_Hugo_Symbol": "SITE1_GENE", "Site2_Hugo_Symbol": "SITE2_GENE", "SV_Status": "SV_STATUS", "Event_info": "EVENT_INFO"})
    patients = c.select(F.col("ID").alias("PATIENT_ID"), F.col("BM_BLAST").cast("string").alias("BM_BLAST_PERCENTAGE"), F.col("WBC").cast("string").alias("WBC"), "CYTOGENETICS")
    out = genes.harmonised_clinic(patients, events, "COHORT", {"PATIENT_ID": "ID", "BM_BLAST_PERCENTAGE": "BM_BLAST", "WBC": "WBC", "CYTOGENETICS": "CYTOGENETICS"}, ["BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT"], ["ID", "CENTER", "BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT", "CYTOGENETICS"])
    return _round(out)


def cohort_from_files(spark: SparkSession, d: str) -> DataFrame:
    """A cohort written as the files of its layout and brought into the common tables: its patients with their mutations and target."""
    c, m, t, at = (*(view(spark, d, f"fx_{v}") for v in ("clinical", "molecular", "target")), shared_path(spark, "cohort"))
    text = lambda col: F.col(col).cast("long").cast("string")
    sample = F.concat("ID", F.lit("-03"))
    status = F.concat(F.col("OS_STATUS").cast("string"), F.when(F.col("OS_STATUS") == 1, ":DECEASED").otherwise(":LIVING"))
    tables = {
        "patient": c.join(t, "ID").select(F.col("ID").alias("PATIENT_ID"), F.coalesce(F.col("BM_BLAST").cast("string"), F.lit("NA")).alias("BM_BLAST_PERCENTAGE"), "WBC", "CYTOGENETICS", status.alias("OS_STATUS"), (F.col("OS_YEARS") * 12).alias("OS_MONTHS")),
        "mutations": m.select(
            F.col("GENE").alias("Hugo_Symbol"), F.col("CHR").alias("Chromosome"), text("START").alias("Start_Position"), text("END").alias("End_Position"), F.col("REF").alias("Reference_Allele"), F.col("REF").alias("Tumor_Seq_Allele1"),
            F.when(F.col("ALT") != "CT", F.col("ALT")).otherwise("-").alias("Tumor_Seq_Allele2"), sample.alias("Tumor_Sample_Barcode"), text("DEPTH").alias("t_ref_count"), F.lit("5").alias("t_alt_count"),
            F.when(F.col("PROTEIN_CHANGE") != "p.R882H", F.col("PROTEIN_CHANGE")).alias("HGVSp_Short"), F.lit("p.Arg882His").alias("HGVSp"), F.col("EFFECT").alias("Consequence"),
        ),
        "structural": m.filter("EFFECT IN ('ITD', 'PTD')").select(sample.alias("Sample_Id"), F.col("GENE").alias("Site1_Hugo_Symbol"), F.lit("GENE2").alias("Site2_Hugo_Symbol"), F.lit("SOMATIC").alias("SV_Status"), F.concat("GENE", F.lit(" "), "EFFECT").alias("Event_info")),
    }
    for name, rows in tables.items():
        rows.write.option("sep", "\t").option("header", True).csv(f"{at}/{name}")
    out = cohorts.harmonised(spark, {name: f"{at}/{name}" for name in tables}, replace(cohorts.BY_PATIENT, center="COHORT"))
    by = out["molecular"].groupBy("ID").agg(F.count(F.lit(1)).alias("n"), F.sum("DEPTH").alias("depth"), F.max("VAF").alias("vaf"), F.count_if(F.col("ALT") == F.col("REF")).alias("first_allele"), F.count_if(F.col("PROTEIN_CHANGE") == "p.Arg882His").alias("long_protein"))
    return _round(out["clinical"].join(by, "ID", "left").join(out["target"], "ID", "left"))


def karyotype_audit(spark: SparkSession, d: str) -> DataFrame:
    """Flags from the digits of the id against the rules that they have to keep."""
    n = F.expr("CAST(substr(ID, 2) AS BIGINT)")
    names = ("complex_karyotype", "monosomal_karyotype", "monosomy_7_or_del7q", "del_5q_or_mono5", "del_17p_or_i17q", "rearr_3q26", "eln_cyto_favorable", "eln_cyto_adverse", "normal_karyotype", "eln_cyto_intermediate")
    flags = view(spark, d, "fx_clinical").select("ID", *[F.when(n % (i + 2) != 1, (n % (i + 3) == 0).cast("int")).alias(c) for i, c in enumerate(names)])
    return drift.violations(flags, drift.karyotype_rules())


def frequent_values(spark: SparkSession, d: str) -> DataFrame:
    return drift.top_values(view(spark, d, "fx_clinical"), ["CENTER", "CYTOGENETICS"])


def feature_subset(spark: SparkSession, d: str) -> DataFrame:
    """The core set of a table that has some of its columns."""
    from tidewell import config as C
    from tidewell.operators import clean

    return _round(clean.choose(view(spark, d, "fx_clinical"), C.FEATURE_SETS["core"])[0])


def rare_group_flags(spark: SparkSession, d: str) -> DataFrame:
    """Rare columns put together before they would be dropped."""
    from tidewell.operators import fitted

    m = view(spark, d, "fx_molecular").groupBy("ID").agg(*[F.max((F.col("GENE") == g).cast("int")).alias(f"mut_{g}") for g in ("STAT3", "KDM6A", "PTPN11")])
    return fitted.rare_aggregates(m, {"any_rare": (["mut_STAT3", "mut_KDM6A", "absent"], "any"), "n_rare": (["mut_STAT3", "mut_KDM6A", "mut_PTPN11"], "sum")})


def latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The last of many runs, by time and then by name."""
    from tidewell.operators import ordered

    e = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.col("o_orderdate").cast("string").alias("created_at"))
    return ordered.latest(e)


def extra_interactions(spark: SparkSession, d: str) -> DataFrame:
    from tidewell import config as C

    m = mutations.by_patient(view(spark, d, "fx_molecular"), mutations.presence(["RUNX1", "ASXL1", "STAG2"]))
    c = view(spark, d, "fx_clinical").select("ID", (F.col("BM_BLAST") > 20).cast("int").alias("high_blast_count"), (F.col("PLT") < 50).cast("int").alias("thrombocytopenia_severe"))
    out, _ = mutations.interactions(mutations.with_blocks(c, m), C.EXTRA_INTERACTIONS)
    return out.select("ID", *C.EXTRA_INTERACTIONS)


def log_features(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms of measures from 0 on."""
    return _round(_clinical(spark, d).withColumns(clinical.log_columns(["WBC", "ANC", "PLT"])).select("ID", "log_WBC", "log_ANC", "log_PLT"))


def percent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cell counts from a total and a percentage."""
    return _round(_clinical(spark, d).select("ID", clinical.percent_of("PLT", "BM_BLAST").alias("blasts")))


def cleaned_tables(spark: SparkSession, d: str) -> DataFrame:
    """The three cleaned tables together: rows and patients of each."""
    from tidewell import config as C
    from tidewell.operators import clean

    tables = clean.clean_tables(view(spark, d, "fx_clinical"), view(spark, d, "fx_molecular"), view(spark, d, "fx_target"), C.MEASURES, C.RANGES)
    facts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("ID").alias("patients")) for n, t in zip(("clinical", "molecular", "target"), tables, strict=True)]
    return facts[0].unionByName(facts[1]).unionByName(facts[2])


QUERIES = {f.__name__: f for f in (harmonised_mutations, cohort_from_files, subgroup_drivers, compared_models, karyotype_summary_v1, karyotype_summary_v3, karyotype_summaries, full_features, preprocessed_matrix, integrated_scores, harmonised_clinic, karyotype_audit, frequent_values, feature_subset, rare_group_flags, latest_run, extra_interactions, log_features, percent_counts, cleaned_tables)}

_N = lambda p: f"coalesce(len(list_filter(flatten(list_transform(string_split(lower(CYTOGENETICS), '/'), lambda c: string_split(regexp_replace(c, '\\[\\d+\\]', '', 'g'), ','))), lambda x: regexp_matches(x, '{p}'))), 0)::DOUBLE"
_RULES = [f"SELECT ID, '{c} is adverse' AS rule FROM f WHERE {c} = 1 AND coalesce(eln_cyto_adverse, 0) <> 1" for c in ("complex_karyotype", "monosomal_karyotype", "monosomy_7_or_del7q", "del_5q_or_mono5", "del_17p_or_i17q", "rearr_3q26")] + [
    "SELECT ID, 'not favorable and adverse' FROM f WHERE eln_cyto_favorable = 1 AND eln_cyto_adverse = 1",
    "SELECT ID, 'normal is intermediate' FROM f WHERE normal_karyotype = 1 AND coalesce(eln_cyto_intermediate, 0) <> 1",
    "SELECT ID, 'normal is not favorable' FROM f WHERE normal_karyotype = 1 AND eln_cyto_favorable = 1",
    "SELECT ID, 'normal is not adverse' FROM f WHERE normal_karyotype = 1 AND eln_cyto_adverse = 1",
]

ORACLES = {
    "karyotype_summaries": summaries("fx_karyotypes"),
    "log_features": oracle("SELECT ID, " + ", ".join(f"CASE WHEN {c} >= 0 THEN round(ln(1 + {c}), 6) END AS log_{c}" for c in ("WBC", "ANC", "PLT")) + f" FROM ({_RANGED})", "fx_clinical"),
    "percent_counts": oracle(f"SELECT ID, round(PLT * BM_BLAST / 100, 6) AS blasts FROM ({_RANGED})", "fx_clinical"),
    "cleaned_tables": oracle(
        f"WITH t AS ({_VALID}) SELECT 'clinical' AS name, count(*) AS n, count(DISTINCT ID) AS patients FROM fx_clinical WHERE ID IN (SELECT ID FROM t)"
        f" UNION ALL SELECT 'molecular', count(*), count(DISTINCT ID) FROM fx_molecular WHERE {_TRUSTED} AND ID IN (SELECT ID FROM t)"
        " UNION ALL SELECT 'target', count(*), count(DISTINCT ID) FROM t", "fx_clinical", "fx_molecular", "fx_target",
    ),
    "harmonised_clinic": oracle("WITH e AS (SELECT ID, string_agg(DISTINCT GENE || ' ' || EFFECT, '; ' ORDER BY GENE || ' ' || EFFECT) AS ev FROM fx_molecular WHERE EFFECT IN ('ITD', 'PTD') GROUP BY ID) SELECT ID, 'COHORT' AS CENTER, BM_BLAST, round(WBC, 6) AS WBC, NULL::DOUBLE AS ANC, NULL::DOUBLE AS MONOCYTES, NULL::DOUBLE AS HB, NULL::DOUBLE AS PLT, coalesce(nullif(CYTOGENETICS, ''), ev, '') AS CYTOGENETICS FROM fx_clinical LEFT JOIN e USING (ID)", "fx_clinical", "fx_molecular"),
    "cohort_from_files": oracle(
        "WITH e AS (SELECT ID, string_agg(DISTINCT GENE || ' ' || EFFECT, '; ' ORDER BY GENE || ' ' || EFFECT) AS ev FROM fx_molecular WHERE EFFECT IN ('ITD', 'PTD') GROUP BY ID),"
        " m AS (SELECT ID, count(*) AS n, sum(DEPTH + 5) AS depth, max(round_even(5 / (DEPTH + 5), 4)) AS vaf, count(*) FILTER (ALT = 'CT' OR ALT = REF) AS first_allele, count(*) FILTER (PROTEIN_CHANGE = 'p.R882H') AS long_protein FROM fx_molecular GROUP BY ID)"
        " SELECT ID, 'COHORT' AS CENTER, BM_BLAST, round(WBC, 6) AS WBC, NULL::DOUBLE AS ANC, NULL::DOUBLE AS MONOCYTES, NULL::DOUBLE AS HB, NULL::DOUBLE AS PLT, coalesce(nullif(CYTOGENETICS, ''), ev, '') AS CYTOGENETICS,"
        " n, depth, vaf, first_allele, long_protein, CASE WHEN OS_STATUS IS NOT NULL THEN round(OS_YEARS * 12 / 12, 6) END AS OS_YEARS, OS_STATUS"
        " FROM fx_clinical JOIN fx_target USING (ID) LEFT JOIN e USING (ID) LEFT JOIN m USING (ID)", "fx_clinical", "fx_molecular", "fx_target",
    ),
    "karyotype_audit": oracle("WITH f AS (SELECT ID, " + ", ".join(f"CASE WHEN CAST(substr(ID, 2) AS BIGINT) % {i + 2} <> 1 THEN (CAST(substr(ID, 2) AS BIGINT) % {i + 3} = 0)::INT END AS {c}" for i, c in enumerate(("complex_karyotype", "monosomal_karyotype", "monosomy_7_or_del7q", "del_5q_or_mono5", "del_17p_or_i17q", "rearr_3q26", "eln_cyto_favorable", "eln_cyto_adverse", "normal_karyotype", "eln_cyto_intermediate"))) + " FROM fx_clinical) " + " UNION ALL ".join(_RULES), "fx_clinical"),
    "frequent_values": oracle("WITH l AS (SELECT 'CENTER' AS feature, coalesce(CENTER, 'missing') AS value FROM fx_clinical UNION ALL SELECT 'CYTOGENETICS', coalesce(CYTOGENETICS, 'missing') FROM fx_clinical), n AS (SELECT feature, value, count(*) AS n, count(*) OVER (PARTITION BY feature) AS k FROM l GROUP BY feature, value) SELECT feature, value, n FROM n WHERE k >= 10 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value DESC) <= 5", "fx_clinical"),
    "feature_subset": oracle("SELECT ID, BM_BLAST, round(WBC, 6) AS WBC, ANC, MONOCYTES, HB, PLT FROM fx_clinical", "fx_clinical"),
    "rare_group_flags": oracle("WITH g AS (SELECT ID, max((GENE = 'STAT3')::INT) AS mut_STAT3, max((GENE = 'KDM6A')::INT) AS mut_KDM6A, max((GENE = 'PTPN11')::INT) AS mut_PTPN11 FROM fx_molecular GROUP BY ID) SELECT *, greatest(mut_STAT3, mut_KDM6A) AS any_rare, mut_STAT3 + mut_KDM6A + mut_PTPN11 AS n_rare FROM g", "fx_molecular"),
    "latest_run": "SELECT concat('run-', CAST(o_orderkey AS VARCHAR)) AS run_id, CAST(o_orderdate AS VARCHAR) AS created_at FROM orders ORDER BY created_at DESC, run_id DESC LIMIT 1",
    "extra_interactions": oracle("WITH g AS (SELECT ID, max((GENE = 'RUNX1')::INT) AS r, max((GENE IN ('ASXL1', 'STAG2'))::INT) AS o FROM fx_molecular GROUP BY ID) SELECT ID, (coalesce(r, 0) = 1 AND coalesce(o, 0) = 1)::INT AS lucky_high_burden_survivor, coalesce(BM_BLAST > 20 AND PLT < 50, false)::INT AS unlucky_low_burden_aggressive FROM fx_clinical LEFT JOIN g USING (ID)", "fx_clinical", "fx_molecular"),
    "harmonised_mutations": oracle("WITH j AS (SELECT ID, CHR, START, \"END\", REF, CASE WHEN ALT = 'CT' THEN REF ELSE ALT END AS ALT, GENE, PROTEIN_CHANGE, EFFECT, DEPTH + 5 AS DEPTH FROM fx_molecular WHERE ID IN (SELECT ID FROM fx_clinical WHERE CENTER <> 'CTR_3')), f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY ID, CHR, START, \"END\", REF, ALT, GENE ORDER BY DEPTH DESC, PROTEIN_CHANGE, EFFECT) = 1) SELECT ID, count(*) AS n, sum(DEPTH) AS depth, count(*) FILTER (PROTEIN_CHANGE = 'p.R882H') AS r882h FROM f GROUP BY ID", "fx_clinical", "fx_molecular"),
    "subgroup_drivers": oracle("WITH r AS (SELECT CENTER = 'CTR_1' AS g, CASE WHEN ANC BETWEEN 0 AND 100 THEN ANC END AS ANC, CASE WHEN HB BETWEEN 2 AND 25 THEN HB END AS HB, (WBC IS NULL OR WBC NOT BETWEEN 0 AND 400)::INT::DOUBLE AS wbc_missing, (CAST(substr(ID, 2) AS BIGINT) % 10)::DOUBLE AS b FROM fx_clinical), k AS (SELECT * FROM r WHERE b >= (SELECT quantile_cont(b, 0.5) FROM r)), l AS (UNPIVOT k ON ANC, HB, wbc_missing INTO NAME feature VALUE value), s AS (SELECT feature, bool_and(value IN (0, 1)) AS is_binary, avg(value) FILTER (g) AS mg, avg(value) FILTER (NOT g) AS mr, stddev_samp(value) FILTER (NOT g) AS sr FROM l GROUP BY feature) SELECT feature, is_binary, round(mg, 6) AS mean_group, round(mr, 6) AS mean_rest, round(CASE WHEN is_binary THEN mg - mr ELSE (mg - mr) / sr END, 6) AS effect FROM s WHERE NOT is_binary OR greatest(mg, mr) >= 0.05", "fx_clinical"),
    "compared_models": oracle("WITH l AS (UNPIVOT fx_scores ON m_a, m_b, m_c INTO NAME model VALUE pred), t AS (SELECT model, avg(pred) AS m, max(pred) AS most, min(pred) AS least FROM l GROUP BY model) SELECT model, round(m, 6) AS mean, most, least, m = max(m) OVER () AS best FROM t", "fx_scores"),
    "karyotype_summary_v1": oracle(
        "SELECT ID, coalesce(len(string_split(CYTOGENETICS, '/')), 0)::DOUBLE AS num_subclones, "
        + ", ".join(f"{_N(p)} AS {n}" for n, p in {"num_translocations": r"t\(\d+;\d+\)", "num_deletions": r"del\(", "num_inversions": r"inv\(", "num_additions": r"add\(", "num_monosomies": r"-\d+", "num_trisomies": r"\+\d+"}.items())
        + r", coalesce(list_sum(list_transform(regexp_extract_all(CYTOGENETICS, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT))), 0)::DOUBLE AS total_mitoses FROM fx_clinical",
        "fx_clinical",
    ),
    "integrated_scores": oracle(
        """WITH r AS (SELECT ID, CAST(m_a AS INT) AS total_mutations, CAST(m_b % 4 AS INT) AS cytopenia_score, CAST(m_c % 3 AS INT) AS proliferation_score, CAST(m_a % 2 AS INT) AS normal_karyotype, m_b % 3 AS eln_molecular_risk, m_c % 3 AS eln_cyto_risk FROM fx_scores),
        s AS (SELECT *, CASE WHEN normal_karyotype = 1 THEN eln_molecular_risk ELSE greatest(eln_cyto_risk, eln_molecular_risk) END AS e, total_mutations::DOUBLE / max(total_mutations) OVER () AS b, cytopenia_score + proliferation_score AS c FROM r)
        SELECT ID, total_mutations, cytopenia_score, proliferation_score, normal_karyotype, eln_molecular_risk, eln_cyto_risk, e AS eln_integrated_risk, round(b, 6) AS mutation_burden_score, CASE WHEN total_mutations <= 2 THEN 0 WHEN total_mutations <= 5 THEN 1 ELSE 2 END AS mutation_burden_category, c AS clinical_risk_score, round(e * 0.4::DOUBLE + c::DOUBLE / max(c) OVER () * 0.3::DOUBLE + b * 0.3::DOUBLE, 6) AS comprehensive_risk_score FROM s""",
        "fx_scores",
    ),
}

"""Cohorts of both layouts from files to tables."""

from __future__ import annotations

import pytest

from tidewell.sources import cohorts

MUTATIONS = "Hugo_Symbol\tChromosome\tStart_Position\tEnd_Position\tReference_Allele\tTumor_Seq_Allele1\tTumor_Seq_Allele2\tTumor_Sample_Barcode\tt_ref_count\tt_alt_count\tHGVSp_Short\tHGVSp\tConsequence\n"
SITES = "Site1_Hugo_Symbol\tSite2_Hugo_Symbol\tSV_Status"


def put(folder, **texts):
    for name, text in texts.items():
        (folder / name).write_text(text)
    return {name: str(folder / name) for name in texts}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cohort_by_sample(spark, tmp_path):
    files = put(
        tmp_path,
        sample="#note\nPATIENT_ID\tSAMPLE_ID\tCENTER_ID\tKARYOTYPE\tTIME_OF_SAMPLE_COLLECTION_RELATIVE_TO_INCLUSION\n"
        "p1\ts1_BA2\t3\t46,XX\t9\np1\tBA1\tCENTER_4\tNA\t1\np2\tBA3\t\t46,XY\tx\np3\tBA4\t7\t\t2\n",
        blood="ENTITY_STABLE_ID\tNAME\tBA1\tBA3\tother\nPERC_BLASTS_IN_BM\tb\t40\tNA\t1\nWBC_COUNT\tw\t8\t2\t1\nPERC_NEUTROPHILS_IN_PB\tn\t50\t10\t1\n"
        "PERC_MONOCYTES_IN_PB\tm\t25\t>5\t1\nHEMOGLOBIN\th\t9.5\t10\t1\nPLATELET_COUNT\tp\t100\t50\t1\nFURTHER\tx\t1\t1\t1\n",
        mutations=MUTATIONS
        + "TP53\t17\t5\t5\tA\tA\tC\tBA1\t30\t10\tp.R1H\tp.Arg1His\tmissense\nTP53\t17\t5\t5\tA\tA\tC\tBA1\t30\t10\tp.R1H\tp.Arg1His\tmissense\n"
        + "FLT3\t13\t7\t7\tG\tG\t-\tBA3\tNA\t4\t\tp.Asp8Tyr\tstop\nKIT\t4\t1\t1\tA\tA\tC\tBA9\t1\t1\t\t\t\nKIT\t4\tx\t1\tA\tA\tC\tBA1\t1\t1\t\t\t\nNRAS\t1\t2\t2\tC\tC\tT\tBA4\tNA\tNA\t\t\t\n",
        structural=f"Sample_Id\t{SITES}\tSite1_Description\tEvent_Info\nx_BA1\ta\tb\tS\td\tt(8;21)\nx_BA1\ta\tb\tS\td\tinv(16)\nx_BA1\ta\tb\tS\td\tinv(16)\np9_BA77\ta\tb\tS\td\tdel\nnothing\ta\tb\tS\td\tlost\n",
        patient="#c\nPATIENT_ID\tOS_STATUS\tOS_MONTHS\np1\t1:DECEASED\t24\np2\t0:LIVING\t\np3\t0:LIVING\t6\n",
    )
    got = cohorts.harmonised(spark, files, cohorts.BY_SAMPLE)
    assert rows(got["clinical"]) == [
        ("p1", "CENTER_4", 40.0, 8.0, 4.0, 2.0, 9.5, 100.0, "inv(16); t(8;21)"),
        ("p2", "CENTER_UNKNOWN", None, 2.0, 0.2, None, 10.0, 50.0, "46,XY"),
        ("p3", "CENTER_7", None, None, None, None, None, None, ""),
    ]
    assert rows(got["molecular"]) == [
        ("p1", "17", 5.0, 5.0, "A", "C", "TP53", "p.R1H", "missense", 0.25, 40.0),
        ("p2", "13", 7.0, 7.0, "G", "G", "FLT3", "p.Asp8Tyr", "stop", 1.0, 4.0),
        ("p3", "1", 2.0, 2.0, "C", "T", "NRAS", "", None, None, None),
    ]
    assert rows(got["structural"].select("ID", "SITE1_GENE", "SITE1_DESC", "EVENT_INFO")) == [("p1", "a", "d", "inv(16)")] * 2 + [("p1", "a", "d", "t(8;21)"), ("p9", "a", "d", "del")]
    assert rows(got["target"]) == [("p1", 2.0, 1), ("p3", 0.5, 0)]
    cohorts.write(got, str(tmp_path / "out"), "a")
    assert spark.read.parquet(str(tmp_path / "out" / "clinical_a")).columns == cohorts.CLINICAL


def test_cohort_by_patient(spark, tmp_path):
    files = put(
        tmp_path,
        patient="#c\nPATIENT_ID\tBM_BLAST_PERCENTAGE\tWBC\tCYTOGENETICS\tOS_STATUS\tOS_MONTHS\nT-AB-1\t80\tNA\t\t1:DECEASED\t12\nT-AB-2\tx\t5\t46,XX\t[Not Available]\t3\nT-AB-3\t\t\t\t0:LIVING\t1.2\n",
        mutations=MUTATIONS + "TP53\tX\t5\t6\tAC\tAC\t\tT-AB-1-03\t2\t1\t\t\tm\n",
        structural=f"Sample_Id\t{SITES}\tEvent_info\nT-AB-1-03\ta\tb\tS\tfusion\nT-AB-2-03\ta\tb\tS\tother\n",
    )
    got = cohorts.harmonised(spark, files, cohorts.BY_PATIENT)
    none = (None,) * 4
    assert rows(got["clinical"]) == [("T-AB-1", "TCGA", 80.0, None, *none, "fusion"), ("T-AB-2", "TCGA", None, 5.0, *none, "46,XX"), ("T-AB-3", "TCGA", None, None, *none, "")]
    assert rows(got["molecular"]) == [("T-AB-1", "X", 5.0, 6.0, "AC", "AC", "TP53", "", "m", 0.3333, 3.0)]
    assert rows(got["structural"]) == [("T-AB-1", "a", "b", "S", "fusion"), ("T-AB-2", "a", "b", "S", "other")]
    assert rows(got["target"]) == [("T-AB-1", 1.0, 1), ("T-AB-3", pytest.approx(0.1), 0)]


def test_a_layout_names_the_files_that_it_lacks(spark):
    with pytest.raises(ValueError, match="sample, blood"):
        cohorts.harmonised(spark, {"patient": "", "mutations": "", "structural": ""}, cohorts.BY_SAMPLE)


def test_code_for_a_cohorts_rows_is_small_enough_to_be_compiled(spark, tmp_path, capsys):
    import re

    from tidewell.functions.nulls import blank_as_null

    texts = spark.createDataFrame([(None,), ("",), (" ",), ("NA",), (" NA ",), ("null",), (" x",), ("N",)], "t string")
    assert [r[0] for r in texts.select(blank_as_null(texts.t, "NA", "null")).collect()] == [None] * 6 + [" x", "N"]
    files = put(tmp_path, patient="PATIENT_ID\tBM_BLAST_PERCENTAGE\tWBC\tCYTOGENETICS\tOS_STATUS\tOS_MONTHS\n", mutations=MUTATIONS, structural=f"Sample_Id\t{SITES}\tEvent_info\n")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cohorts.harmonised(spark, files, cohorts.BY_PATIENT)["molecular"].explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # Java interprets what is larger; 9825 before in the query

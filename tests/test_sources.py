"""Readers on small files of each format."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.operators import genes
from tidewell.sources import readers


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("ID,OS_YEARS,OS_STATUS\na,1.5,1\nb,,0\nc,NaN,1\n")
    got = readers.csv(spark, str(tmp_path / "c.csv"), readers.TARGET).orderBy("ID").collect()
    assert [tuple(r) for r in got] == [("a", 1.5, 1.0), ("b", None, 0.0), ("c", None, 1.0)]
    (tmp_path / "t.tsv").write_text("# a comment\nID\tX\na\tNA\nb\t\nc\t7\n")
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "t.tsv"), ["ID", "X"]).orderBy("ID").collect()] == [("a", None), ("b", None), ("c", "7")]


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##fileformat=VCF\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t5\t.\tA\tC\t.\t.\tAF=1\n1\t5\t.\tA\tC\t.\t.\tAF=1;CLNSIG=Pathogenic;X=2\n1\t5\t.\tA\tC\t.\t.\tCLNSIG=Benign\n1\t7\t.\tA\tC\t.\t.\tAF=1\n1\t6\t.\tA\tC,G\t.\t.\tCLNSIG=Pathogenic\n2\tx\t.\tA\tC\t.\t.\t.\n")
    assert [(r.vid, r.CLNSIG) for r in readers.vcf(spark, str(tmp_path / "v.vcf")).collect()] == [("chr1:g.5A>C", "Pathogenic")]


def test_annotation_lines(spark):
    lines = [('{"chr1:g.5A>C": {"snpeff": {"ann": {"gene_name": "G", "hgvs_p": "p.Arg5His", "effect": "missense_variant", "putative_impact": "LOW"}}}}',), ("",), ("{broken",), ('{"a": 1, "b": 2}',)]
    found = readers.annotations(spark.createDataFrame(lines, "value string"))
    got = found.select("vid", genes.cleaned_annotations(genes.annotation_list(F.col("payload"))).alias("ann")).collect()
    assert len(got) == 1 and got[0].ann[0].hgvs_p == "p.R5H" and got[0].ann[0].effect == "non_synonymous_codon"


def test_score_cache_and_backlog(spark):
    cache = readers.score_cache(spark.createDataFrame([('{"chr1:g.5A>C": 3.5}',)], "value string"))
    rows = spark.createDataFrame([("1", 5.0, "A", "C"), ("1", 6.0, "A", "C"), ("1", 6.0, "A", "C"), ("1", 7.0, "AT", "C")], "CHR string, START double, REF string, ALT string")
    assert [r.vid for r in readers.backlog(rows, cache).collect()] == ["chr1:g.6A>C"]


def test_lab_matrix_needs_every_metric(spark):
    rows = spark.createDataFrame([("WBC", "1.5", "x"), ("HB", "9", "10")], "NAME string, s1 string, s2 string")
    assert [tuple(r) for r in readers.lab_matrix(rows, "NAME", ["s1", "s2"], {"WBC": "wbc", "HB": "hb"}).orderBy("sample").collect()] == [("s1", 1.5, 9.0), ("s2", None, 10.0)]
    with pytest.raises(ValueError):
        readers.lab_matrix(rows, "NAME", ["s1"], {"PLT": "plt"})


def test_sinks(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1.0)], "ID string, risk_score double")
    readers.write_table(scores, str(tmp_path / "p"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    readers.write_submission(scores, str(tmp_path / "s"), "r1")
    readers.write_submission(scores, str(tmp_path / "s"), "r2")
    assert {r.run_id for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {"r1", "r2"}
    a, b = (readers.run_record(spark, "r", "2026-01-01", c, ["f"]).first().config_sig for c in ({"x": 1, "y": 2}, {"y": 2, "x": 1}))
    assert a == b and len(a) == 64
    with pytest.raises(ValueError):
        readers.training_rows(scores, scores)


def test_runs_and_submissions_can_be_written_again(spark, tmp_path):
    at = str(tmp_path / "runs")
    record = lambda run: readers.run_record(spark, run, "2026-01-01", {"x": run}, ["f"])
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "ID string, risk_score double")
    for _ in range(2):
        readers.append_run(record("1"), at, scores)
        readers.append_run(record("2"), at, scores)
        readers.write_submission(scores, str(tmp_path / "s"), "7")
    readers._in_place(scores.withColumn("run_id", F.lit("3")), f"{at}/predictions", "run_id")  # a run that broke off before its record
    assert [r.run_id for r in readers.runs(spark, at).orderBy("run_id").collect()] == ["1", "2"]
    assert readers.run_predictions(spark, at, "ID string, risk_score double").groupBy("run_id").count().orderBy("run_id").collect() == [("1", 2), ("2", 2)]
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_upsert_keeps_the_newest_and_can_be_repeated(spark, tmp_path):
    at, schema = str(tmp_path / "cache"), "vid string, score double, at int"
    first = spark.createDataFrame([(f"v{i}", float(i), 1) for i in range(40)], schema)
    later = spark.createDataFrame([("v3", 30.0, 2), ("v4", 40.0, 0), ("new", 5.0, 2), ("new", 6.0, 1)], schema)
    for rows in (first, later, later, first):
        readers.upsert(rows, at, "vid", "at", 4)
    got = {r.vid: r.score for r in readers.upserted(spark, at, schema).collect()}
    assert got == {f"v{i}": float(i) for i in range(40)} | {"v3": 30.0, "new": 5.0} and readers.upserted(spark, at, schema).count() == 41


def test_wide_matrix_of_many_samples(spark, tmp_path):
    n = 20_000
    lines = ["# made", "METRIC\t" + "\t".join(f"s{i}" for i in range(n)), "WBC %\t" + "\t".join("NA" if i % 7 == 0 else str(i / 10) for i in range(n)), "other\t" + "\t".join("1" for _ in range(n)), "HB\t" + "\t".join(str(i) for i in range(n))]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    got = readers.wide_matrix(spark, str(tmp_path / "m.tsv"), "METRIC", {"WBC %": "WBC", "HB": "HB"})
    rows = {r.ID: (r.WBC, r.HB) for r in got.collect()}
    assert len(rows) == n and rows["s7"] == (None, 7.0) and rows["s19998"] == (1999.8, 19998.0)
    with pytest.raises(ValueError, match="PLT"):
        readers.wide_matrix(spark, str(tmp_path / "m.tsv"), "METRIC", {"PLT": "PLT"})


def test_census_and_gene_list(spark, tmp_path):
    (tmp_path / "census.tsv").write_text("Gene Symbol \t Tier\tPlace\nTP53\t1\t17p\nbroken\t1\nKIT\tx\t \n")
    got = readers.gene_census(spark, str(tmp_path / "census.tsv"), ["Gene Symbol ", " Tier", "Place"], {"Gene Symbol": "GENE", "Tier": "TIER", "Place": "BAND"})
    assert sorted((r.GENE, r.TIER, r.BAND) for r in got.filter("GENE <> 'broken'").collect()) == [("KIT", None, None), ("TP53", 1.0, "17p")]
    (tmp_path / "list.tsv").write_text("Hugo\tx\tIs Oncogene\nKIT\t1\tYes\n")
    assert [tuple(r) for r in readers.gene_list(spark, str(tmp_path / "list.tsv"), ["Hugo", "x", "Is Oncogene"], {"Hugo": "GENE", "Is Oncogene": "onc"}).collect()] == [("KIT", "Yes")]


def test_annotation_lines_are_parsed_once(spark):
    found = readers.annotations(spark.createDataFrame([('{"v1":{"a":1}}',), ('{"v1":1,"v2":2}',), ("{}",), ("broken",), (" ",)], "value string"))
    assert [r.vid for r in found.collect()] == ["v1"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_a_list_of_effects_may_stand_for_many_rows(spark):
    found = spark.createDataFrame([(3, [("ITD",), ("PTD",)]), (2, [("ITD",), (None,)])], "times long, ann array<struct<effect:string>>")
    assert sorted(map(tuple, genes.distinct_effects(found, times="times").collect())) == [("ITD", 5), ("PTD", 3)]

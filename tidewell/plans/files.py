"""Queries of readers and sinks: tables written as the files that users have, read back and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.nulls import clean_doubles
from tidewell.operators import clean
from tidewell.operators.ordered import shared_path
from tidewell.plans.fixtures import oracle, view
from tidewell.sources import readers


def gene_files(spark: SparkSession, d: str) -> DataFrame:
    """A gene census (names with blanks, tiers that aren't numbers, blank places) and a gene list (missing tokens) of all genes and chromosomes."""
    at = shared_path(spark, "genes")
    g = view(spark, d, "fx_molecular").groupBy(F.concat_ws("-", "GENE", "CHR").alias("gene"), "CHR").agg(F.count(F.lit(1)).alias("n"))
    tier = F.when(F.col("n") % 3 == 0, "x").otherwise((F.col("CHR").cast("int") % 3 + 1).cast("string"))
    place = F.when(F.col("n") % 4 == 0, " ").otherwise(F.concat("CHR", F.lit("p13")))
    g.select(F.col("gene").alias("Gene Symbol "), tier.alias(" Tier"), place.alias("Place"), F.col("n").alias("Entries")).write.option("header", True).option("sep", "\t").csv(f"{at}/census")
    said = F.when(F.col("n") % 5 == 0, "NA").when(F.col("n") % 5 < 3, "Yes").otherwise("No")
    g.filter("n % 2 = 0").select(F.col("gene").alias("Hugo"), F.col("n").alias("Entries"), said.alias("Is Oncogene")).write.option("header", True).option("sep", "\t").csv(f"{at}/list")
    census = readers.gene_census(spark, f"{at}/census", ["Gene Symbol ", " Tier", "Place", "Entries"], {"Gene Symbol": "GENE", "Tier": "TIER", "Place": "BAND"})
    listed = readers.gene_list(spark, f"{at}/list", ["Hugo", "Entries", "Is Oncogene"], {"Hugo": "GENE", "Is Oncogene": "oncogene"})
    return census.join(listed.withColumn("listed", F.lit(1)), "GENE", "full")


def score_files(spark: SparkSession, d: str) -> DataFrame:
    """Scores as a table with its CSV, as submissions of two runs of which the first is written twice, and as a cache of JSON lines."""
    at, t = shared_path(spark, "scores"), view(spark, d, "fx_scores")
    readers.write_table(t.withColumn("gap", F.when(F.col("m_a") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("m_a"))), f"{at}/table", f"{at}/csv")
    table = spark.read.parquet(f"{at}/table").select("ID", "m_a")
    for run, column in (("r1", "m_a"), ("r2", "m_b"), ("r1", "m_a")):
        readers.write_submission(t.select("ID", F.col(column).alias("risk_score")), f"{at}/runs", run)
    runs = spark.read.schema("ID string, risk_score double, run_id string").parquet(f"{at}/runs")
    by_run = runs.groupBy("ID").agg(F.count(F.lit(1)).alias("runs"), F.max_by("risk_score", "run_id").alias("risk_score"))
    t.select(F.to_json(F.create_map("ID", "m_c")).alias("value")).write.text(f"{at}/cache")
    cache = readers.score_cache(spark.read.text(f"{at}/cache")).select(F.col("vid").alias("ID"), "score")
    written = readers.csv(spark, f"{at}/csv", "ID string, m_a double, m_b double, m_c double, gap double").select("ID", "m_b", "gap")
    return table.join(written, "ID").join(by_run, "ID").join(cache, "ID")


def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Features with NaN, infinities and redundant columns, cleaned and joined with the target; the redundancy rules decide which columns stay."""
    n = F.expr("CAST(substr(ID, 2) AS BIGINT)")
    x = view(spark, d, "fx_scores").withColumns(
        {
            "m_a": F.when(F.col("m_a") % 5 == 0, float("nan")).otherwise(F.col("m_a")),
            "m_b": F.when(F.col("m_b") % 7 == 0, float("inf")).when(F.col("m_b") % 7 == 1, float("-inf")).otherwise(F.col("m_b")),
            "wbc_missing": (n % 2).cast("int"), "anc_missing": (n % 3).cast("int"), "TP53_altered": (n % 5 == 0).cast("int"), "TP53_count": n % 5, "any_kit": (n % 7 == 0).cast("int"), "kit_count": n % 7,
            "flt3_count": n % 11, "cosmic_kit_count": n % 13, "sex_chromosomes": (n % 2).cast("int"), "SEX_XX": (n % 2 == 0).cast("int"),
        }
    )
    x = clean_doubles(x.drop(*clean.redundant(x.columns, ("wbc",), counts_of_altered=True, counts_of_any=True, listed=("m_c", "not there"))))
    return readers.training_rows(x, view(spark, d, "fx_target"))


QUERIES = {f.__name__: f for f in (gene_files, score_files, training_set)}

ORACLES = {
    "gene_files": oracle(
        """WITH g AS (SELECT concat(GENE, '-', CHR) AS GENE, CHR, count(*) AS n FROM fx_molecular GROUP BY ALL)
        SELECT GENE, CASE WHEN n % 3 <> 0 THEN (CAST(CHR AS INT) % 3 + 1)::DOUBLE END AS TIER, CASE WHEN n % 4 <> 0 THEN concat(CHR, 'p13') END AS BAND,
          CASE WHEN n % 2 = 0 AND n % 5 <> 0 THEN CASE WHEN n % 5 < 3 THEN 'Yes' ELSE 'No' END END AS oncogene, CASE WHEN n % 2 = 0 THEN 1 END AS listed FROM g""",
        "fx_molecular",
    ),
    "score_files": oracle("SELECT ID, m_a, m_b, CASE WHEN m_a % 2 <> 0 THEN m_a END AS gap, 2::BIGINT AS runs, m_b AS risk_score, m_c AS score FROM fx_scores", "fx_scores"),
    "training_set": oracle(
        """WITH x AS (SELECT *, CAST(substr(ID, 2) AS BIGINT) AS n FROM fx_scores)
        SELECT ID, CASE WHEN m_a % 5 <> 0 THEN m_a END AS m_a, CASE WHEN m_b % 7 > 1 THEN m_b END AS m_b, (n % 2)::INT AS wbc_missing, (n % 5 = 0)::INT AS TP53_altered, (n % 7 = 0)::INT AS any_kit,
          n % 11 AS flt3_count, n % 13 AS cosmic_kit_count, (n % 2 = 0)::INT AS SEX_XX, OS_YEARS, OS_STATUS FROM x JOIN fx_target USING (ID)""",
        "fx_scores", "fx_target",
    ),
}

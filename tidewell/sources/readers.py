"""Readers of the text formats that cohorts come in. Schemas are given, so no file is read twice to guess them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewell.functions.nulls import blank_as_null, clean_doubles, number
from tidewell.operators.joins import stack
from tidewell.operators.mutations import variant_id
from tidewell.operators.ordered import first_by_key, settle

CLINICAL = "ID string, CENTER string, BM_BLAST double, WBC double, ANC double, MONOCYTES double, HB double, PLT double, CYTOGENETICS string"
MOLECULAR = "ID string, CHR string, START double, `END` double, REF string, ALT string, GENE string, PROTEIN_CHANGE string, EFFECT string, VAF double, DEPTH double"
TARGET = "ID string, OS_YEARS double, OS_STATUS double"
VCF = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


def _strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; NaN and infinities become NULL."""
    return clean_doubles(spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path))


def tsv(spark: SparkSession, path: str, names: list[str], missing: tuple[str, ...] = ("NA", "[Not Available]")) -> DataFrame:
    """Tab-separated text with a header and `#` comments, all columns as strings, blank and missing tokens as NULL."""
    rows = spark.read.schema(_strings(names)).option("sep", "\t").option("header", True).option("comment", "#").option("enforceSchema", True).csv(path)
    return rows.select(*[blank_as_null(F.col(c), *missing).alias(c) for c in names])


def gene_census(spark: SparkSession, path: str, names: list[str], wanted: dict[str, str] | None = None) -> DataFrame:
    """A census table as strings, broken lines dropped, some columns kept under other names, the tier as a number. wanted: name in the file,
    blanks around it left out -> new name."""
    rows = spark.read.schema(_strings([n.strip() for n in names])).option("sep", "\t").option("header", True).option("enforceSchema", True).option("mode", "DROPMALFORMED").csv(path)
    rows = rows.select(*[blank_as_null(F.col(f"`{c}`")).alias(new) for c, new in (wanted or {n.strip(): n.strip() for n in names}).items()])
    return rows.withColumn("TIER", number(F.col("TIER"))) if "TIER" in rows.columns else rows


def gene_list(spark: SparkSession, path: str, names: list[str], wanted: dict[str, str]) -> DataFrame:
    """A few columns of a tab-separated gene list; the scan reads no others."""
    return tsv(spark, path, names).select(*[F.col(f"`{c}`").alias(new) for c, new in wanted.items()])


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """vid, CHROM, POS, REF, ALT and CLNSIG of single-allele rows that have a significance; of rows of one variant, the first of the file."""
    rows = spark.read.schema(_strings(VCF)).option("sep", "\t").option("comment", "#").csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    rows = rows.select("CHROM", F.col("POS").try_cast("long").alias("POS"), "REF", "ALT", F.nullif(F.regexp_extract("INFO", "CLNSIG=([^;]+)", 1), F.lit("")).alias("CLNSIG"), place.alias("_place"))
    rows = rows.filter(~F.col("ALT").contains(",") & F.col("CLNSIG").isNotNull() & F.col("POS").isNotNull() & F.col("REF").isNotNull())
    return first_by_key(rows.withColumn("vid", variant_id("CHROM", "POS", "REF", "ALT")), "vid", "_place").drop("_place")


def annotations(lines: DataFrame, column: str = "value") -> DataFrame:
    """(vid, payload) of JSON lines that are objects with exactly one key; blank and broken lines are left out."""
    parsed = lines.select(F.from_json(column, "map<string,variant>").alias("m"))
    # an outer explode, since Spark would parse once more for each condition on the map that it can move below
    return parsed.select(F.explode_outer(F.when(F.size("m") == 1, F.col("m"))).alias("vid", "payload")).filter("vid IS NOT NULL")


def score_cache(lines: DataFrame, column: str = "value") -> DataFrame:
    """(vid, score) of a JSON object of scores."""
    return lines.select(F.explode(F.from_json(column, "map<string,double>")).alias("vid", "score"))


def lab_matrix(rows: DataFrame, metric: str, samples: list[str], wanted: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Matrices with one row per metric and one column per sample, turned: one row per sample, wanted metrics renamed, as numbers. Several
    matrices of one layout are told apart by the columns `by`.

    A wanted metric that doesn't occur is an error."""
    by = by or []
    long = rows.filter(F.col(metric).isin(list(wanted))).select(*by, metric, *[F.col(s).cast("string").alias(s) for s in samples]).unpivot([*by, metric], samples, "sample", "value")
    out = long.groupBy(*by, "sample").agg(*[F.first(F.when(F.col(metric) == m, number(F.col("value"))), ignorenulls=True).alias(name) for m, name in wanted.items()])
    have = {r[0] for r in rows.filter(F.col(metric).isin(list(wanted))).select(metric).distinct().collect()}
    if set(wanted) - have:
        raise ValueError(f"missing metrics: {sorted(set(wanted) - have)}")
    return out


def cohort(main: dict[str, DataFrame], extra: dict[str, DataFrame], name: str, key: str = "ID") -> dict[str, DataFrame]:
    """A cohort's tables put under the main ones, without patients that the main cohort has; each cohort brings its own mutations."""
    own = main["clinical"].select(key)
    out = {}
    for table, rows in main.items():
        out[table] = stack({"main": rows, name: extra[table].join(own, key, "left_anti")}, "cohort") if table in extra else rows.withColumn("cohort", F.lit("main"))
    return out


def wide_matrix(spark: SparkSession, path: str, name_column: str, metrics: dict[str, str], sample: str = "ID") -> DataFrame:
    """One row for each sample of a tab-separated matrix with a line for each metric and a column for each sample, however many. metrics: name in the file ->
    new name; one that the file lacks is an error.

    Lines are split by position and the header is a table like any other, so no plan has a column for each sample."""
    cells = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).select(F.col("c")[0].alias("name"), "c")
    cells = cells.filter(F.col("name").isin(name_column, *metrics)).select("name", F.posexplode("c").alias("pos", "text")).filter("pos > 0")
    cells = settle(cells)
    found = {r[0] for r in cells.select("name").distinct().collect()}
    if lost := {name_column, *metrics} - found:
        raise ValueError(f"the matrix lacks {', '.join(sorted(lost))}")
    samples = cells.filter(F.col("name") == name_column).select("pos", F.col("text").alias(sample))
    values = cells.filter(F.col("name") != name_column).join(samples, "pos").filter(blank_as_null(F.col(sample)).isNotNull())
    return values.groupBy(sample).agg(*[F.max(F.when(F.col("name") == m, number(blank_as_null(F.col("text"), "NA")))).alias(new) for m, new in metrics.items()])


def write_table(df: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Parquet, and CSV with a header on request."""
    df.write.mode("overwrite").parquet(path)
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)


def write_submission(scores: DataFrame, path: str, run_id: str, key: str = "ID") -> None:
    """key and risk_score, kept by run; the latest run is the largest run_id. Written again, a run takes its own place."""
    _in_place(scores.select(key, "risk_score", F.lit(run_id).alias("run_id")), path, "run_id")


def _in_place(df: DataFrame, path: str, by: str) -> None:
    """Replace those partitions of a table that the rows have, all at once when the write ends; one that fails leaves the table as it was."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert(new: DataFrame, path: str, key: str, at: str, buckets: int = 64) -> None:
    """Put rows into a table that has one row for each key, the one with the largest `at` (of equal ones, the row that comes first by its other columns).
    Only buckets of keys that are touched are written again, and doing it twice changes nothing."""
    spark, bucket = new.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    rows = settle(new.select("*", bucket))
    touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # numbers below `buckets`
    try:
        old = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:  # no table yet
        old = rows.limit(0)
    both = old.filter(F.col("bucket").isin(touched)).unionByName(rows)
    others = [F.col(c) for c in new.columns if c not in (key, at)]
    first = Window.partitionBy("bucket", key).orderBy(F.col(at).desc_nulls_last(), *others)
    _in_place(settle(both.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")), path, "bucket")


def upserted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table that upsert has written."""
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def run_record(spark: SparkSession, run_id: str, created_at: str, config: dict, features: list[str]) -> DataFrame:
    """One row of the runs table; the signature is the sha256 of the sorted configuration."""
    import json

    row = spark.createDataFrame([(run_id, created_at, json.dumps(config, sort_keys=True, default=str), features)], "run_id string, created_at string, config string, features array<string>")
    return row.select("run_id", "created_at", F.sha2("config", 256).alias("config_sig"), "features")


def append_run(record: DataFrame, path: str, predictions: DataFrame | None = None) -> None:
    """Add a run to the table of runs, and its predictions (kept by run) beside it. The record comes last: predictions without one don't count, so
    a run that broke off is as if it had never been, and one that is added again takes its own place."""
    if predictions is not None:
        _in_place(predictions.crossJoin(F.broadcast(record.select("run_id"))), f"{path}/predictions", "run_id")  # one row
    _in_place(record, f"{path}/runs", "run_id")


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("created_at string, config_sig string, features array<string>, run_id string").parquet(f"{path}/runs").select("run_id", "created_at", "config_sig", "features")


def run_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Predictions of the runs that have a record."""
    return spark.read.schema(f"{schema}, run_id string").parquet(f"{path}/predictions").join(runs(spark, path).select("run_id"), "run_id", "left_semi")


def training_rows(x: DataFrame, y: DataFrame, time: str = "OS_YEARS", event: str = "OS_STATUS", key: str = "ID") -> DataFrame:
    """Features and target joined by key; both target columns have to be there."""
    missing = {time, event} - set(y.columns)
    if missing:
        raise ValueError(f"the target lacks {sorted(missing)}")
    return x.join(y.select(key, time, event), key)


def backlog(rows: DataFrame, cache: DataFrame, batch: int = 1000) -> DataFrame:
    """(vid, batch): distinct variants whose score isn't known yet, numbered in batches by a hash so that no task sorts them all."""
    needed = rows.select(variant_id(snv_only=True).alias("vid")).filter("vid IS NOT NULL").distinct().join(cache.filter("score IS NOT NULL").select("vid"), "vid", "left_anti")
    n = max(1, -(-needed.count() // batch))
    return needed.select("vid", F.pmod(F.xxhash64("vid"), F.lit(n)).alias("batch"))

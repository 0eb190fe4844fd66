"""Whole cohorts from the files of two layouts to the common tables: clinical, molecular, structural and target.

A layout says where each piece of the clinical table is found and how a sample's name leads to a patient; the steps are the same for both. Tables are
lazy, and read their files once each; only the header lines come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.nulls import number
from tidewell.operators import genes
from tidewell.operators.ordered import first_by_key
from tidewell.sources import readers

CLINICAL = ["ID", "CENTER", "BM_BLAST", "WBC", "ANC", "MONOCYTES", "HB", "PLT", "CYTOGENETICS"]
MEASURES = CLINICAL[2:8]
#: Tokens that stand for a missing value in a cohort's files.
MISSING = ("NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "[Not Available]")


@dataclass(frozen=True)
class Layout:
    """Files: `patient`, `mutations`, `structural`, and what the layout needs besides. Names are those of the files' columns.

    samples: sample, patient, time, center and karyotype columns of a `sample` file (each patient's earliest sample counts), or None where the
    clinical table is the patient file; matrix: name column and metrics of a `blood` file, shares: measure -> the share of WBC (in percent) that
    it is; measures: those that the patient file has; patient_of: a sample's name to its patient, where no sample file says so; events: columns of
    the structural file -> common names; whole: whether its other columns are kept.
    """

    events: dict[str, str]
    center: str
    samples: dict[str, str] | None = None
    matrix: tuple[str, dict[str, str]] | None = None
    shares: dict[str, str] = field(default_factory=dict)
    measures: dict[str, str] = field(default_factory=dict)
    sample_in_event: str = r"^(.*)$"
    patient_of: str = r"^(.*)-[^-]*$"
    whole: bool = False


#: The two layouts' column names and patterns.
BY_SAMPLE = Layout(
    events={"Site1_Hugo_Symbol": "SITE1_GENE", "Site1_Description": "SITE1_DESC", "Site2_Hugo_Symbol": "SITE2_GENE", "SV_Status": "SV_STATUS", "Event_Info": "EVENT_INFO"},
    center="CENTER_",
    samples={"sample": "SAMPLE_ID", "patient": "PATIENT_ID", "time": "TIME_OF_SAMPLE_COLLECTION_RELATIVE_TO_INCLUSION", "center": "CENTER_ID", "karyotype": "KARYOTYPE"},
    matrix=("ENTITY_STABLE_ID", {"PERC_BLASTS_IN_BM": "BM_BLAST", "WBC_COUNT": "WBC", "PERC_NEUTROPHILS_IN_PB": "PERC_NEUT", "PERC_MONOCYTES_IN_PB": "PERC_MONO", "HEMOGLOBIN": "HB", "PLATELET_COUNT": "PLT"}),
    shares={"ANC": "PERC_NEUT", "MONOCYTES": "PERC_MONO"},
    sample_in_event=r"_(BA\d+)$",
    patient_of=r"^(.*)_BA",
    whole=True,
)
BY_PATIENT = Layout(
    events={"Site1_Hugo_Symbol": "SITE1_GENE", "Site2_Hugo_Symbol": "SITE2_GENE", "SV_Status": "SV_STATUS", "Event_info": "EVENT_INFO"},
    center="TCGA",
    measures={"BM_BLAST_PERCENTAGE": "BM_BLAST", "WBC": "WBC"},
)


def _file(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file as strings; its first line without `#` names the columns."""
    header = spark.read.text(path).filter(~F.col("value").startswith("#")).head()
    if header is None:
        raise ValueError(f"{path} has no header")
    return readers.tsv(spark, path, header[0].rstrip("\r").split("\t"), MISSING)


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _samples(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """The earliest sample of each patient (a missing time counts as 0; of equal times, the smallest name), with its center and karyotype."""
    c = layout.samples
    rows = _file(spark, path).select(
        F.col(c["patient"]).alias("ID"), F.col(c["sample"]).alias("SAMPLE_ID"), F.coalesce(number(F.col(c["time"])), F.lit(0.0)).alias("_time"),
        genes.center_label(c["center"], layout.center).alias("CENTER"), F.col(c["karyotype"]).alias("CYTOGENETICS"),
    )
    return first_by_key(rows.filter("ID IS NOT NULL"), "ID", "_time", "SAMPLE_ID").drop("_time")


def molecular(rows: DataFrame, patient: Column) -> DataFrame:
    """Distinct mutation rows in the common layout; those without a patient, place, reference or gene go. Depth counts a missing part as 0, the
    allele fraction has 4 decimals, an absent second allele gives way to the first, the short protein change to the long one."""
    depth, vaf = genes.read_depth("t_ref_count", "t_alt_count")
    out = rows.select(
        patient.alias("ID"), F.col("Chromosome").alias("CHR"), number(F.col("Start_Position")).alias("START"), number(F.col("End_Position")).alias("END"), F.col("Reference_Allele").alias("REF"),
        F.coalesce(genes.alternative_allele("Tumor_Seq_Allele2", "Tumor_Seq_Allele1"), F.lit("")).alias("ALT"), F.col("Hugo_Symbol").alias("GENE"),
        F.coalesce("HGVSp_Short", "HGVSp", F.lit("")).alias("PROTEIN_CHANGE"), F.col("Consequence").alias("EFFECT"), vaf.alias("VAF"), depth.alias("DEPTH"),
    )
    return out.dropna(subset=["ID", "CHR", "START", "END", "REF", "GENE"]).distinct()


def target(patients: DataFrame) -> DataFrame:
    """ID, OS_YEARS and OS_STATUS of patients that have both."""
    status, years = genes.target_from_clinic("OS_STATUS", "OS_MONTHS")
    return patients.filter("OS_STATUS IS NOT NULL AND OS_MONTHS IS NOT NULL").select(F.col("PATIENT_ID").alias("ID"), years.alias("OS_YEARS"), status.alias("OS_STATUS"))


def harmonised(spark: SparkSession, files: dict[str, str], layout: Layout) -> dict[str, DataFrame]:
    """The four common tables of a cohort whose files lie at the given paths."""
    wanted = ["patient", "mutations", "structural", *(["sample"] if layout.samples else []), *(["blood"] if layout.matrix else [])]
    if lost := [f for f in wanted if f not in files]:
        raise ValueError(f"the layout needs the files {', '.join(lost)}")
    patients, events, rows = (_file(spark, files[f]) for f in ("patient", "structural", "mutations"))
    by_name: Callable[[str], Column] = lambda c: _found(F.col(c), layout.patient_of)
    if layout.samples:
        samples = _samples(spark, files["sample"], layout)
        known = samples.select(F.col("SAMPLE_ID").alias("_sample"), F.col("ID").alias("_patient")).filter("_sample IS NOT NULL")
        events = events.join(known, _found(F.col("Sample_Id"), layout.sample_in_event) == F.col("_sample"), "left")
        events = events.withColumn("ID", F.coalesce("_patient", by_name("Sample_Id"))).drop("_sample", "_patient")
        made = molecular(rows.join(known, F.col("Tumor_Sample_Barcode") == F.col("_sample")), F.col("_patient"))
        clinic = samples
    else:
        events = events.withColumn("ID", by_name("Sample_Id"))
        made = molecular(rows, by_name("Tumor_Sample_Barcode"))
        clinic = patients.select(F.col("PATIENT_ID").alias("ID"), F.lit(layout.center).alias("CENTER"), "CYTOGENETICS", *[number(F.col(c)).alias(m) for c, m in layout.measures.items()])
    if layout.matrix:
        name, metrics = layout.matrix
        labs = readers.wide_matrix(spark, files["blood"], name, metrics, "SAMPLE_ID")
        clinic = clinic.join(labs, "SAMPLE_ID", "left").withColumns({m: F.col("WBC") * F.col(share) / 100.0 for m, share in layout.shares.items()})
    clinic = clinic.withColumns({m: F.lit(None).cast("double") for m in MEASURES if m not in clinic.columns})
    events = events.filter("ID IS NOT NULL").withColumnsRenamed(layout.events)
    events = events.select("ID", *([c for c in events.columns if c != "ID"] if layout.whole else layout.events.values()))
    return {"clinical": genes.filled_karyotype(clinic, events).select(*CLINICAL), "molecular": made, "structural": events, "target": target(patients)}


def write(tables: dict[str, DataFrame], folder: str, name: str) -> None:
    """The tables as Parquet, each at <folder>/<table>_<name>."""
    for table, rows in tables.items():
        readers.write_table(rows, f"{folder}/{table}_{name}")

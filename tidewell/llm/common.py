"""What the operators of this subpackage share: tables, the shared folder, and safe numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return: what bytes.split() of Python splits on as well.
BLANKS = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); one of our own only in local mode where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors, and fixes row numbers."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes the empty text) and the named columns, whatever other columns the table has."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def bytes_of(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text, for Python tasks that read bytes from Arrow without decoding."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def unsigned(h: Column) -> Column:
    """A value in (0, 1) from the upper 53 bits of a 64-bit hash."""
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)


def held_out(doc_id: Column) -> Column:
    """Rows that a classifier never learns from: crc32 of the id as text, modulo 5, is 0."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0)


#: Rows of a table of keys that are broadcast; more are joined by a shuffle.
FEW = 200_000


def shuffled(table: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Where both sides grow with the corpus, Spark's sizes don't tell: they are those of files, and
    what an explode makes of a table counts as large as the table."""
    return table.hint("merge")


def without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """docs less the rows that `gone` (a settled table of keys) matches: by broadcast where its counted rows are few, else by a shuffle."""
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone.hint("merge"), same, "left_anti")

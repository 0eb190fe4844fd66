"""Patient-shaped views over the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_CLINICAL = """
SELECT concat('P', CAST(o_orderkey AS STRING)) AS ID,
  concat('CTR_', CAST(CASE WHEN o_custkey % 10 < 8 THEN o_custkey % 8 ELSE 8 + o_custkey % 61 END AS STRING)) AS CENTER,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 113 AS DOUBLE) END AS BM_BLAST,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice / CAST(1000 AS DOUBLE) END AS WBC,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 120 AS DOUBLE) / CAST(10 AS DOUBLE) END AS ANC,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) / CAST(10 AS DOUBLE) END AS MONOCYTES,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(4 AS DOUBLE) + CAST(o_orderkey % 130 AS DOUBLE) / CAST(10 AS DOUBLE) END AS HB,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 600 AS DOUBLE) END AS PLT,
  CASE WHEN o_orderkey % 12 = 11 THEN NULL ELSE split_part('46,XX[20]|46,XY[20]|45,XY,-7[12]/46,XY[8]|46,XX,t(8;21)(q22;q22)[20]|46,XY,inv(16)(p13q22)[17]/46,XY[3]|47,XX,+8[10]/48,idem,+21[10]|44,XY,-5,-7,del(17)(p13),+mar[15]|complex|normal|45,X,-Y[9]/46,XY[cp4]|46,XX,del(5)(q13q33),-18,add(3)(q26),der(12)t(12;13)(p13;q14)[20]', '|', CAST(1 + o_orderkey % 12 AS INT)) END AS CYTOGENETICS
FROM orders"""

FX_MOLECULAR = """
SELECT concat('P', CAST(l_orderkey AS STRING)) AS ID, CAST(1 + l_suppkey % 22 AS STRING) AS CHR,
  CAST(l_partkey * 1000 + l_linenumber AS DOUBLE) AS START,
  CAST(l_partkey * 1000 + l_linenumber AS DOUBLE) AS "END",
  split_part('A|C|G|T', '|', CAST(1 + l_partkey % 4 AS INT)) AS REF,
  split_part('C|G|T|A|CT', '|', CAST(1 + l_suppkey % 5 AS INT)) AS ALT,
  split_part('TP53|NPM1|FLT3|ASXL1|RUNX1|DNMT3A|IDH1|IDH2|TET2|SF3B1|SRSF2|CEBPA|NRAS|KRAS|MLL|KIT|U2AF1|ZRSR2|BCOR|EZH2|STAG2|PTPN11|STAT3|KDM6A', '|', CAST(1 + (l_partkey + l_linenumber) % 24 AS INT)) AS GENE,
  split_part('p.R882H|p.E545K|MLL_PTD|FLT3_ITD|p.D835Y', '|', CAST(1 + l_suppkey % 5 AS INT)) AS PROTEIN_CHANGE,
  split_part('non_synonymous_codon|stop_gained|frameshift_variant|ITD|splice_site_variant|PTD', '|', CAST(1 + l_partkey % 6 AS INT)) AS EFFECT,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_discount * CAST(10 AS DOUBLE) END AS VAF,
  l_quantity AS DEPTH
FROM lineitem"""

FX_TARGET = """
SELECT concat('P', CAST(o_orderkey AS STRING)) AS ID,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + (o_orderkey * 31) % 97 AS DOUBLE) / CAST(10 AS DOUBLE) END AS OS_YEARS,
  CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS OS_STATUS
FROM orders"""

FX_SCORES = """
SELECT concat('P', CAST(o_orderkey AS STRING)) AS ID,
  CAST((o_orderkey * 17) % 211 AS DOUBLE) AS m_a, CAST((o_orderkey * 29) % 307 AS DOUBLE) AS m_b, CAST(o_custkey % 53 AS DOUBLE) AS m_c
FROM orders"""

#: Karyotypes of one to three clones, put together from beginnings, events, cell counts and further clones.
FX_KARYOTYPES = """
SELECT concat('P', CAST(o_orderkey AS STRING)) AS ID, CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat(
  split_part('46,XX|46,XY|45,X,-Y|47,XY,+8|43~47,XX|92,XXYY|61-66,XX|44,XY|complex|46,xy|48,XX,+X,+21|trisomy 8|normal|del(7)(q22), t(9;11)|47,XXY,+Y', '|', CAST(1 + o_orderkey % 15 AS INT)),
  split_part('|,t(9;11)(p22;q23)|,del(5)(q13q33)|,inv(3)(q21q26)|,-7|,+mar|,der(12)t(12;13)|,add(17)(p13),-18|,i(17)(q10)|,dic(5;17)|,+r[3]|,dmin|,ins(10;11)', '|', CAST(1 + o_custkey % 13 AS INT)),
  split_part('|,-5,-17|,del(12)(p11)|,t(8;21)(q22;q22)|,+21|,inc|,-X', '|', CAST(1 + (o_orderkey * 3 + o_custkey) % 7 AS INT)),
  split_part('[20]|[cp11]|[12]|', '|', CAST(1 + o_custkey % 4 AS INT)),
  split_part('|/46,XX[8]|/47,idem,+8[5]|/48,IDEM,+8,+21[30]|/47,XX,+mar1[4]/46,XY[cp3]|/46,XX,-7[3]/47,idem,+r[2]', '|', CAST(1 + (o_orderkey + o_custkey) % 6 AS INT))) END AS CYTOGENETICS
FROM orders"""

VIEWS = {"fx_karyotypes": FX_KARYOTYPES, "fx_clinical": FX_CLINICAL, "fx_molecular": FX_MOLECULAR, "fx_target": FX_TARGET, "fx_scores": FX_SCORES}
_TABLE = {"fx_molecular": "lineitem"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame; all its columns come from a single scan."""
    table = _TABLE.get(name, "orders")
    sql = VIEWS[name].replace('"END"', "`END`").replace(f"FROM {table}", "FROM {source}")
    return spark.sql(sql, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


#: An arithmetic order of the patients that looks random, in SQL for both.
SHUFFLED = "(CAST(substr(ID, 2) AS BIGINT) * 7919 + 42) % 104729 * 1000000000 + CAST(substr(ID, 2) AS BIGINT)"


def oracle(body: str, *names: str) -> str:
    """SQL for DuckDB in which the views can be named."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    head = body.lstrip()
    if not ctes:
        return head
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {head[15:]}"
    return f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes} {head}"

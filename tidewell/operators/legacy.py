"""Older variants that users may still want: karyotype summaries in four versions, integrated risk scores, and per-value flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import flag
from tidewell.operators.ordered import settle

_TERMS = {"num_translocations": (r"t\(\d+;\d+\)", r"t\(\d+;\d+\)"), "num_deletions": (r"del\(", r"del\([^)]*\)"), "num_inversions": (r"inv\(", r"inv\([^)]*\)"), "num_duplications": (r"dup\(", r"dup\([^)]*\)"), "num_additions": (r"add\(", r"add\([^)]*\)"), "num_monosomies": (r"-\d+", r"(?<![a-zA-Z(])-\d+"), "num_trisomies": (r"\+\d+", r"\+\d+")}


def karyotype_summary(df: DataFrame, text: str = "CYTOGENETICS", version: int = 1) -> DataFrame:
    """Subclones, sex, mean chromosome number, mitoses, counts of terms and complexity.

    Version 1 counts terms once per part and clone, takes the first sex found and the plain mean. From version 2 on clones weigh by their
    cells (1 without a count), sex goes to the heavier side, and `complex_flag` says whether the text does; version 2 counts every occurrence
    in a part. Versions 3 and 4 add `mosaicism_index`, the entropy of the clones' shares over its largest possible value.

    Texts repeat, so each distinct one is summed up once and joined back, as karyotype.cytogenetics does.
    """
    found = settle(_summed_up(df.select(text).distinct(), text, version)).withColumnRenamed(text, "_text")
    new = [c for c in found.columns if c != "_text"]
    return df.join(found, df[text].eqNullSafe(found["_text"]), "left").select(*[F.col(c) for c in df.columns if c not in new], *new)


def _summed_up(df: DataFrame, text: str, version: int) -> DataFrame:
    weighted, every = version >= 2, version == 2
    t = F.when(F.trim(F.col(text)) != "", F.lower(F.col(text))) if weighted else F.lower(F.col(text))
    default = 1 if weighted else 0
    cells = lambda c: F.coalesce(F.regexp_extract(c, r"\[(\d+)\]", 1).try_cast("int"), F.lit(default))

    def clone(c: Column) -> Column:
        parts = F.filter(F.transform(F.split(F.regexp_replace(c, r"\[\d+\]", ""), ","), lambda p: F.trim(p)), lambda p: p != "")
        w = cells(c) if weighted else F.lit(1)

        def amount(patterns: tuple[str, str]) -> Column:
            n = (lambda p: F.regexp_count(p, F.lit(patterns[1]))) if every else (lambda p: p.rlike(patterns[0]).cast("int"))
            return F.aggregate(F.transform(parts, n), F.lit(0), lambda a, x: a + x) * w

        numbers = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("double"))
        sexes = F.transform(F.filter(parts, lambda p: p.contains("xy") | p.contains("xx")), lambda p: F.when(p.contains("xy"), 1).otherwise(-1))
        return F.struct(cells(c).alias("cells"), w.alias("w"), numbers.alias("numbers"), sexes.alias("sexes"), *[amount(p).alias(n) for n, p in _TERMS.items()])

    out = df.withColumn("_clones", F.transform(F.split(t, "/"), clone))
    add = lambda f: F.coalesce(F.aggregate(F.transform("_clones", f), F.lit(0).cast("double"), lambda a, x: a + x), F.lit(0.0))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("double"), lambda a, x: a + x)
    weight = (lambda c: c["w"]) if weighted else (lambda c: F.lit(1))
    mean = F.try_divide(add(lambda c: total(c["numbers"]) * weight(c)), add(lambda c: F.size(c["numbers"]) * weight(c).cast("double")))
    if weighted:
        sex = F.signum(add(lambda c: total(F.transform(c["sexes"], lambda s: s * c["w"].cast("double")))))
    else:
        sex = F.coalesce(F.get(F.flatten(F.transform("_clones", lambda c: c["sexes"])), F.lit(0)), F.lit(0)).cast("double")
    new = {"sex": F.coalesce((sex + 1) / 2, F.lit(0.5)), "avg_chromosomes": mean, "total_mitoses": add(lambda c: c["cells"].cast("double")).cast("int")}
    new["num_subclones"] = F.when(F.col("_clones").isNull(), 0).otherwise(F.size("_clones"))
    new |= {n: _sum_of(n) for n in _TERMS}
    new["complexity_score"] = sum((_sum_of(n) for n in list(_TERMS)[:5]), F.lit(0))
    if weighted:
        new["complex_flag"] = F.coalesce(t.contains("complex"), F.lit(False))
    if version >= 3:
        mitoses = add(lambda c: c["w"].cast("double"))
        share = add(lambda c: F.when(c["w"] > 0, (c["w"] / F.aggregate("_clones", F.lit(0.0), lambda a, x: a + x["w"])) * F.ln(c["w"] / F.aggregate("_clones", F.lit(0.0), lambda a, x: a + x["w"]))).otherwise(0.0))
        new["mosaicism_index"] = F.when((mitoses > 0) & (F.size("_clones") > 1), F.try_divide(-share, F.ln(F.size("_clones").cast("double")))).otherwise(0.0)
    return out.withColumns(new).drop("_clones")


def _sum_of(name: str) -> Column:
    return F.coalesce(F.aggregate("_clones", F.lit(0), lambda a, c: a + c[name]), F.lit(0))


def integrated_scores(df: DataFrame) -> DataFrame:
    """Integrated risk (molecular risk for a normal karyotype, else the worse of both), burden over its largest value and in three classes,
    and a weighted total (0.4 risk, 0.3 clinical score over its largest value, 0.3 burden). Largest values come from one aggregation."""
    clinical = F.coalesce(F.col("cytopenia_score"), F.lit(0)) + F.coalesce(F.col("proliferation_score"), F.lit(0))
    top = df.agg(F.max("total_mutations").alias("m"), F.max(clinical).alias("c")).first()
    integrated = F.when(F.col("normal_karyotype") == 1, F.col("eln_molecular_risk")).otherwise(F.greatest("eln_cyto_risk", "eln_molecular_risk"))
    burden = F.try_divide(F.col("total_mutations").cast("double"), F.lit(float(top["m"] or 0)))
    return df.withColumns(
        {
            "eln_integrated_risk": integrated, "mutation_burden_score": burden, "mutation_burden_category": F.when(F.col("total_mutations") <= 2, 0).when(F.col("total_mutations") <= 5, 1).otherwise(2), "clinical_risk_score": clinical,
            "comprehensive_risk_score": integrated * 0.4 + F.try_divide(clinical.cast("double"), F.lit(float(top["c"] or 0))) * 0.3 + burden * 0.3,
        }
    )


def gene_interactions(df: DataFrame) -> DataFrame:
    """TP53 with a complex karyotype, and the four states of NPM1 and FLT3 (0 neither, 1 NPM1 alone, 2 both, 3 FLT3 alone)."""
    n, f = F.col("mut_NPM1") == 1, F.col("mut_FLT3") == 1
    return df.withColumns({"TP53_complex_cyto": flag((F.col("mut_TP53") == 1) & (F.col("complex_karyotype") == 1)), "FLT3_NPM1_interaction": F.when(n & ~f, 1).when(n & f, 2).when(~n & f, 3).otherwise(0)})


#: Names of the flags of the older risk rules; their patterns follow the risk groups of 2022.
OLD_FAVORABLE = {"t_8_21": r"t\(8;21\)", "inv_16": r"inv\(16\)", "t_16_16": r"t\(16;16\)", "t_15_17": r"t\(15;17\)"}
OLD_NORMAL = r"^46,X[XY](\[\d+\])?$"
OLD_INTERMEDIATE = {"trisomy_8": r"\+8(?![0-9])", "t_9_11": r"t\(9;11\)", "kmt2a_rearranged": r"11q23"}
OLD_ADVERSE = {
    "del_5q": r"-5(?![0-9])|del\(5\)|del\(5q\)", "monosomy_7": r"-7(?![0-9])|del\(7\)|del\(7q\)", "del_17p": r"del\(17\)|del\(17p\)", "abn_3q": r"inv\(3\)|t\(3;3\)",
    "t_6_9": r"t\(6;9\)", "t_9_22": r"t\(9;22\)",
}


def old_risk(df: DataFrame, text: str = "CYTOGENETICS", key: str = "ID") -> DataFrame:
    """Karyotype flags and risk (0 favorable, 1, 2 adverse) by the older rules. Missing text counts as 46,XX; the chromosome number is the
    first number in the text if it lies in 30 to 80, else 46; sex is 0 for XX, 1 for XY (which wins), 0.5 if neither is named."""
    raw = F.trim(F.coalesce(F.col(text), F.lit("46,XX")))
    has = lambda p: F.col("_t").rlike(f"(?i){p}")
    n = F.regexp_extract("_t", r"(\d+)", 1).try_cast("int")
    rows = df.select(key, raw.alias("_t"))
    rows = rows.withColumns({
        "chromosome_count": F.coalesce(F.when(n.between(30, 80), n), F.lit(46)),
        "sex_chromosomes": F.when(has(r"\bXY\b"), 1.0).when(has(r"\bXX\b"), 0.0).otherwise(0.5),
        **{c: flag(has(p)) for c, p in {**OLD_FAVORABLE, **OLD_INTERMEDIATE, **OLD_ADVERSE}.items()},
        "normal_karyotype": flag(F.col("_t").rlike(OLD_NORMAL)),
        "num_cyto_abnormalities": F.regexp_count("_t", F.lit(",")),
    })
    twice = lambda p: F.regexp_count("_t", F.lit(f"(?i){p}")) >= 2
    rows = rows.withColumns({
        "any_favorable_cyto": F.greatest(*OLD_FAVORABLE), "any_adverse_cyto": F.greatest(*OLD_ADVERSE),
        "complex_karyotype": flag(F.col("num_cyto_abnormalities") >= 3), "monosomal_karyotype": flag(twice(r"-\d+\b") | twice("monosomy")),
    })
    risk = F.when((F.col("any_adverse_cyto") == 1) | (F.col("complex_karyotype") == 1), 2).when(F.col("any_favorable_cyto") == 1, 0).otherwise(1)
    return rows.withColumn("eln_cyto_risk", risk).drop("_t")

"""Gene and variant dimensions, annotation records, and cohort harmonisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import blank_as_null, flag, number

# fixed values: the first line with a word that an effect's text contains decides
EFFECT_HIERARCHY = [
    (("frameshift", "stop_gained"), "frameshift_or_stop_gained"),
    (("stop_lost",), "stop_lost"),
    (("start_lost", "initiator_codon"), "start_lost"),
    (("splice",), "splice_site_variant"),
    (("inframe",), "inframe_variant"),
    (("missense", "non_synonymous"), "non_synonymous_codon"),
    (("synonymous",), "synonymous_codon"),
    (("utr_variant",), "utr_variant"),
    (("upstream", "downstream"), "regulatory_variant"),
    (("intron",), "intron_variant"),
    (("intergenic",), "intergenic_variant"),
]

# fixed values: the amino acids by their common abbreviations
AMINO_ACIDS = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L",
    "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}

IMPACTS = {"HIGH": 4, "MODERATE": 3, "LOW": 2, "MODIFIER": 1}


def token_flags(columns: dict[str, tuple[str, str]]) -> dict[str, Column]:
    """0/1 by a case-insensitive pattern in a column: name -> (column, pattern)."""
    return {name: flag(F.col(c).rlike(f"(?i){p}")) for name, (c, p) in columns.items()}


def gene_dimension(rows: DataFrame, gene: str, flags: list[str], tier: str | None = None, first: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """One row per gene: largest flags, smallest tier, and for text columns the first non-empty value by the order columns (the smallest
    value where there are none, or of equals), for example the place of a row in its file."""
    aggs = [F.max(c).alias(c) for c in flags]
    if tier:
        aggs.append(F.min(tier).alias(tier))
    for c in first:
        value = blank_as_null(F.col(c))
        aggs.append(F.min(F.when(value.isNotNull(), F.struct(*[F.col(o) for o in order], value.alias("value"))))["value"].alias(c))
    return rows.filter(F.col(gene).isNotNull()).groupBy(F.upper(F.trim(gene)).alias(gene)).agg(*aggs)


def combined(sources: list[DataFrame], gene: str, tier: str | None = None, text: tuple[str, ...] = ()) -> DataFrame:
    """Several gene dimensions as one: largest flags (0 where a source lacks them), smallest tier, text kept as text."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    flags = [c for c in rows.columns if c not in (gene, tier, *text)]
    return rows.groupBy(gene).agg(*[F.coalesce(F.max(c), F.lit(0)).cast("int").alias(c) for c in flags], *([F.min(tier).alias(tier)] if tier else []), *[F.min(c).alias(c) for c in text])


def arm(band: str) -> Column:
    """The chromosome arm of a band such as 17p13.1."""
    return F.nullif(F.regexp_extract(F.col(band), r"^(\d{1,2}|X|Y)([pq])", 0), F.lit(""))


def standard_effect(effect: Column) -> Column:
    """One of a few labels, the gravest that the text names; NULL is 'unknown', text that names none is 'other'."""
    text = F.lower(effect)
    out = F.when(effect.isNull(), "unknown")
    for words, label in EFFECT_HIERARCHY:
        out = out.when(reduce(Column.__or__, [text.contains(w) for w in words]), label)
    return out.otherwise("other")


def short_protein(notation: Column) -> Column:
    """p.Arg882His as p.R882H, whatever follows the second residue; unknown residues as ?. A trailing X becomes * first. Text without p. and
    notations without two residues of three letters (p.Arg882fs) stay as they are."""
    table = F.create_map(*[F.lit(x) for kv in AMINO_ACIDS.items() for x in kv])
    text = F.regexp_replace(notation, "[Xx]$", "*")
    pattern = r"^p\.([A-Za-z]{3})([0-9]+)([A-Za-z]{3}|\*)"
    a, n, b = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    residue = lambda x: F.coalesce(F.try_element_at(table, x), F.lit("?"))
    short = F.concat(F.lit("p."), residue(a), n, F.when(b == "*", b).otherwise(residue(b)))
    return F.when(~notation.startswith("p."), notation).when(text.rlike(pattern), short).otherwise(text)


ANNOTATION = "array<struct<gene_name:string,hgvs_p:string,effect:string,putative_impact:string>>"


def annotation_list(payload: Column) -> Column:
    """The `ann` entries of a payload, one object or a list of them alike."""
    many = F.try_variant_get(payload, "$.snpeff.ann", ANNOTATION)
    one = F.try_variant_get(payload, "$.snpeff.ann", ANNOTATION[6:-1])
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def cleaned_annotation(a: Column) -> Column:
    """Effect and protein notation of one entry standardised."""
    return F.struct(a["gene_name"].alias("gene_name"), short_protein(a["hgvs_p"]).alias("hgvs_p"), standard_effect(a["effect"]).alias("effect"), a["putative_impact"].alias("putative_impact"))


def cleaned_annotations(ann: Column) -> Column:
    """Effects and protein notations of all entries standardised."""
    return F.transform(ann, cleaned_annotation)


def distinct_effects(found: DataFrame, ann: str = "ann", times: str | None = None) -> DataFrame:
    """(effect, n): the distinct effects inside lists of annotations, with the number of entries that have each. `times`: how many rows a list
    stands for."""
    rows = found.select(F.col(times) if times else F.lit(1).alias("times"), F.explode(ann).alias("a"))
    return rows.select(rows.columns[0], F.col("a.effect").alias("effect")).filter("effect IS NOT NULL").groupBy("effect").agg(F.sum(rows.columns[0]).alias("n"))


def best_annotation(ann: Column) -> Column:
    """The entry of the highest impact; of equal ones, the first."""
    table = F.create_map(*[F.lit(x) for kv in IMPACTS.items() for x in kv])
    score = lambda a: F.coalesce(F.try_element_at(table, F.upper(a["putative_impact"])), F.lit(0))
    highest = F.array_max(F.transform(ann, score))
    return F.get(F.filter(ann, lambda a: score(a) == highest), F.lit(0))


def fill_from_annotations(rows: DataFrame, found: DataFrame, vid: Column, raw: bool = False) -> DataFrame:
    """Missing gene, protein change and effect from the best annotation; impact always from it; missing VAF and DEPTH from its call. With `raw`,
    the annotations are as they came, and the best one is standardised: cleaning changes no impact, so it needn't be done to the others."""
    notes = found.select(F.col("vid").alias("_vid"), best_annotation(F.col("ann")).alias("_a"), F.col("freq").alias("_f"), F.col("dp").alias("_d"))
    if raw:
        notes = notes.withColumn("_a", F.when(F.col("_a").isNotNull(), cleaned_annotation(F.col("_a"))))
    out = rows.withColumn("_key", vid).join(notes, F.col("_key") == F.col("_vid"), "left")
    return out.select(
        *[c for c in rows.columns if c not in ("GENE", "PROTEIN_CHANGE", "EFFECT", "IMPACT", "VAF", "DEPTH")],
        F.coalesce("GENE", "_a.gene_name").alias("GENE"), F.coalesce("PROTEIN_CHANGE", "_a.hgvs_p").alias("PROTEIN_CHANGE"), F.coalesce("EFFECT", "_a.effect").alias("EFFECT"),
        F.col("_a.putative_impact").alias("IMPACT"), F.coalesce("VAF", F.col("_f") / 100).alias("VAF"), F.coalesce("DEPTH", "_d").alias("DEPTH"),
    )


def exon(text: Column) -> tuple[Column, Column, Column]:
    """Number, total and their ratio of `x/y`."""
    n, total = (F.split_part(text, F.lit("/"), F.lit(i)).try_cast("double") for i in (1, 2))
    return n, total, F.try_divide(n, total)


def read_depth(ref: str, alt: str) -> tuple[Column, Column]:
    """Depth (a missing part as 0, NULL where both are) and allele fraction to 4 decimals, half to even."""
    a, b = number(F.col(ref)), number(F.col(alt))
    depth = F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return depth, F.bround(F.try_divide(b, depth), 4)


def alternative_allele(alt: str, other: str) -> Column:
    return F.coalesce(F.nullif(blank_as_null(F.col(alt)), F.lit("-")), F.col(other))


def target_from_clinic(status: str, months: str) -> tuple[Column, Column]:
    """OS_STATUS before the colon, OS_YEARS from months."""
    return F.split_part(F.col(status), F.lit(":"), F.lit(1)).try_cast("int"), number(F.col(months)) / 12


def center_label(center: str, prefix: str) -> Column:
    """With the cohort's prefix; UNKNOWN where missing."""
    c = F.coalesce(blank_as_null(F.col(center)), F.lit("UNKNOWN"))
    return F.when(c.startswith(prefix), c).otherwise(F.concat(F.lit(prefix), c))


def relational_features(parent: DataFrame, child: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Child rows summed up by parent: count; sum, mean, min, max, deviation and skewness by number; distinct values and mode by category."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in numeric:
        aggs += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.stddev_samp(c).alias(f"{c}_std"), F.when(F.min(c) < F.max(c), F.skewness(c)).alias(f"{c}_skew")]
    for c in categorical:
        aggs += [F.count_distinct(c).alias(f"{c}_distinct"), F.mode(c, True).alias(f"{c}_mode")]
    return parent.select(key).join(child.groupBy(key).agg(*aggs), key, "left").na.fill(0, subset=["n_rows"])


def value_counts(df: DataFrame, column: str, split: str | None = None, k: int | None = None) -> DataFrame:
    """Rows by value, or by token of a splitting pattern; the k most frequent on request."""
    value = F.explode(F.split(F.col(column), split)) if split else F.col(column)
    out = df.select(value.alias("value")).withColumn("value", F.trim("value")).filter("value IS NOT NULL AND value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(k) if k else out


def pattern_counts(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """(pattern, rows that contain it) from one pass."""
    row = df.agg(*[F.count_if(F.col(column).rlike(f"(?i){p}")).alias(n) for n, p in patterns.items()])
    return row.unpivot([], list(patterns), "pattern", "rows")


def harmonised_mutations(rows: DataFrame, samples: DataFrame, barcode: str, sample: str, patient: str) -> DataFrame:
    """A cohort's mutation rows in the common layout: patient by sample barcode (unmatched rows go), depth and allele fraction from reads,
    alternative allele and protein change with their fallbacks, the deepest row of each variant."""
    from tidewell.operators.ordered import first_by_key

    depth, vaf = read_depth("t_ref_count", "t_alt_count")
    known = samples.select(F.col(sample).alias("_s"), F.col(patient).alias("_p"))
    out = rows.join(known, F.col(barcode) == F.col("_s")).select(
        F.col("_p").alias("ID"), F.regexp_replace(F.col("Chromosome").cast("string"), "(?i)^chr", "").alias("CHR"), number(F.col("Start_Position")).alias("START"), number(F.col("End_Position")).alias("END"),
        F.col("Reference_Allele").alias("REF"), alternative_allele("Tumor_Seq_Allele2", "Tumor_Seq_Allele1").alias("ALT"), F.col("Hugo_Symbol").alias("GENE"),
        F.coalesce(blank_as_null(F.col("HGVSp_Short")), short_protein(F.col("HGVSp"))).alias("PROTEIN_CHANGE"), F.col("Consequence").alias("EFFECT"), vaf.alias("VAF"), depth.alias("DEPTH"),
    )
    out = out.filter("ID IS NOT NULL AND GENE IS NOT NULL")
    return first_by_key(out, ["ID", "CHR", "START", "END", "REF", "ALT", "GENE"], F.col("DEPTH").desc_nulls_last(), F.col("VAF").desc_nulls_last(), "PROTEIN_CHANGE", "EFFECT")


def patient_of_barcode(barcode: Column) -> Column:
    """A sample barcode without its last part: AB-2908-03 as AB-2908; text without parts as it is."""
    return F.regexp_replace(barcode, "-[^-]*$", "")


def structural_events(rows: DataFrame, patient: Column, columns: dict[str, str]) -> DataFrame:
    """A cohort's structural variants in the common layout: ID, and the given columns (name in the cohort -> common name)."""
    return rows.select(patient.alias("ID"), *[F.col(c).alias(name) for c, name in columns.items()])


def filled_karyotype(rows: DataFrame, events: DataFrame) -> DataFrame:
    """A missing karyotype becomes the sorted distinct structural events of the patient, joined by semicolons, or else the empty text."""
    joined = events.filter("EVENT_INFO IS NOT NULL").groupBy(F.col("ID").alias("_id")).agg(F.array_join(F.sort_array(F.collect_set("EVENT_INFO")), "; ").alias("_events"))
    rows = rows.join(joined, F.col("ID") == F.col("_id"), "left")
    text = F.coalesce(F.col("CYTOGENETICS"), F.lit(""))
    return rows.withColumn("CYTOGENETICS", F.when((text == "") & F.col("_events").isNotNull(), F.col("_events")).otherwise(text)).drop("_id", "_events")


def harmonised_clinic(patients: DataFrame, events: DataFrame, center: str, columns: dict[str, str], numeric: list[str], layout: list[str]) -> DataFrame:
    """A cohort's patients in the common layout: renamed columns, numbers as numbers, what the cohort lacks as NULL, one center, and where the
    karyotype is missing the sorted distinct structural events of the patient, joined by semicolons."""
    rows = patients.select(*[F.col(c).alias(name) for c, name in columns.items()])
    rows = rows.withColumns({c: number(F.col(c)) for c in numeric if c in rows.columns} | {c: F.lit(None).cast("double") for c in numeric if c not in rows.columns}).withColumn("CENTER", F.lit(center))
    return filled_karyotype(rows, events).select(*layout)

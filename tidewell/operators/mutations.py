"""Features of a mutation table by patient: every block is a list of aggregate expressions, and one group-by carries them all."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import flag

#: Bits of a number that an aggregation keeps flags in.
WORD = 62


@dataclass(frozen=True, eq=False)
class AnyRow:
    """1 where a row of a patient meets a condition, or has one of some values in a column, else 0."""

    condition: Column | None = None
    column: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class HowMany:
    """How many of some conditions are met by a row of a patient."""

    parts: tuple[AnyRow, ...]


#: What a block is made of: aggregates, and flags that are added up as bits of a few numbers.
Block = Mapping[str, Column | AnyRow | HowMany]


def presence(genes: list[str], prefix: str = "mut_", gene: str = "GENE") -> Block:
    """1 where a patient has a row with the gene."""
    return {f"{prefix}{g}": AnyRow(column=gene, values=(g,)) for g in genes}


def allele_fractions(limits: dict[str, float], itd_gene: str | None = "FLT3", gene: str = "GENE", vaf: str = "VAF", effect: str = "EFFECT") -> dict[str, Column]:
    """Largest fraction by gene (0 where there is none) and whether it reaches the gene's limit; the tandem-duplication gene counts as high with any such event."""
    out = {}
    for g, limit in limits.items():
        own = F.col(gene) == g
        out[f"{g}_max_VAF"] = F.coalesce(F.max(F.when(own, F.col(vaf))), F.lit(0.0))
        high = F.coalesce(F.max(F.when(own, F.col(vaf))) >= limit, F.lit(False))
        if g == itd_gene:
            high = high | F.coalesce(F.bool_or(own & (F.col(effect) == "ITD")), F.lit(False))
        out[f"{g}_high_VAF"] = high.cast("int")
    return out


def kinds(rules: dict[str, dict], gene: str = "GENE") -> Block:
    """Flags by rule: `least` rows of a gene, or a case-insensitive pattern in a column of its rows."""
    out = {}
    for name, r in rules.items():
        own = F.col(gene) == r["gene"]
        if "least" in r:
            out[name] = (F.count_if(own) >= r["least"]).cast("int")
        else:
            out[name] = AnyRow(own & F.col(r["column"]).rlike(f"(?i){r['pattern']}"))
    return out


def pathways(groups: dict[str, list[str]], gene: str = "GENE") -> Block:
    """By pathway: whether altered, and rows in it. Over all: how many are altered."""
    out, altered = {}, {name: AnyRow(column=gene, values=tuple(genes)) for name, genes in groups.items()}
    for name, genes in groups.items():
        out[f"{name}_altered"] = altered[name]
        out[f"{name}_count"] = F.count_if(F.col(gene).isin(genes))
    out["pathway_diversity_score"] = HowMany(tuple(altered.values()))
    return out


def burden(vaf: str = "VAF", high: float = 0.4) -> dict[str, Column]:
    """Rows, moments of the allele fraction, rows above the limit and their share."""
    n, above = F.count(F.lit(1)), F.count_if(F.col(vaf) > high)
    return {
        "total_mutations": n, "vaf_mean": F.avg(vaf), "vaf_median": F.median(vaf), "vaf_max": F.max(vaf),
        "vaf_std": F.coalesce(F.stddev_samp(vaf), F.lit(0.0)), "high_vaf_mutations": above, "high_vaf_ratio": above / n,
    }


def categories(column: str, values: list[str], prefix: str) -> dict[str, Column]:
    """Rows by value of a column, for a fitted list of values."""
    return {f"{prefix}{v}": F.count_if(F.col(column) == v) for v in values}


#: Categories of significance that are counted together.
TOGETHER = {"pathogenic_like": ("pathogenic", "likely_pathogenic"), "uncertain_or_conflicting": ("uncertain", "conflicting")}


def significance(column: str, patterns: dict[str, str], prefix: str = "clinvar_") -> dict[str, Column]:
    """Rows that say something and whether any does; rows whose text contains a category's name and whether any does, for each category and for
    sums of them; and the share of rows that say something which the first sum has. Containment means that 'likely_pathogenic' counts as
    'pathogenic' too, and twice in their sum."""
    said = F.count(column)
    counts = {name: F.count_if(F.lower(F.col(column)).contains(p.lower())) for name, p in patterns.items()}
    sums = {name: reduce(Column.__add__, [counts[p] for p in parts if p in counts]) for name, parts in TOGETHER.items() if set(parts) & set(counts)}
    out = {f"{prefix}annotated_variant_count": said, f"{prefix}has_any_annotation": (said > 0).cast("int")}
    for name, n in (counts | sums).items():
        out[f"{prefix}{name}_count"], out[f"{prefix}any_{name}"] = n, (n > 0).cast("int")
    if "pathogenic_like" in sums:
        out[f"{prefix}pathogenic_like_ratio"] = F.coalesce(F.try_divide(sums["pathogenic_like"], said), F.lit(0.0))
    return out


#: The flags of a gene's role, and what their sums are called.
ROLES = {"is_oncogene": "oncogene", "is_tumor_suppressor": "tsg"}


def gene_roles(columns: list[str]) -> dict[str, Column]:
    """Mutations in oncogenes and in tumour suppressors, and whether there are any, for those flags that the rows have."""
    out = {}
    for flag_name, role in ROLES.items():
        if flag_name in columns:
            n = F.coalesce(F.sum(flag_name), F.lit(0)).cast("long")
            out[f"num_{role}_muts"], out[f"any_{role}_mut"] = n, (n > 0).cast("int")
    return out


#: Impacts of a mutation.
IMPACTS = ["HIGH", "MODERATE", "LOW", "MODIFIER"]


def dimension_flags(columns: list[str]) -> dict[str, Column]:
    """Sums of joined 0/1 columns and whether any is set."""
    out = {}
    for c in columns:
        total = F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("long")
        out[f"{c}_count"], out[f"any_{c}"] = total, (total > 0).cast("int")
    return out


def tiers(column: str, values: list[int]) -> Block:
    """Smallest tier (NULL without any), rows by tier, whether any has one."""
    return {f"{column}_min": F.min(column)} | {f"tier{v}_gene_count": F.count_if(F.round(F.col(column)) == v) for v in values} | {"has_tier": AnyRow(F.col(column).isNotNull())}


#: Words in an observed effect, and the flags of a gene that say which kinds are expected.
TRUNCATING, EXPECTED_TRUNCATING = "nonsense|frameshift|splice|stop_gained|stop_lost|start_lost", ("cosmic_has_nonsense_common", "cosmic_has_frameshift_common", "cosmic_has_splice_common")


def driver_matches(columns: list[str], effect: str = "EFFECT", oncogene: str = "is_oncogene", suppressor: str = "is_tumor_suppressor", expected_missense: str = "cosmic_has_missense_common", expected_truncating: tuple[str, ...] = EXPECTED_TRUNCATING) -> dict[str, Column]:
    """Rows that look like drivers: a missense mutation in an oncogene that has such mutations, a truncating one in a tumour suppressor that
    has. `columns` are those of the table; flags that it lacks count as 0."""
    is_set = lambda c: F.coalesce(F.col(c).try_cast("double") == 1, F.lit(False)) if c in columns else F.lit(False)
    text = F.lower(F.coalesce(F.col(effect).cast("string"), F.lit("")))
    truncating = reduce(Column.__or__, [is_set(c) for c in expected_truncating])
    return {
        "oncogene_missense_match": F.count_if(is_set(oncogene) & is_set(expected_missense) & text.contains("missense")),
        "tsg_truncating_match": F.count_if(is_set(suppressor) & truncating & text.rlike(TRUNCATING)),
    }


def arms(column: str, wanted: list[str]) -> Block:
    """Whether a patient has a row on a chromosome arm."""
    return {f"mutated_arm_{a}": AnyRow(column=column, values=(a,)) for a in wanted}


def pathogenicity(score: str, high: float, ref: str = "REF", alt: str = "ALT", start: str = "START", end: str = "END") -> dict[str, Column]:
    """Largest, mean and number of high scores of single-nucleotide variants."""
    snv = (F.length(ref) == 1) & (F.length(alt) == 1) & (F.col(start) == F.col(end))
    own = F.when(snv, F.col(score))
    return {"cadd_max": F.max(own), "cadd_mean": F.avg(own), "cadd_high_count": F.count_if(own >= high)}


def distinct_values(value: Column) -> Column:
    """Distinct values of a patient's rows. As a set, since a distinct count would have all aggregates beside it computed by patient and value first."""
    return F.size(F.collect_set(value)).cast("long")


#: Aggregates that keep objects. One of them among hundreds of sums and flags takes all of those out of hash aggregation.
APART = ("vaf_median", "cosmic_gene_count")


def _words(flags: list[AnyRow]) -> list[Column]:
    """The flags of a row as bits of numbers, WORD of them in each. Values of a column are looked up in one constant table, however many flags ask for them."""
    out = []
    for i in range(0, len(flags), WORD):
        bits, parts = {f: 1 << k for k, f in enumerate(flags[i : i + WORD])}, []
        for column in dict.fromkeys(f.column for f in bits if f.column):
            masks: dict[str, int] = {}
            for f, bit in bits.items():
                for v in f.values if f.column == column else ():
                    masks[v] = masks.get(v, 0) | bit
            table = F.array(F.lit(0).cast("long"), *[F.lit(m).cast("long") for m in masks.values()])
            parts.append(F.coalesce(F.get(table, F.array_position(F.array(*map(F.lit, masks)), F.col(column)).cast("int")), F.lit(0).cast("long")))
        parts += [F.when(f.condition, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for f, bit in bits.items() if f.condition is not None]
        out.append(reduce(Column.bitwiseOR, parts))
    return out


def packed(rows: DataFrame, *blocks: Block, key: str = "ID", apart: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """All blocks in one aggregation, with flags as bits of few numbers; those `apart` in one of their own, joined by key. And what makes the features
    of that table's columns, so that it can be joined while it is narrow."""
    made = {n: c for b in blocks for n, c in b.items()}
    flags = list(dict.fromkeys(f for c in made.values() for f in ([c] if isinstance(c, AnyRow) else c.parts if isinstance(c, HowMany) else [])))
    place = {f: divmod(i, WORD) for i, f in enumerate(flags)}

    def shown(name: str, c: Column | AnyRow | HowMany) -> Column:
        bit = lambda f: F.shiftright(f"_bits{place[f][0]}", place[f][1]).bitwiseAND(F.lit(1).cast("long")).cast("int")
        return bit(c) if isinstance(c, AnyRow) else reduce(Column.__add__, map(bit, c.parts)) if isinstance(c, HowMany) else F.col(f"_is_{name}")

    words = {f"_bits{i}": w for i, w in enumerate(_words(flags))}
    own = [n for n, c in made.items() if n in apart and isinstance(c, Column)]
    rest = [F.bit_or(w).alias(w) for w in words] + [c.alias(f"_is_{n}") for n, c in made.items() if isinstance(c, Column) and n not in own]
    out = rows.withColumns(words).groupBy(key).agg(*rest) if rest else None
    if own:
        alone = rows.groupBy(F.col(key).alias("_apart")).agg(*[made[n].alias(f"_is_{n}") for n in own])
        out = alone.withColumnRenamed("_apart", key) if out is None else out.join(alone, F.col(key).eqNullSafe(F.col("_apart"))).drop("_apart")
    return out, {n: shown(n, c) for n, c in made.items()}


def by_patient(rows: DataFrame, *blocks: Block, key: str = "ID", apart: tuple[str, ...] = ()) -> DataFrame:
    """All blocks in one aggregation; those `apart` in one of their own, joined by key."""
    out, made = packed(rows, *blocks, key=key, apart=apart)
    return out.select(key, *[c.alias(n) for n, c in made.items()])


def with_blocks(patients: DataFrame, features: DataFrame, key: str = "ID", zero: bool = True) -> DataFrame:
    """Features joined to all patients; those without rows get 0."""
    new = [c for c in features.columns if c != key and c not in patients.columns]
    out = patients.join(features.select(key, *new), key, "left")
    return out.na.fill(0, subset=new) if zero else out


def comutations(df: DataFrame, rules: dict[str, dict], groups: dict[str, list[str]], prefix: str = "mut_") -> DataFrame:
    """Co-occurrence with a required status by gene, several hits in a pathway (and how many), and ratios of largest allele fractions."""
    new = {}
    for name, r in rules.items():
        if "genes" in r:
            cols = [f"{prefix}{g}" for g in r["genes"]]
            if set(cols) <= set(df.columns):
                new[name] = flag(reduce(Column.__and__, [F.col(c) == s for c, s in zip(cols, r["status"], strict=True)]))
        elif "pathway" in r:
            cols = [f"{prefix}{g}" for g in groups[r["pathway"]] if f"{prefix}{g}" in df.columns]
            if cols:
                hits = reduce(Column.__add__, [F.col(c) for c in cols])
                new[f"{name}_hits"], new[name] = hits, flag(hits >= r["least"])
        else:
            a, b = f"{r['numerator']}_max_VAF", f"{r['denominator']}_max_VAF"
            if {a, b} <= set(df.columns):
                new[name] = F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) / (F.col(b) + F.lit(1e-6))).otherwise(0.0)
    return df.withColumns(new)


def any_of(df: DataFrame, columns: list[str]) -> Column:
    have = [F.coalesce(F.col(c), F.lit(0)) == 1 for c in columns if c in df.columns]
    return reduce(Column.__or__, have) if have else F.lit(False)


def molecular_risk(df: DataFrame, favorable: list[str], adverse: list[str], encode: str = "one_hot", weights: dict[str, float] | None = None) -> DataFrame:
    """Favorable, intermediate or adverse by 0/1 columns; adverse overrides. One-hot columns, or one weighted column."""
    label = F.when(any_of(df, adverse), "adverse").when(any_of(df, favorable), "favorable").otherwise("intermediate")
    if encode == "one_hot":
        return df.withColumns({f"eln_mol_{x}": (label == x).cast("int") for x in ("favorable", "intermediate", "adverse")})
    weights = weights or {"favorable": 0.0, "intermediate": 0.7, "adverse": 1.0}
    return df.withColumn("eln_mol_risk", F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[label])


def interactions(df: DataFrame, rules: dict[str, dict]) -> tuple[DataFrame, list[str]]:
    """base = 1 and (any_of / none_of / all_of other columns). Rules whose columns are missing are left out and reported."""
    new, skipped = {}, []
    for name, r in rules.items():
        lists = {k: [c for c in r.get(k, []) if c in df.columns] for k in ("any_of", "none_of", "all_of")}
        if r["base"] not in df.columns or any(r.get(k) and not lists[k] for k in lists):
            skipped.append(name)
            continue
        test = F.coalesce(F.col(r["base"]), F.lit(0)) == 1
        if lists["any_of"]:
            test = test & any_of(df, lists["any_of"])
        if lists["none_of"]:
            test = test & ~any_of(df, lists["none_of"])
        for c in lists["all_of"]:
            test = test & (F.coalesce(F.col(c), F.lit(0)) == 1)
        new[name] = test.cast("int")
    return df.withColumns(new), skipped


def arm_cross(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Mutated arm and loss of the same arm."""
    return df.withColumns({f"mut_in_{a}_and_del{a}": flag((F.col(f"mutated_arm_{a}") == 1) & (F.col(c) == 1)) for a, c in pairs.items() if {f"mutated_arm_{a}", c} <= set(df.columns)})


def frequent(wanted: list[str], least: int, *tables: DataFrame, gene: str = "GENE") -> DataFrame:
    """Wanted categories that all tables together have at least `least` rows of: counts added over the union of keys."""
    rows = reduce(DataFrame.unionByName, [t.select(gene) for t in tables])
    return rows.filter(F.col(gene).isin(wanted)).groupBy(gene).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def base_counts(column: str, letters: str = "ACGT", key: str = "ID") -> dict[str, Column]:
    """Letters over all rows of a patient, by counting what replacement takes away."""
    c = F.coalesce(F.col(column), F.lit(""))
    return {f"{column}_{x}": F.sum(F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))) for x in letters}


def spans(start: str = "START", end: str = "END") -> dict[str, Column]:
    return {"span_sum": F.sum(F.coalesce(F.col(end) - F.col(start) + 1, F.lit(0.0)))}


def amino_position(protein: str = "PROTEIN_CHANGE") -> Column:
    return F.regexp_extract(F.col(protein), r"p\.[A-Za-z*]+(\d+)", 1).try_cast("double")


def chromosome_number(chromosome: str = "CHR") -> Column:
    """1 to 22, X as 23, Y as 24."""
    c = F.upper(F.regexp_replace(F.col(chromosome), "(?i)^chr", ""))
    return F.when(c == "X", 23).when(c == "Y", 24).otherwise(c.try_cast("int"))


def patient_totals(rows: DataFrame, effects: list[str], key: str = "ID") -> DataFrame:
    """Effect sums, lengths, amino-acid positions, rows, distinct genes and the share of allele fractions above 0.3."""
    rows = rows.withColumns({"_len": F.col("END") - F.col("START") + 1, "_aa": amino_position()})
    return rows.groupBy(key).agg(
        *[F.count_if(F.col("EFFECT") == e).alias(f"effect_{e}") for e in effects],
        F.sum("_len").alias("mut_length_sum"), F.avg("_len").alias("mut_length_mean"), F.max("_len").alias("mut_length_max"),
        F.sum("_aa").alias("aa_sum"), F.avg("_aa").alias("aa_mean"), F.min("_aa").alias("aa_min"), F.max("_aa").alias("aa_max"),
        F.count(F.lit(1)).alias("n_mutations"), F.count_distinct("GENE").alias("n_genes"),
        F.avg(flag(F.col("VAF") > 0.3)).alias("share_high_vaf"),
    )


def variant_id(chrom: str = "CHR", start: str = "START", ref: str = "REF", alt: str = "ALT", snv_only: bool = False) -> Column:
    """chr<CHR>:g.<START><REF>><ALT>; NULL where a part is missing."""
    part = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    bare = F.regexp_replace(part(chrom), "(?i)^chr", "")
    place = F.col(start).cast("long").cast("string")
    vid = F.concat(F.lit("chr"), bare, F.lit(":g."), place, part(ref), F.lit(">"), part(alt))
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), vid) if snv_only else vid

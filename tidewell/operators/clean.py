"""Validation and cleaning of patient, mutation and survival tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.nulls import number
from tidewell.operators.fitted import quantiles


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what doesn't read as a finite number becomes NULL."""
    return df.withColumns({c: number(F.col(c)) for c in columns if c in df.columns})


def within(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their closed range become NULL."""
    return df.withColumns({c: F.when(F.col(c).between(F.lit(float(lo)), F.lit(float(hi))), F.col(c)) for c, (lo, hi) in ranges.items() if c in df.columns})


def clean_target(df: DataFrame, time: str = "OS_YEARS", status: str = "OS_STATUS", scale: float = 1.0) -> DataFrame:
    """Rows with a positive time and a status that reads as a number, the time scaled. A status that doesn't read as one drops the row."""
    out = df.withColumns({time: number(F.col(time)), status: number(F.col(status)).cast("int")})
    out = out.filter(F.col(time).isNotNull() & F.col(status).isNotNull() & (F.col(time) > 0))
    return out.withColumn(time, F.col(time) * F.lit(float(scale))) if scale != 1 else out


def of_patients(df: DataFrame, patients: DataFrame, key: str = "ID") -> DataFrame:
    """Rows whose key the other table has."""
    return df.join(patients.select(key), key, "left_semi")


def without_patients(df: DataFrame, patients: DataFrame, key: str = "ID") -> DataFrame:
    """Rows whose key the other table doesn't have."""
    return df.join(patients.select(key), key, "left_anti")


def clean_clinical(df: DataFrame, target: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with a target, measures as numbers within their ranges."""
    return within(to_numbers(of_patients(df, target), columns), ranges)


def trusted_mutation(vaf: str = "VAF", depth: str = "DEPTH", gene: str = "GENE", effect: str = "EFFECT", protein: str = "PROTEIN_CHANGE", least_depth: int = 10) -> Column:
    """Allele fraction in [0, 1] at enough depth, or an event whose calling depth doesn't matter: internal tandem duplications of any gene,
    partial tandem duplications of MLL (KMT2A)."""
    has = lambda c, x: F.coalesce(F.upper(F.col(c)).contains(x), F.lit(False))
    measured = F.coalesce(F.col(vaf).between(0.0, 1.0) & (F.col(depth) >= least_depth), F.lit(False))
    itd = F.coalesce(F.col(effect) == "ITD", F.lit(False)) | has(protein, "ITD")
    ptd = F.col(gene).isin("MLL", "KMT2A") & (has(effect, "PTD") | has(protein, "PTD"))
    return measured | itd | F.coalesce(ptd, F.lit(False))


def clean_mutations(df: DataFrame, target: DataFrame | None = None) -> DataFrame:
    rows = df if target is None else of_patients(df, target)
    return rows.filter(trusted_mutation())


def clean_tables(clinical: DataFrame, mutations: DataFrame, target: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables, cleaned and limited to patients with a valid target."""
    valid = clean_target(target)
    return clean_clinical(clinical, valid, columns, ranges), clean_mutations(mutations, valid), valid


def as_floats(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles as 4-byte floats: the named ones, or all but `keep`."""
    chosen = [f.name for f in df.schema.fields if f.dataType.typeName() == "double" and (columns is None or f.name in columns) and f.name not in keep]
    return df.withColumns({c: F.col(c).cast("float") for c in chosen})


def choose(df: DataFrame, wanted: list[str] | None, always: tuple[str, ...] = ("ID",)) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that don't. Without a list or any overlap the table stays as it is."""
    if wanted is None:
        return df, []
    have = [c for c in df.columns if c in wanted]
    missing = [c for c in wanted if c not in df.columns]
    return (df.select(*[c for c in always if c in df.columns and c not in have], *have) if have else df), missing


def aligned(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of another table, in its order and types; missing ones are NULL."""
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in like.schema.fields])


def redundant(columns: list[str], keep_missing: tuple[str, ...] | None = None, counts_of_altered: bool = False, counts_of_any: bool = False, listed: tuple[str, ...] = ()) -> list[str]:
    """Names to drop by the redundancy rules: numeric sex where it is one-hot, counts beside their flag, indicators that aren't to be kept,
    and the listed ones. Counts from the gene census are exempt."""
    have, out = set(columns), []
    if "sex_chromosomes" in have and {"SEX_XX", "SEX_XY"} & have:
        out.append("sex_chromosomes")
    for c in columns:
        if c.endswith("_count") and not c.startswith("cosmic_"):
            stem = c.removesuffix("_count")
            if counts_of_altered and f"{stem}_altered" in have or counts_of_any and f"any_{stem}" in have:
                out.append(c)
        if keep_missing is not None and c.endswith("_missing") and c.removesuffix("_missing") not in keep_missing:
            out.append(c)
    return list(dict.fromkeys(out + [c for c in listed if c in have]))


def winsorized(df: DataFrame, columns: list[str], q: float = 0.25, times: float = 1.5) -> DataFrame:
    """Values pulled to [Q(q) - times x IQR, Q(1-q) + times x IQR]."""
    out = {}
    for c, (lo, hi) in quantiles(df, columns, [q, 1 - q]).items():
        out[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(lo - times * (hi - lo))), F.lit(hi + times * (hi - lo))))
    return df.withColumns(out)


def sampled(df: DataFrame, n: int, seed: int = 42, key: str = "ID", order: Column | None = None) -> DataFrame:
    """n rows, the first by a seeded hash of the key or by another order."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)) if order is None else order, key).limit(n)


def placeholder_target(df: DataFrame, key: str = "ID") -> DataFrame:
    """A target row (time 1, no event) for rows that are only to be scored."""
    return df.select(key, F.lit(1.0).alias("OS_YEARS"), F.lit(0).alias("OS_STATUS"))


def variable_kinds(df: DataFrame, continuous: list[str], binary_tokens: tuple[str, ...] = ("mut_", "_altered", "has_", "any_", "_high_VAF"), count_tokens: tuple[str, ...] = ("_count", "n_", "num_", "total_"), skip: tuple[str, ...] = ("ID",)) -> dict[str, list[str]]:
    """Columns by kind: continuous (listed), categorical (text), binary (two values at most and a telling name), count (by name), ordinal.

    One aggregation counts the distinct values of all columns."""
    kinds: dict[str, list[str]] = {"continuous": [], "binary": [], "count": [], "ordinal": [], "categorical": []}
    numeric = []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if f.dataType.typeName() == "string":
            kinds["categorical"].append(f.name)
        elif f.name in continuous:
            kinds["continuous"].append(f.name)
        else:
            numeric.append(f.name)
    seen = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in numeric]).first() if numeric else {}
    for c in numeric:
        if seen[c] <= 2 and any(t in c for t in binary_tokens):
            kinds["binary"].append(c)
        elif any(t in c for t in count_tokens):
            kinds["count"].append(c)
        else:
            kinds["ordinal"].append(c)
    return kinds

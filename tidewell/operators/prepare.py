"""From raw tables to a feature matrix: one lazy plan, with actions only where something is fitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import config as C
from tidewell.operators import clean, clinical, fitted, karyotype, mutations
from tidewell.operators.ordered import settle


@dataclass
class Annotations:
    """What is known about genes and variants, each table optional.

    genes: GENE, 0/1 flags, and `tier` and `arm` where known (genes.gene_dimension and genes.arm make it); significance: vid and CLNSIG
    (readers.vcf makes it); scores: vid and score (readers.score_cache makes it). One row for each gene or variant. A table with all three
    columns can be given as both.
    """

    genes: DataFrame | None = None
    significance: DataFrame | None = None
    scores: DataFrame | None = None
    tiers: tuple[int, ...] = (1, 2)

    def blocks(self, rows: DataFrame) -> tuple[DataFrame, list[mutations.Block]]:
        """Mutation rows with the annotations joined to them, and the aggregates of those that there are."""
        blocks: list[mutations.Block] = []
        if self.genes is not None:
            new = [c for c in self.genes.columns if c not in rows.columns]
            rows = rows.join(self.genes.select("GENE", *new), "GENE", "left")
            flags = [c for c in new if c not in ("tier", "arm", *mutations.ROLES)]
            blocks += [mutations.gene_roles(rows.columns), mutations.dimension_flags(flags), mutations.driver_matches(rows.columns), {"cosmic_gene_count": mutations.distinct_values(F.when(F.greatest(*[F.col(c).isNotNull().cast("int") for c in new], F.lit(0)) > 0, F.col("GENE")))}]
            if "tier" in new:
                blocks.append(mutations.tiers("tier", list(self.tiers)))
            if "arm" in new:
                blocks.append(mutations.arms("arm", list(C.ARMS)))
        wanted = [(t, own, name) for t, own, name in ((self.significance, "CLNSIG", "CLNSIG"), (self.scores, "score", "_score")) if t is not None]
        if wanted:
            rows = rows.withColumn("_vid", mutations.variant_id())
        for table in {id(t): t for t, _, _ in wanted}.values():  # one that has both is joined once
            rows = rows.join(table.select(F.col("vid").alias("_vid"), *[F.col(own).alias(name) for t, own, name in wanted if t is table]), "_vid", "left")
        if self.significance is not None:
            blocks.append(mutations.significance("CLNSIG", C.CLINVAR_CATEGORIES))
        if self.scores is not None:
            blocks.append(mutations.pathogenicity("_score", C.CADD_HIGH))
        return rows, blocks


def features(patients: DataFrame, mutation_rows: DataFrame, known: Annotations | None = None, leave: tuple[str, ...] = (), extra: bool = False) -> DataFrame:
    """Clinical, cytogenetic, molecular, annotation, co-mutation, risk, interaction and arm blocks of cleaned tables; absent mutation features
    are 0. `leave` names blocks to leave out: clinical, cytogenetic, molecular, annotations, comutations, risk, interactions, arms; `extra`
    adds the two interactions that are off by default."""
    rows, blocks = known.blocks(mutation_rows) if known and "annotations" not in leave else (mutation_rows, [])
    if "molecular" not in leave:
        blocks = [mutations.presence(C.GENES), mutations.allele_fractions(C.VAF_THRESHOLDS), mutations.kinds(C.MUTATION_TYPES), mutations.pathways(C.PATHWAYS), mutations.burden(), *([mutations.categories("IMPACT", mutations.IMPACTS, "impact_")] if "IMPACT" in rows.columns else []), *blocks]
    out, made = patients, {}
    if blocks:  # both sides of the join are narrow: flags are bits, and the patients have no features yet
        summed, made = mutations.packed(rows, *blocks, apart=mutations.APART)
        out = out.join(summed, "ID", "left")
        made = {n: c for n, c in made.items() if n not in patients.columns}
    held = set(out.columns) - set(patients.columns)
    if "clinical" not in leave:
        out = clinical.clinical_features(out, C.MEASURES, C.RATIOS, C.THRESHOLDS, C.SCORES, C.SCORE_FLAGS)
    if "cytogenetic" not in leave:
        out = karyotype.with_cytogenetics(out)
    made = {n: c for n, c in made.items() if n not in out.columns}
    out = out.select(*[c for c in out.columns if c not in held], *[c.alias(n) for n, c in made.items()]).na.fill(0, subset=list(made))
    if "comutations" not in leave:
        out = mutations.comutations(out, C.COMUTATIONS, C.PATHWAYS)
    if "risk" not in leave:
        out = mutations.molecular_risk(out, [f"mut_{g}" for g in C.FAVORABLE_GENES], [f"mut_{g}" for g in C.ADVERSE_GENES])
    if "interactions" not in leave:
        out, _ = mutations.interactions(out, C.INTERACTIONS | (C.EXTRA_INTERACTIONS if extra else {}))
    return out if "arms" in leave else mutations.arm_cross(out, C.ARMS)


def matrix(patients: DataFrame, mutation_rows: DataFrame, target: DataFrame, test: DataFrame) -> tuple[DataFrame, list[str]]:
    """Features of training (with a valid target) and test rows together, preprocessed, without columns that don't vary, and what was dropped.

    `test` has the keys of the rows to score; `split` says which is which."""
    valid = clean.clean_target(target)
    keys = valid.select("ID").join(test.select("ID"), "ID", "left_anti").withColumn("split", F.lit("train")).unionByName(test.select("ID").withColumn("split", F.lit("test")))
    cleaned = clean.within(clean.to_numbers(patients.join(keys, "ID"), C.MEASURES), C.RANGES)
    cleaned = fitted.group_rare(cleaned, "CENTER", cleaned.filter("split = 'train'"), C.RARE_CENTER, C.OTHER_CENTER, "CENTER_GROUP")
    made = features(cleaned.drop("CENTER"), clean.clean_mutations(mutation_rows, keys)).drop("CYTOGENETICS")
    drop = clean.redundant(made.columns, keep_missing=("WBC", "HB", "PLT", "ANC", "MONOCYTES"))
    made = settle(made.drop(*drop))  # computed once for all fits
    kinds = {"continuous": [c for c in C.MEASURES if c in made.columns], "categorical": ["CENTER_GROUP"], "ordinal": [c for c in made.columns if c not in (*C.MEASURES, "ID", "split", "CENTER_GROUP")]}
    ready = settle(fitted.fit_preprocess(made, kinds).transform(made))
    flat = fitted.zero_variance(ready, [c for c in ready.columns if c not in ("ID", "split")], "split")
    return ready.drop(*flat), [*drop, *flat]

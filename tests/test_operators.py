"""Operators on literals with answers worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import nulls
from tidewell.operators import clean, clinical, drift, fitted, genes, joins, karyotype, legacy, mutations, ordered, survival
from tidewell.plans import catalog


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 1.0)], "ID string, x double")
    assert [r.x for r in nulls.clean_doubles(df).orderBy("ID").collect()] == [None, None, 1.0]
    text = spark.createDataFrame([("NA",), (" ",), ("2.5",), ("x",), (None,)], "t string")
    assert [r[0] for r in text.select(nulls.number(nulls.blank_as_null(F.col("t"), "NA"))).collect()] == [None, None, 2.5, None, None]


def test_clean_target_and_ranges(spark):
    t = spark.createDataFrame([("a", "1.5", "1"), ("b", "0", "1"), ("c", None, "0"), ("d", "2", "x")], "ID string, OS_YEARS string, OS_STATUS string")
    assert [(r.ID, r.OS_YEARS, r.OS_STATUS) for r in clean.clean_target(t).collect()] == [("a", 1.5, 1)]
    c = spark.createDataFrame([("a", 0.0), ("b", 400.0), ("c", 400.1), ("d", None)], "ID string, WBC double")
    assert [r.WBC for r in clean.within(c, {"WBC": (0, 400)}).orderBy("ID").collect()] == [0.0, 400.0, None, None]


def test_trusted_mutations(spark):
    rows = [("TP53", "x", "p", 0.5, 10.0), ("TP53", "x", "p", 0.5, 9.0), ("FLT3", "ITD", "p", None, None), ("MLL", "PTD", "p", None, 1.0), ("TP53", "PTD", "p", None, 1.0), ("X", None, "A_ITD", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "GENE string, EFFECT string, PROTEIN_CHANGE string, VAF double, DEPTH double")
    assert [r.ok for r in df.select(clean.trusted_mutation().alias("ok")).collect()] == [True, False, True, True, False, True]


def test_ratio_and_threshold(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0)], "ANC double, WBC double")
    out = df.select(clinical.ratios({"q": ("ANC", "WBC")})["q"].alias("q"), clinical.thresholds({"low": ("ANC", "<", 1.5)})["low"].alias("low")).collect()
    assert [tuple(r) for r in out] == [(0.5, 1), (None, 1), (None, 0)]
    with pytest.raises(ValueError):
        clinical.formula("A; drop")


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 20.0), ("d", 30.0), ("e", None)], "ID string, x double")
    assert [r["rank"] for r in ordered.average_ranks(df, "x").orderBy("ID").collect()] == [1.0, 2.5, 2.5, 4.0, None]
    assert [r["rank"] for r in ordered.average_ranks(df, "x", share=True).orderBy("ID").collect()] == [0.25, 0.625, 0.625, 1.0, None]


def test_prefix_sums_equal_a_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 101).cast("double").alias("x"))
    got = {(r.g, r.x): r.n_before for r in ordered.prefix_sums(df, "x", {"n": F.lit(1)}, ("g",)).collect()}
    rows = [(r.g, r.x) for r in df.collect()]
    assert got == {(g, x): sum(1 for h, y in rows if h == g and y < x) for g, x in set(rows)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("45,XY,-7[12]/46,XY[8]", ({"n_minus": 1}, 0, 2, 20, 12, 1, 0.6)),
        ("47,XX,+8[10]/48,idem,+21[10]", ({"n_plus": 2}, 1, 2, 20, 10, 1, 1.5)),
        ("44,XY,-5,-7,del(17)(p13),+mar[15]", ({"n_del": 1, "n_mar": 1, "n_minus": 2}, 0, 1, 1, 1, 4, 4.0)),
        ("complex", ({}, 0, 1, 1, 1, 3, 3.0)),
        ("normal", ({}, 0, 1, 1, 1, 0, 0.0)),
        ("45,X,-Y[9]/46,XY[cp4]", ({"n_minus": 1}, 0, 2, 5, 4, 0, 0.2)),
        ("46,XX,t(8;21)(q22;q22)[20]", ({"n_t": 1}, 0, 1, 20, 20, 1, 1.0)),
        ("46,XX,del(5)(q13q33),-18,add(3)(q26),der(12)t(12;13)(p13;q14)[20]", ({"n_del": 1, "n_minus": 1, "n_add": 1, "n_der": 1}, 0, 1, 20, 20, 4, 4.0)),
        (None, ({}, 0, 0, 0, 0, 0, 0.0)),
    ],
)
def test_karyotype_clones(spark, text, want):
    r = karyotype.clones(spark.createDataFrame([("p", text)], "ID string, CYTOGENETICS string")).first()
    counts = {k: r[k] for k in karyotype.EVENTS if r[k]}
    assert (counts, r.has_idem, r.clone_count, r.total_cell_count, r.main_clone_cell_count, r.main_clone_abnormality_count, round(r.num_cyto_abnormalities, 9)) == want


def test_missing_karyotype_leaves_features_null(spark):
    r = karyotype.cytogenetics(spark.createDataFrame([("p", None)], "ID string, CYTOGENETICS string")).first().asDict()
    assert r.pop("ID") == "p" and r.pop("cyto_is_missing") == 1 and set(r.values()) == {None}


def test_presence_and_blocks(spark):
    m = spark.createDataFrame([("a", "TP53"), ("a", "NPM1"), ("b", "X")], "ID string, GENE string")
    p = spark.createDataFrame([("a",), ("b",), ("c",)], "ID string")
    out = mutations.with_blocks(p, mutations.by_patient(m, mutations.presence(["TP53", "NPM1"])))
    assert [tuple(r) for r in out.orderBy("ID").collect()] == [("a", 1, 1), ("b", 0, 0), ("c", 0, 0)]


def test_interactions_report_missing_columns(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (0, 1, 0)], "base int, x int, y int")
    out, skipped = mutations.interactions(df, {"i": {"base": "base", "any_of": ["x"], "none_of": ["y"]}, "j": {"base": "nope", "any_of": ["x"]}})
    assert [r.i for r in out.collect()] == [1, 0, 0] and skipped == ["j"]


def test_variant_id_needs_all_parts(spark):
    df = spark.createDataFrame([("chr1", 5.0, "A", "C"), ("2", 5.0, "A", None), ("3", 7.0, "AT", "C")], "CHR string, START double, REF string, ALT string")
    assert [tuple(r) for r in df.select(mutations.variant_id(), mutations.variant_id(snv_only=True)).collect()] == [("chr1:g.5A>C", "chr1:g.5A>C"), (None, None), ("chr3:g.7AT>C", None)]


def test_concordance_goldens(spark):
    def c(rows):
        return survival.concordance(spark.createDataFrame(rows, "ID string, OS_YEARS double, OS_STATUS int, s double"), "s").first().c_index

    assert c([("a", 1.0, 1, 3.0), ("b", 2.0, 1, 2.0), ("c", 3.0, 1, 1.0)]) == 1.0
    assert c([("a", 1.0, 1, 1.0), ("b", 2.0, 1, 1.0), ("c", 3.0, 1, 1.0)]) == 0.5
    assert c([("a", 1.0, 1, 1.0), ("b", 2.0, 1, 2.0), ("c", 3.0, 1, 3.0)]) == 0.0


def test_concordance_equals_brute_force(spark):
    rows = [(str(i), float(1 + (i * 31) % 17), int(i % 3 != 0), float((i * 17) % 13)) for i in range(120)]
    got = survival.concordance(spark.createDataFrame(rows, "ID string, OS_YEARS double, OS_STATUS int, s double"), "s", tau=14.0).first()
    times = sorted({t for _, t, _, _ in rows})
    g, surv = {}, 1.0
    for t in times:
        d = sum(1 for r in rows if r[1] == t and r[2] == 1)
        q = sum(1 for r in rows if r[1] == t and r[2] == 0)
        n = sum(1 for r in rows if r[1] >= t)
        surv *= 1 - q / max(n - d, 1)
        g[t] = surv
    num = den = pairs = 0
    for _, ti, ei, si in rows:
        if ei and ti < 14.0:
            for _, tj, ej, sj in rows:
                if tj > ti or (tj == ti and not ej):
                    w = 1 / g[ti] ** 2
                    num += w * (1.0 if si > sj else 0.5 if si == sj else 0.0)
                    den += w
                    pairs += 1
    assert math.isclose(got.c_index, num / den, rel_tol=1e-9) and got.comparable == pairs


def test_kaplan_meier_falls_within_bounds(spark):
    rows = [(str(i), float(1 + i % 9), i % 2) for i in range(50)]
    s = [r.survival for r in survival.kaplan_meier(spark.createDataFrame(rows, "ID string, OS_YEARS double, OS_STATUS int")).orderBy("OS_YEARS").collect()]
    assert all(0 <= x <= 1 for x in s) and s == sorted(s, reverse=True)


def test_drift_goldens(spark):
    long = spark.createDataFrame([("f", float(x), b) for b, xs in ((0, (1, 2, 3)), (1, (2, 3, 4))) for x in xs], "feature string, value double, in_b int")
    r = drift.distances(long, least=1).first()
    assert math.isclose(r.ks, 1 / 3) and math.isclose(r.wasserstein, 1.0)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "x double")
    q = fitted.quantiles(df, ["x"], [0.01, 0.5])["x"]
    assert math.isclose(q[0], 1.03) and q[1] == 3.0


def test_preprocess_round_trip_and_fixed_schema(spark):
    df = spark.createDataFrame([(float(i), i % 2, "a" if i % 3 else None) for i in range(20)], "x double, mut_b int, c string")
    model = fitted.fit_preprocess(df, {"continuous": ["x"], "binary": ["mut_b"], "categorical": ["c"]})
    again = fitted.PreprocessModel.from_json(model.to_json())
    new = spark.createDataFrame([(None, None, "zzz")], "x double, mut_b int, c string")
    assert again.transform(new).columns == ["x", "mut_b", "c_Unknown", "c_a"]
    assert tuple(again.transform(new).first())[1:] == (0, 0, 0)


def test_correlation_pruning_sides():
    m = [[1.0, 0.99, 0.1], [0.99, 1.0, 0.1], [0.1, 0.1, 1.0]]
    assert fitted.correlated_drops(["a", "b", "c"], m, 0.96) == ["a"]
    assert fitted.correlated_drops(["a", "b", "c"], m, 0.96, keep="first") == ["b"]
    assert fitted.correlated_drops(["x_median", "x_mean", "c"], m, 0.96, [("mean", "median")]) == ["x_median"]


def test_quantiles_from_running_counts_equal_sorted_ones(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 50, 501).astype(float), "b": np.round(rng.normal(size=40), 2), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)], "feature string, value double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = ordered.long_quantiles(df, "value", at, "feature")
    assert set(got) == set(values) and all(np.allclose(got[k], np.quantile(v, at)) for k, v in values.items())


def test_next_values_cross_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 3 % 1009).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("g"))
    rows = ordered.prefix_sums(df, "x", {"n": F.lit(1)}, ("g",), following="then").collect()
    for g in "pq":
        xs = sorted(r.x for r in rows if r.g == g)
        assert {r.x: r.then for r in rows if r.g == g} == dict(zip(xs, [*xs[1:], None], strict=True))


def test_driver_matches_need_gene_flags_and_kind(spark):
    df = spark.createDataFrame([("p", "Missense_Variant", 1, 1, 0, 0), ("p", "missense", 1, 0, 0, 0), ("p", "stop_gained", 0, 0, 1, 1), ("p", None, 1, 1, 1, 1), ("p", "splice_x", 0, 0, 1, 0)], "ID string, EFFECT string, is_oncogene int, cosmic_has_missense_common int, is_tumor_suppressor int, cosmic_has_splice_common int")
    r = mutations.by_patient(df, mutations.driver_matches(df.columns)).first()
    assert (r.oncogene_missense_match, r.tsg_truncating_match) == (1, 1)
    assert mutations.by_patient(df.select("ID", "EFFECT"), mutations.driver_matches(["ID", "EFFECT"])).first().tsg_truncating_match == 0


def test_group_folds_keep_groups(spark):
    df = spark.createDataFrame([(str(i), f"g{i % 7}") for i in range(70)], "ID string, g string")
    folds = survival.group_folds(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert {r.n for r in folds} == {1}


def test_effects_and_proteins(spark):
    df = spark.createDataFrame([("missense_variant", "p.Arg882His"), (None, "p.Gly12Ter"), ("splice_donor&intron", "p.R882H"), ("weird", "p.Arg1Xyz"), ("stop_gained&splice", "p.Arg882fs"), ("UTR_variant", "p.R882X"), ("start_lost", "c.5A>G"), ("Inframe_deletion", None)], "e string, p string")
    got = [tuple(r) for r in df.select(genes.standard_effect(F.col("e")), genes.short_protein(F.col("p"))).collect()]
    assert got == [("non_synonymous_codon", "p.R882H"), ("unknown", "p.G12?"), ("splice_site_variant", "p.R882H"), ("other", "p.R1?"), ("frameshift_or_stop_gained", "p.Arg882fs"), ("utr_variant", "p.R882*"), ("start_lost", "c.5A>G"), ("inframe_variant", None)]


def test_best_annotation_takes_the_first_of_the_highest(spark):
    df = spark.sql("""SELECT array(named_struct('gene_name','a','hgvs_p','','effect','','putative_impact','LOW'), named_struct('gene_name','b','hgvs_p','','effect','','putative_impact','HIGH'), named_struct('gene_name','c','hgvs_p','','effect','','putative_impact','HIGH')) AS ann""")
    assert df.select(genes.best_annotation(F.col("ann"))["gene_name"]).first()[0] == "b"


def test_outer_blocks_fill_zero(spark):
    a, b = spark.createDataFrame([("x", 1)], "ID string, p int"), spark.createDataFrame([("y", 2)], "ID string, q int")
    assert [tuple(r) for r in joins.outer_blocks([a, b]).orderBy("ID").collect()] == [("x", 1, 0), ("y", 0, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "ID string, OS_YEARS double, OS_STATUS int, s double")
    assert ordered.average_ranks(empty, "s").count() == 0
    assert survival.kaplan_meier(empty).count() == 0
    assert clean.clean_target(empty).count() == 0


def test_last_known_value_is_carried_over_ranges(spark):
    rows = [(float(i), 0, float(i) if i % 10 == 3 else None) for i in range(300)]
    got = ordered.last_known(spark.createDataFrame(rows, "t double, k int, v double"), "t", "k", "v", "out").orderBy("t").collect()
    assert [r.out for r in got] == [None if i < 3 else float((i - 3) // 10 * 10 + 3) for i in range(300)]


def test_concordance_with_other_training_rows(spark):
    schema = "ID string, OS_YEARS double, OS_STATUS int, s double"
    train = spark.createDataFrame([(str(i), float(i) + 0.5, i % 2, 0.0) for i in range(10)], schema)
    test = spark.createDataFrame([("a", 1.0, 1, 3.0), ("b", 4.0, 1, 2.0), ("c", 6.0, 0, 2.5)], schema)
    g = {t: math.prod(1 - (1 / (10 - i)) * (i % 2 == 0) for i in range(10) if i + 0.5 <= t) for t in (1.0, 4.0)}
    w = {t: 1 / g[t] ** 2 for t in g}
    want = (w[1.0] * 2) / (w[1.0] * 2 + w[4.0])  # a before b and c: both concordant; b before c: discordant
    assert math.isclose(survival.concordance(test, "s", train=train).first().c_index, want, rel_tol=1e-9)


def test_karyotype_summaries_read_each_text_once(spark, monkeypatch):
    texts, seen = ["46,XX[20]", "45,XY,-7[12]/46,XY[8]", " ", None], []
    keep = legacy.settle
    monkeypatch.setattr(legacy, "settle", lambda df: seen.append(keep(df)) or seen[-1])
    rows = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "ID int, CYTOGENETICS string")
    for version in (1, 2, 3, 4):
        got = legacy.karyotype_summary(rows, version=version).collect()
        assert seen[-1].count() == 4 and sorted(r["ID"] for r in got) == list(range(40))
        assert all(r["num_monosomies"] == (0 if r["ID"] % 4 != 1 else 12 if version >= 2 else 1) for r in got)


def test_zero_variance_aggregates_only_what_the_first_rows_leave_open(spark, monkeypatch):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"), F.col("id").alias("varies"), F.lit(1).alias("flat"), (F.col("id") >= 5998).cast("int").alias("late"),
        F.lit(None).cast("double").alias("empty"), F.when(F.col("id") != 4001, 1).alias("gap"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise("x").alias("one_side"), F.lit(float("nan")).alias("nan"),
    )
    names = [c for c in rows.columns if c != "split"]
    monkeypatch.setattr(fitted, "FIRST_ROWS", 50)
    asked, keep = [], fitted._flat
    monkeypatch.setattr(fitted, "_flat", lambda df, columns, many: asked.append(columns) or keep(df, columns, many))
    assert fitted.zero_variance(rows, names, "split") == ["flat", "empty", "gap", "one_side", "nan"]
    assert fitted.zero_variance(rows, names, "split", ("flat", "nan")) == ["empty", "gap", "one_side"]
    assert all("varies" not in c for c in asked[1::2])


def test_concordance_by_group_spreads_slices_and_not_rows(spark, monkeypatch):
    """Scores of which some are alone and one has many rows; what is spread over bit levels is sums by slice."""
    monkeypatch.setattr(ordered, "RANGES", 4)
    rows = [(g, float(1 + (i * 31) % 9), int(i % 3 != 0), float(i * 37 % 401) if i % 4 else 100.0) for g in "ab" for i in range(400 if g == "a" else 90)]
    df, seen, keep = spark.createDataFrame(rows, "g string, OS_YEARS double, OS_STATUS int, s double"), [], survival._strictly_below
    monkeypatch.setattr(survival, "_strictly_below", lambda cells, node: seen.append(cells) or keep(cells, node))
    got = {r.g: r for r in survival.concordance(df, "s", train=df, by=("g",)).collect()}
    w = {r.OS_YEARS: r.weight for r in survival.censoring_weights(df, df, None).collect()}
    for g in "ab":
        own = [r[1:] for r in rows if r[0] == g]
        pairs = [(w[ti], (si > sj) + (si == sj) / 2) for ti, ei, si in own if ei for tj, ej, sj in own if tj > ti or (tj == ti and not ej)]
        assert math.isclose(got[g].c_index, sum(a * b for a, b in pairs) / sum(a for a, _ in pairs), rel_tol=1e-9) and got[g].comparable == len(pairs)
    assert sum(c.count() for c in seen) < len(rows) * 2


@pytest.mark.parametrize("query", ["gene_flags_by_patient", "mutation_quality_filter"])
def test_tasks_that_group_by_key_hold_a_share_of_the_rows(spark, monkeypatch, query):
    monkeypatch.setattr(ordered, "SHARE", 100)
    out = catalog.queries()[query](spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert out.rdd.getNumPartitions() == -(-lines // 100)  # the session's number of shuffle partitions before


def test_a_median_stands_apart_from_hash_aggregation(spark, capsys):
    rows = spark.createDataFrame([("a", "TP53", 0.5), ("a", "KIT", 0.1), ("a", "KIT", None), ("b", "KIT", None), (None, "TP53", 0.2)], "ID string, GENE string, VAF double")
    blocks = mutations.presence(["TP53", "KIT"]), mutations.burden()
    apart, together = mutations.by_patient(rows, *blocks, apart=mutations.APART), mutations.by_patient(rows, *blocks)
    assert apart.columns == together.columns and sorted(map(str, apart.collect())) == sorted(map(str, together.collect()))
    apart.explain()
    assert " HashAggregate(" in (plan := capsys.readouterr().out) or "- HashAggregate(" in plan  # only ObjectHashAggregate before


def test_flags_are_added_up_as_bits_of_few_numbers(spark, capsys):
    names = [f"G{i}" for i in range(100)]
    rows = spark.createDataFrame([("a", "G0", "ITD"), ("a", "G99", None), ("a", "G99", "x"), ("b", "G61", "x"), ("b", "G62", "itd"), ("b", None, "x"), (None, "G1", "x"), ("c", "other", None)], "ID string, GENE string, EFFECT string")
    kinds = mutations.kinds({"itd": {"gene": "G0", "column": "EFFECT", "pattern": "ITD"}, "twice": {"gene": "G99", "least": 2}})
    out = mutations.by_patient(rows, mutations.presence(names), kinds, mutations.pathways({"p": ["G0", "G1"], "q": ["G62", "G99"], "r": ["G61"]}), {"genes": mutations.distinct_values(F.col("GENE"))}, apart=("genes",))
    got = {r.ID: r.asDict() for r in out.collect()}
    assert {k: [g for g in names if r[f"mut_{g}"] == 1] for k, r in got.items()} == {"a": ["G0", "G99"], "b": ["G61", "G62"], None: ["G1"], "c": []}
    assert all(r[f"mut_{g}"] in (0, 1) for r in got.values() for g in names)
    some = ("itd", "twice", "p_altered", "p_count", "q_altered", "q_count", "r_altered", "pathway_diversity_score", "genes")
    assert {k: tuple(r[c] for c in some) for k, r in got.items()} == {"a": (1, 1, 1, 1, 1, 2, 0, 2, 2), "b": (0, 0, 0, 0, 1, 1, 1, 2, 2), None: (0, 0, 1, 1, 0, 0, 0, 1, 1), "c": (0, 0, 0, 0, 0, 0, 0, 0, 1)}
    out.explain()
    plan = capsys.readouterr().out
    assert "max(" not in plan and "distinct" not in plan and "bit_or(" in plan  # a maximum for each flag before

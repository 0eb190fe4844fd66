"""Features from a graph of tables against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators.relational import CATEGORY, NUMBER, Relation, Tables


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(2)
    people = pd.DataFrame({"p": range(12), "age": rng.integers(20, 60, 12).astype(float), "town": list("abcabcabcabc")})
    orders = pd.DataFrame({"o": range(60), "p": rng.integers(0, 10, 60), "price": rng.integers(1, 50, 60).astype(float), "way": rng.choice(list("xyz"), 60)})
    lines = pd.DataFrame({"o": rng.integers(0, 50, 300), "n": rng.integers(1, 9, 300).astype(float), "good": rng.choice(["g1", "g2", "g3"], 300)})
    frames = {"people": people, "orders": orders, "lines": lines}
    columns = {"people": {"age": NUMBER, "town": CATEGORY}, "orders": {"price": NUMBER, "way": CATEGORY}, "lines": {"n": NUMBER, "good": CATEGORY}}
    relations = [Relation("people", "orders", "p", "p"), Relation("orders", "lines", "o", "o")]
    return frames, Tables({n: spark.createDataFrame(f) for n, f in frames.items()}, columns, relations)


def test_stacked_features_equal_pandas(shop):
    frames, tables = shop
    lines, orders, people = frames["lines"], frames["orders"], frames["people"]
    g = lines.groupby("o").n
    per = orders.merge(pd.DataFrame({"s": g.sum(), "m": g.mean(), "d": g.std(), "c": g.size()}), left_on="o", right_index=True, how="left")
    per = per.fillna({"s": 0, "c": 0})
    by = per.groupby("p")
    want = pd.DataFrame({
        "orders_count": by.size(), "orders_price_mean": by.price.mean(), "orders_price_std": by.price.std(), "orders_way_distinct": by.way.nunique(),
        "orders_way_mode": by.way.agg(lambda v: v.mode().min()), "orders_lines_n_sum_mean": by.s.mean(), "orders_lines_n_mean_max": by.m.max(),
        "orders_lines_n_std_min": by.d.min(), "orders_lines_count_sum": by.c.sum(),
    }).reindex(people.p)
    want[["orders_count", "orders_way_distinct", "orders_lines_count_sum"]] = want[["orders_count", "orders_way_distinct", "orders_lines_count_sum"]].fillna(0)
    plan = {f.name: f for f in tables.plan("people")}
    got = tables.compute([plan[c] for c in want], ["p"]).toPandas().sort_values("p").set_index("p")
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_names=False)


def test_the_plan_holds_every_typed_stack_once(shop):
    plan = shop[1].plan("people")
    assert len({f.name for f in plan}) == len(plan) and max(f.depth for f in plan) == 2
    numbers, categories = 6, 2  # primitives that take a column of the kind
    lines = 1 + numbers + categories  # of orders from lines: count, those of n, those of good, of which the mode is a category
    orders = 1 + numbers + categories + (lines - 1) * numbers + categories
    assert sum(f.depth > 0 for f in plan) == orders
    assert {f.name for f in shop[1].plan("people", 0)} == {"age", "town"}


def test_parents_columns_come_down(shop):
    frames, tables = shop
    plan = {f.name: f for f in tables.plan("lines")}
    got = tables.compute([plan["n"], plan["orders_price"], plan["orders_people_age"], plan["orders_people_town"]]).toPandas()
    want = frames["lines"].merge(frames["orders"], on="o", how="left").merge(frames["people"], on="p", how="left")
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want[["n", "price", "age", "town"]].to_numpy()))


def test_one_group_by_for_each_relation_and_nothing_unneeded(shop):
    _, tables = shop
    plan = [f for f in tables.plan("people") if not f.name.endswith(("distinct", "mode"))]
    text = tables.compute(plan, ["p"])._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 2 and text.count("Join ") == 2
    few = tables.compute([f for f in plan if f.name == "orders_price_sum"], ["p"])
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_no_rows_null_keys_and_wrong_names(spark, shop):
    _, tables = shop
    lines = tables.frames["lines"].withColumn("o", F.when(F.col("n") > 100, F.col("o")))
    none = Tables({**tables.frames, "lines": lines}, tables.columns, tables.relations)
    plan = {f.name: f for f in none.plan("orders", 1)}
    assert {tuple(r) for r in none.compute([plan["lines_count"], plan["lines_n_sum"], plan["lines_n_mean"]]).collect()} == {(0, 0.0, None)}
    empty = Tables({n: f.filter("false") for n, f in tables.frames.items()}, tables.columns, tables.relations)
    assert empty.compute(empty.plan("people"), ["p"]).count() == 0
    with pytest.raises(ValueError, match="no such column"):
        Tables(tables.frames, tables.columns, [Relation("people", "orders", "p", "nothing")])
    with pytest.raises(ValueError, match="no such primitive"):
        Tables(tables.frames, tables.columns, [], ("median",))
    with pytest.raises(ValueError, match="one table"):
        tables.compute([*tables.plan("people", 0), *tables.plan("lines", 0)])


def test_categories_leave_numbers_to_hash_aggregation(spark, capsys):
    people = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    rows = spark.createDataFrame([(1, 2.0, "y"), (1, 3.0, "x"), (1, None, None), (2, 5.0, None), (None, 7.0, "z"), (1, 1.0, "z"), (1, 1.0, "z"), (1, 1.0, "a"), (1, 1.0, "a")], "p int, n double, c string")
    t = Tables({"people": people, "rows": rows}, {"people": {}, "rows": {"n": NUMBER, "c": CATEGORY}}, [Relation("people", "rows", "p", "p")], ("count", "sum", "distinct", "mode"))
    out = t.compute(t.plan("people", 1), ["p"])
    assert out.columns == ["p", "rows_count", "rows_n_sum", "rows_c_distinct", "rows_c_mode"]
    assert sorted(map(tuple, out.collect())) == [(1, 7, 9.0, 4, "a"), (2, 1, 5.0, 0, None), (3, 0, 0.0, 0, None)]
    out.explain()
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" not in plan and "count(distinct" not in plan  # a mode and a distinct count stood beside the sums before

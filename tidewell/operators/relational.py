"""Features of a table from the tables around it: relations as a graph, aggregates and direct columns stacked to a depth, planned before any data is read.

A plan is a list of Features, each with the steps it is made of. It says what a table needs from its children and parents, so that all aggregates
over one relation come out of one group-by and each parent is joined once; a plan that is cut down to chosen features computes nothing else. The same
plan makes the same columns of other tables of the same layout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER, CATEGORY = "number", "category"


@dataclass(frozen=True)
class Primitive:
    """An aggregate: what kind of column it takes (None: rows, no column), what kind it gives, how it is computed (None: only from counts), its value
    without rows, and how it is computed from the distinct values with their counts `_n`."""

    takes: str | None
    gives: str
    of: Callable[[Column], Column] | None
    empty: float | None = None
    counted: Callable[[Column], Column] | None = None


#: By name. A mode takes the smallest of the most frequent values.
PRIMITIVES = {
    "count": Primitive(None, NUMBER, F.count, 0),
    "sum": Primitive(NUMBER, NUMBER, F.sum, 0),
    "mean": Primitive(NUMBER, NUMBER, F.avg),
    "min": Primitive(NUMBER, NUMBER, F.min),
    "max": Primitive(NUMBER, NUMBER, F.max),
    "std": Primitive(NUMBER, NUMBER, F.stddev_samp),
    "skew": Primitive(NUMBER, NUMBER, lambda c: F.when(F.min(c) < F.max(c), F.skewness(c))),
    "distinct": Primitive(CATEGORY, NUMBER, F.count_distinct, 0, F.count),
    "mode": Primitive(CATEGORY, CATEGORY, None, None, lambda c: F.min(F.struct(-F.col("_n"), c.alias("value")))["value"]),
}


@dataclass(frozen=True)
class Relation:
    """Rows of `child` whose `child_key` equals `parent_key`, which is unique in `parent`."""

    parent: str
    child: str
    parent_key: str
    child_key: str


@dataclass(frozen=True)
class Feature:
    """A column of `table`: its own (no relation), the aggregate of a child's feature, or a parent's feature."""

    table: str
    name: str
    kind: str
    depth: int = 0
    relation: Relation | None = None
    source: Feature | None = None
    primitive: str | None = None


@dataclass
class Tables:
    """Tables by name with the columns that features may be made of, by kind; keys aren't among them unless they are named."""

    frames: dict[str, DataFrame]
    columns: dict[str, dict[str, str]]
    relations: list[Relation]
    primitives: tuple[str, ...] = tuple(PRIMITIVES)

    def __post_init__(self) -> None:
        for r in self.relations:
            if missing := [f"{t}.{c}" for t, c in ((r.parent, r.parent_key), (r.child, r.child_key)) if t not in self.frames or c not in self.frames[t].columns]:
                raise ValueError(f"no such column: {', '.join(missing)}")
        if unknown := set(self.primitives) - set(PRIMITIVES):
            raise ValueError(f"no such primitive: {', '.join(sorted(unknown))}")

    def plan(self, target: str, depth: int = 2, came: tuple[Relation, ...] = ()) -> list[Feature]:
        """All features of a table up to a depth; a relation isn't taken twice on a way."""
        out = [Feature(target, c, k) for c, k in self.columns.get(target, {}).items()]
        if depth == 0:
            return out
        for r in self.relations:
            if r in came:
                continue
            if r.parent == target:
                label = self._label(r, r.child)
                below = self.plan(r.child, depth - 1, (*came, r))
                if "count" in self.primitives:
                    out.append(Feature(target, f"{label}_count", NUMBER, 1, r, None, "count"))
                for f in below:
                    out += [Feature(target, f"{label}_{f.name}_{p}", PRIMITIVES[p].gives, f.depth + 1, r, f, p) for p in self.primitives if PRIMITIVES[p].takes == f.kind]
            if r.child == target:
                out += [Feature(target, f"{self._label(r, r.parent)}_{f.name}", f.kind, f.depth + 1, r, f) for f in self.plan(r.parent, depth - 1, (*came, r))]
        return out

    def _label(self, r: Relation, other: str) -> str:
        """The other table's name; with the child's key where two relations connect the same tables."""
        alike = [q for q in self.relations if (q.parent, q.child) == (r.parent, r.child)]
        return f"{other}_by_{r.child_key}" if len(alike) > 1 else other

    def compute(self, features: Iterable[Feature], keep: Iterable[str] = ()) -> DataFrame:
        """The rows of the features' table with the columns in `keep` and the features. A row without children has 0 for counts and sums."""
        features = list(dict.fromkeys(features))
        if len(tables := {f.table for f in features}) != 1:
            raise ValueError(f"features of one table are needed, these are of {sorted(tables)}")
        if len({f.name for f in features} | set(keep)) < len(features) + len(set(keep)):
            raise ValueError("names clash")
        table = self.frames[tables.pop()]
        out = table.select("*", *[F.col(f.name).alias(f"_own_{f.name}") for f in features if f.relation is None])
        for r in dict.fromkeys(f.relation for f in features if f.relation):
            for up in (False, True):
                mine = [f for f in features if f.relation == r and (f.primitive is None) == up]
                if mine:
                    out = self._with_parent(out, r, mine) if up else self._with_children(out, r, mine)
        named = [F.col(f"_own_{f.name}").alias(f.name) if f.relation is None else F.col(f"_new_{f.name}").alias(f.name) for f in features]
        return out.select(*keep, *named)

    def _with_children(self, out: DataFrame, r: Relation, features: list[Feature]) -> DataFrame:
        """All aggregates over one relation: one group-by and one join. Those of a category with a mode have their own, since a mode and a distinct
        count beside the numbers would take all of them out of hash aggregation."""
        counted = dict.fromkeys(f.source for f in features if PRIMITIVES[f.primitive].of is None)
        if plain := [f for f in features if f.source not in counted]:
            rows = self._children(r, [f.source for f in plain if f.source])
            out = self._joined(out, r, rows.groupBy("_key").agg(*[PRIMITIVES[f.primitive].of(F.col(f.source.name) if f.source else F.lit(1)).alias(f"_new_{f.name}") for f in plain]))
        for source in counted:
            rows = self._children(r, [source]).select("_key", F.col(source.name).alias("_value")).filter("_value IS NOT NULL")
            counts = rows.groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
            out = self._joined(out, r, counts.groupBy("_key").agg(*[PRIMITIVES[f.primitive].counted(F.col("_value")).alias(f"_new_{f.name}") for f in features if f.source == source]))
        return out.na.fill({f"_new_{f.name}": PRIMITIVES[f.primitive].empty for f in features if PRIMITIVES[f.primitive].empty is not None})

    def _children(self, r: Relation, needed: list[Feature]) -> DataFrame:
        """Rows of a relation's child with their parent's key as `_key` and the needed features."""
        needed = list(dict.fromkeys(needed))
        child = self.compute(needed, [r.child_key] if r.child_key not in {f.name for f in needed} else []) if needed else self.frames[r.child].select(r.child_key)
        return child.filter(F.col(r.child_key).isNotNull()).select(F.col(r.child_key).alias("_key"), *[f.name for f in needed])

    def _joined(self, out: DataFrame, r: Relation, made: DataFrame) -> DataFrame:
        return out.join(made, F.col(r.parent_key) == F.col("_key"), "left").drop("_key")

    def _with_parent(self, out: DataFrame, r: Relation, features: list[Feature]) -> DataFrame:
        needed = [f.source for f in features]
        parent = self.compute(needed, [r.parent_key] if r.parent_key not in {f.name for f in needed} else [])
        made = parent.select(F.col(r.parent_key).alias("_key"), *[F.col(f.source.name).alias(f"_new_{f.name}") for f in features])
        return out.join(made, F.col(r.child_key) == F.col("_key"), "left").drop("_key")

"""Gaps filled from the nearest rows, exactly and without all pairs.

The distance of two rows runs over the columns that both have: sqrt(p / common * sum of squared differences), p being the number of columns. Donors
lie in blocks: rows that lack the same columns, cut by a k-d tree. Each block is summed up as a box of smallest and largest values, so that the
distance from a row to anything in the block has a lower bound, whichever columns the two have in common. A gap first searches the blocks that lie
nearest until k donors have been seen; its k-th distance then bounds what it still has to look at, and only blocks whose lower bound reaches that far
are searched.

Gaps of the same column in rows that have the same columns look at donors alike: only the columns that those rows have count. Where there are many
such gaps, they get donors of their own, cut by these columns alone, and of donors that agree in them only the k smallest values, since no
others can be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ordered import settle

#: Donors of a block, gaps that one task takes to a block, rows that the tree's cuts are taken from, patterns of missing columns that get blocks of
#: their own (the others share theirs), and numbers that the boxes of all blocks hold at most (blocks are larger beyond that).
BLOCK, GAPS, SAMPLE, PATTERNS, OWN, NUMBERS = 4096, 20_000, 65_536, 128, 16, 4_000_000

#: Lower bounds are taken this much lower, for rounding.
_SLACK = 1 - 1e-9


@dataclass
class Boxes:
    """Blocks of donors by row: values lie between low and high where present; `has` counts the rows with each column, `rows` all of them;
    `kinds` says which kind of gaps a block is for (0: all that have none of their own)."""

    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    has: np.ndarray
    rows: np.ndarray
    kinds: np.ndarray

    def of(self, kind: int) -> Boxes:
        own = self.kinds == kind
        return Boxes(*(a[own] for a in (self.ids, self.low, self.high, self.has, self.rows, self.kinds)))

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Smallest possible squared distance of each row of x (gaps: NaN) to each block: the columns that all donors of a block have give the sum,
        the columns that any of them has give the divisor."""
        p, here = x.shape[1], ~np.isnan(x)
        always, ever = self.has == self.rows[:, None], self.has > 0
        total = np.zeros((len(x), len(self.ids)))
        for c in range(p):
            apart = np.maximum(np.maximum(self.low[None, :, c] - x[:, c, None], x[:, c, None] - self.high[None, :, c]), 0)
            total += np.where(here[:, c, None] & always[None, :, c], apart**2, 0)
        common = here.astype(float) @ ever.T.astype(float)
        return np.where(common > 0, total * p / np.maximum(common, 1), np.inf) * _SLACK

    def nearest(self, bounds: np.ndarray, column: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(which blocks a gap may use at all, which of them are its first ones: the nearest that together have k values of its column)."""
        usable = (self.has[:, column].T > 0) & np.isfinite(bounds)
        order = np.argsort(np.where(usable, bounds, np.inf), axis=1, kind="stable")
        counts = np.take_along_axis(np.where(usable, self.has[:, column].T, 0), order, 1)
        first = np.zeros_like(usable)
        np.put_along_axis(first, order, counts.cumsum(1) - counts < k, 1)
        return usable, first & usable


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances over common columns, scaled up for missing ones; infinite without a common column. Columns are added in their order, so a
    pair has the same distance wherever it is computed."""
    p, total = x.shape[1], np.zeros((len(x), len(y)))
    for c in range(p):
        total += np.nan_to_num((x[:, c, None] - y[None, :, c]) ** 2)
    common = (~np.isnan(x)).astype(float) @ (~np.isnan(y)).T.astype(float)
    return np.where(common > 0, total * p / np.maximum(common, 1), np.inf)


def tree_cuts(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(column, value) of each inner node of a k-d tree, in heap order: the column of the largest spread is cut at its median."""
    nodes, level = [], [sample]
    for _ in range(depth):
        below = []
        for rows in level:
            column = int(np.argmax(np.ptp(rows, axis=0))) if len(rows) else 0
            at = float(np.median(rows[:, column])) if len(rows) else 0.0
            nodes.append((column, at))
            left = rows[:, column] <= at
            below += [rows[left], rows[~left]]
        level = below
    return nodes


def _matrix(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return pdf[columns].to_numpy(dtype=float, na_value=np.nan)


class Search:
    """The k nearest donors of every gap of `columns`. `key` has to be unique."""

    def __init__(self, df: DataFrame, columns: list[str], k: int, key: str, block: int = BLOCK) -> None:
        self.columns, self.k, self.p = columns, k, len(columns)
        named = df.select(F.col(key).cast("string").alias("key"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)])
        self.x = [f"x{i}" for i in range(self.p)]
        self.rows = settle(named.withColumn("pattern", self._pattern()))
        self._place(block)

    def _donors(self, patterns: dict[str, int], block: int) -> DataFrame:
        """Rows as donors, with the kind of gaps that they are for. Sets `self.kinds`: (pattern, column) of gaps -> kind, from 1 on."""
        gaps = sorted(((n, q, j) for q, n in patterns.items() if "1" in q for j in range(self.p) if q[j] == "0"), key=lambda g: (-g[0], *g[1:]))
        self.kinds = {(q, j): i for i, (n, q, j) in enumerate(gaps[:OWN], 1) if n >= block}
        parts = [self.rows.filter(F.col("pattern").contains("1")).withColumn("kind", F.lit(0))]
        for (q, j), kind in self.kinds.items():
            seen, value = [self.x[i] for i in range(self.p) if q[i] == "1"], self.x[j]
            nth = F.row_number().over(Window.partitionBy(*seen).orderBy(value))
            best = self.rows.filter(F.col(value).isNotNull() & F.coalesce(*seen).isNotNull()).select("key", *seen, value).withColumn("nth", nth).filter(F.col("nth") <= self.k)
            parts.append(best.select("key", *[F.col(c) if c in (*seen, value) else F.lit(None).cast("double").alias(c) for c in self.x]).withColumn("pattern", self._pattern()).withColumn("kind", F.lit(kind)))
        return settle(reduce(DataFrame.unionByName, parts))

    def _pattern(self) -> Column:
        return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in self.x])

    def _place(self, block: int) -> None:
        """Cut the donors into blocks and take their boxes."""
        frequent = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(PATTERNS).collect()
        given = self._donors({r["pattern"]: r["n"] for r in frequent(self.rows, "pattern")}, block)
        sizes = {r["kind"]: r["n"] for r in given.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # OWN + 1 rows
        block = max(block, -(-6 * self.p * sum(sizes.values()) // NUMBERS))
        # groups 0 to OWN have the rows of a kind's further patterns; each group is cut as deep as its rows need
        listed = {(r["kind"], r["pattern"]): r["n"] for r in frequent(given, "kind", "pattern")}
        rest = [sizes.get(i, 0) - sum(n for (kind, _), n in listed.items() if kind == i) for i in range(OWN + 1)]
        depths = np.array([int(np.ceil(np.log2(max(1.0, m / block)))) for m in (*rest, *listed.values())])
        groups = {q: i for i, q in enumerate(listed, OWN + 1)}
        x, cuts = self.x, {}
        for kind in sizes:
            depth = max([depths[kind], *(depths[g] for (i, _), g in groups.items() if i == kind)])
            some = given.filter(F.col("kind") == kind).orderBy(F.xxhash64("key", *x), "key", *x).limit(SAMPLE) if depth else given.limit(0)
            values = _matrix(some.select(*x).toPandas(), x)  # SAMPLE rows at most
            middle = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in values.T]) if len(values) else np.zeros(self.p)
            values = np.where(np.isnan(values), middle, values)
            values[:, [j for (_, j), i in self.kinds.items() if i == kind]] = 0.0  # what the gaps lack doesn't cut
            nodes = tree_cuts(values, int(depth))
            cuts[kind] = middle, np.array([c for c, _ in nodes], "int64"), np.array([at for _, at in nodes])

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for kind, pdf in whole.groupby("kind"):
                    middle, by, ats = cuts[kind]
                    v = _matrix(pdf, x)
                    v, node = np.where(np.isnan(v), middle, v), np.zeros(len(pdf), "int64")
                    group = pdf["pattern"].map({q: g for (i, q), g in groups.items() if i == kind}).fillna(kind).to_numpy("int64")
                    for level in range(int(depths[group].max(initial=0))):
                        deeper = np.flatnonzero(depths[group] > level)
                        column, at = by[node[deeper]], ats[node[deeper]]
                        node[deeper] = 2 * node[deeper] + 1 + (v[deeper, column] > at)
                    yield pdf.assign(block=group * 2**32 + node)

        kinds = "key string, " + ", ".join(f"{c} double" for c in x) + ", pattern string, kind int, block long"
        self.donors = settle(given.mapInPandas(place, kinds))
        boxes = self.donors.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), *[f(c).alias(f"{f.__name__}_{c}") for c in x for f in (F.min, F.max, F.count)]).orderBy("block").toPandas()
        take = lambda what: _matrix(boxes, [f"{what}_{c}" for c in x])
        self.boxes = Boxes(boxes["block"].to_numpy("int64"), take("min"), take("max"), take("count"), boxes["n"].to_numpy(float), boxes["kind"].to_numpy("int64"))

    def _gaps(self) -> DataFrame:
        """One row for each gap: the row's values, the column, and the kind of donors that it has."""
        kind = reduce(lambda c, g: c.when((F.col("pattern") == g[0][0]) & (F.col("col") == g[0][1]), g[1]), self.kinds.items(), F.when(F.lit(False), 0)).otherwise(0)
        missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(self.x)]), lambda i: i.isNotNull())
        return self.rows.filter(F.col("pattern").contains("0") & F.col("pattern").contains("1")).select("key", *self.x, "pattern", F.explode(missing).alias("col")).withColumn("kind", kind).drop("pattern")

    def _routes(self, gaps: DataFrame, first: bool) -> DataFrame:
        """Gaps with the blocks that they have to search: their first ones, or the others that lie within their bound."""
        boxes, k, x = self.donors.sparkSession.sparkContext.broadcast(self.boxes), self.k, self.x

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for kind, own in whole.groupby("kind"):
                    b = boxes.value.of(kind)
                    for at in range(0, len(own), 256):
                        pdf = own.iloc[at : at + 256]
                        low = b.bounds(_matrix(pdf, x))
                        usable, near = b.nearest(low, pdf["col"].to_numpy(), k)
                        wanted = near if first else usable & ~near & (low <= pdf["bound"].to_numpy(float)[:, None])
                        row, block = np.nonzero(wanted)
                        yield pdf.drop(columns=["bound", "kind"], errors="ignore").iloc[row].assign(block=b.ids[block])

        return gaps.mapInPandas(route, "key string, " + ", ".join(f"{c} double" for c in x) + ", col int, block long")

    def _searched(self, routes: DataFrame) -> DataFrame:
        """The k best donors of each gap in each block that it was sent to; the gaps of a block are dealt to as many tasks as they need."""
        k, x = self.k, self.x
        parts = settle(routes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / GAPS).cast("int").alias("parts")))  # a row for each block
        dealt = routes.join(F.broadcast(parts), "block").withColumn("part", F.pmod(F.xxhash64("key", "col"), F.col("parts")).cast("int")).drop("parts")
        given = self.donors.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("block", "part", *x)

        def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            y, out = _matrix(b, x), []
            for j, own in a.groupby("col"):
                donors = y[~np.isnan(y[:, j])]
                if not len(donors):
                    continue
                for at in range(0, len(own), 512):
                    part = own.iloc[at : at + 512]
                    d = distances(_matrix(part, x), donors)
                    near = np.partition(d, min(k, len(donors)) - 1, axis=1)[:, min(k, len(donors)) - 1]
                    m = int((d <= near[:, None]).sum(1).max())  # with the ties of the k-th
                    some = np.argpartition(d, m - 1, axis=1)[:, :m]
                    dist, value = np.take_along_axis(d, some, 1), donors[some, j]
                    order = np.lexsort((value, dist), axis=1)[:, :k]
                    dist, value = np.take_along_axis(dist, order, 1), np.take_along_axis(value, order, 1)
                    out.append(pd.DataFrame({"key": np.repeat(part["key"].to_numpy(), order.shape[1]), "col": j, "dist": dist.ravel(), "value": value.ravel()}))
            found = pd.concat(out) if out else pd.DataFrame({"key": [], "col": [], "dist": [], "value": []})
            return found[np.isfinite(found["dist"].astype(float))]

        return dealt.groupBy("block", "part").cogroup(given.groupBy("block", "part")).applyInPandas(best, "key string, col int, dist double, value double")

    def _k_best(self, found: DataFrame) -> DataFrame:
        """(key, col, best): the k smallest (distance, value) of each gap, in order; each block has handed on k of them at most."""
        pair = F.struct("dist", "value")
        return found.groupBy("key", "col").agg(F.slice(F.sort_array(F.collect_list(pair)), 1, self.k).alias("best"))

    def run(self) -> DataFrame:
        """(key, col, best) for each gap that has a donor with a common column."""
        gaps = settle(self._gaps())
        self.first = settle(self._routes(gaps, True))
        seen = settle(self._searched(self.first))
        bound = self._k_best(seen).select("key", "col", F.when(F.size("best") >= self.k, F.element_at("best", -1)["dist"]).otherwise(F.lit(float("inf"))).alias("bound"))
        bounded = gaps.join(bound, ["key", "col"], "left").select("key", *self.x, "col", "kind", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        self.rest = settle(self._routes(bounded, False))
        return self._k_best(seen.unionByName(self._searched(self.rest)))

    def share(self) -> float:
        """After run(): pairs of gap and donor whose distance was computed, as a share of all pairs of gap and row of the table."""
        sizes = self.donors.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        looked = self.first.select("block").unionByName(self.rest.select("block")).groupBy("block").agg(F.count(F.lit(1)).alias("m")).join(sizes, "block").agg(F.sum(F.col("m") * F.col("n"))).first()[0]
        return (looked or 0) / max(self._gaps().count() * self.rows.count(), 1)


def knn_impute(df: DataFrame, columns: list[str], k: int = 4, key: str = "ID", blocks: int | None = None) -> DataFrame:
    """Each gap becomes the mean of the k nearest donors that have the value (of equal distances, the smaller value first); where no donor shares
    a column with the row, the mean of the column. A column without any value stays empty. `key` has to be unique. `blocks`: about so many blocks, instead of blocks of BLOCK rows."""
    found = Search(df, columns, k, key, max(1, -(-df.count() // blocks)) if blocks else BLOCK).run()
    mean = lambda best: F.aggregate(best, F.lit(0.0), lambda s, r: s + r["value"]) / F.size(best)
    means = found.groupBy("key").agg(*[F.max(F.when(F.col("col") == j, mean(F.col("best")))).alias(f"_v{j}") for j in range(len(columns))])
    numbers = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    whole = df.agg(*[F.avg(numbers[c]).alias(c) for c in columns]).first()
    fill = lambda j, c: F.coalesce(numbers[c], F.col(f"_v{j}"), F.lit(whole[c]).cast("double")).alias(c)
    return df.join(means, df[key].cast("string") == means["key"], "left").select(*[fill(columns.index(c), c) if c in columns else F.col(c) for c in df.columns])

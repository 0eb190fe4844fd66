"""Centroid clustering in whole numbers, with distances ruled out in rotated coordinates.

A vector's components become integers floor(64 * x). All vectors' second moments give the principal axes; each vector is stored with its
leading rotated coordinates, as many as hold SHARE of the variance, and the norm of the rest. For a vector x and a centroid c, the squared distance of the leading coordinates plus the
squared difference of the rest norms is never above the squared distance. So a task takes the centroid with the lowest bound, computes its exact
distance, and computes further distances, in int64, for those centroids only whose bound (less a margin for rounding) doesn't exceed the best
so far. Ties and results are decided by integers alone; the axes, in floating point, decide no more than the work.

The driver holds centroids and the moments of 64 components, whatever the number of vectors: sums are made by tasks and by a grouped sum.

Defined results: vectors of another length, or with a null or non-finite component, are left out, and so is a null vector; a component beyond
LARGEST / 64 in size is an error, since squared distances of such vectors don't fit 64 bits; repeated rows are vectors of their own, each of which
can start a centroid; of equal start hashes (repeated or null ids; a null id is written as no digits) the componentwise smaller vector comes first;
with fewer vectors than centroids each vector starts one; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import settle

#: Components, centroids, rounds of moving them, share of the variance that leading coordinates hold, largest integer of a component, rows that are
#: compared at a time. Vectors without preferred directions need many coordinates, others few.
WIDTH, CENTROIDS, ROUNDS, SHARE, LARGEST, BLOCK = 64, 16, 3, 0.8, 2**27, 8192
_SCALE = 64


def whole(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and the integers of each vector that is kept."""
    x = F.col("embedding")
    kept = vectors.filter((F.size(x) == width) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    scaled = F.transform(x, lambda v: F.floor(v.cast("double") * _SCALE))
    fits = ~F.exists(x, lambda v: F.abs(v) > LARGEST / _SCALE)
    return kept.select("vec_id", F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // _SCALE} in size"))).alias("x"))


def starts(ints: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The vectors whose ids hash smallest, in that order."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.x for r in ints.select(by.alias("by"), "x").orderBy("by", "x").limit(k).collect()], dtype=np.int64)


def _matrix(batch: pa.RecordBatch, name: str, width: int, kind) -> np.ndarray:
    values = batch.column(name)
    return np.asarray(values.flatten(), dtype=kind).reshape(len(values), width)


def _summed(rows: DataFrame) -> list:
    """Rows (at, s) added up exactly by `at`."""
    return rows.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()


@dataclass(frozen=True)
class Axes:
    """The mean of the vectors, and the leading principal axes as columns."""

    mean: np.ndarray
    lead: np.ndarray

    def rotated(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of what they leave of each row."""
        d = x - self.mean
        y = d @ self.lead
        return y, np.sqrt(np.maximum(np.einsum("ij,ij->i", d, d) - np.einsum("ij,ij->i", y, y), 0))


def principal_axes(ints: DataFrame, width: int = WIDTH, share: float = SHARE) -> Axes:
    """From the second moments of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, n = np.zeros((width + 1, width)), 0
        for batch in batches:
            x = _matrix(batch, "x", width, np.float64)
            moments[:width] += x.T @ x
            moments[width] += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(moments.size)), pa.array(moments.ravel()), pa.array(np.full(moments.size, n))], names=["at", "s", "n"])

    found = _summed(ints.select("x").mapInArrow(run, "at long, s double, n long"))
    moments, n = np.zeros((width + 1) * width), 1
    for r in found:
        moments[r["at"]], n = r["s"], max(r["n"], 1)
    moments = moments.reshape(width + 1, width) / n
    mean = moments[width]
    values, axes = np.linalg.eigh(moments[:width] - np.outer(mean, mean))
    held = np.cumsum(np.maximum(values[::-1], 0))
    lead = min(width, int(np.searchsorted(held, share * held[-1])) + 1)
    return Axes(mean, np.ascontiguousarray(axes[:, ::-1][:, :lead]))


def stored(ints: DataFrame, axes: Axes) -> DataFrame:
    """vec_id, x, the leading coordinates and the rest norm."""
    width, lead = axes.lead.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, rest = axes.rotated(_matrix(batch, "x", width, np.float64))
            y = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, lead), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), y, pa.array(rest)], names=["vec_id", "x", "lead", "rest"])

    return ints.mapInArrow(run, "vec_id long, x array<long>, lead array<double>, rest double")


def nearest(x: np.ndarray, y: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: Axes) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (of equally near ones the smaller number), its squared distance, and how many distances were computed."""
    cy, crest = axes.rotated(centroids.astype(np.float64))
    low = ((y[:, None, :] - cy[None]) ** 2).sum(axis=2) + (rest[:, None] - crest[None]) ** 2
    # the rest norm of a vector that lies in the leading axes is off by the root of a rounding error, so the margin is generous
    size = max(float(np.max(np.abs(x - axes.mean), initial=1)), float(np.max(np.abs(centroids - axes.mean), initial=1)))
    low -= 1e-9 * low + 1e-6 * x.shape[1] * size * size
    first, rows = low.argmin(axis=1), np.arange(len(x))
    best = np.full(len(x), np.iinfo(np.int64).max)
    which, looked = np.full(len(x), len(centroids)), 0
    for step in range(2):  # the likeliest centroid of each row, then the rest
        for c in range(len(centroids)):
            at = rows[first == c] if step == 0 else rows[(first != c) & (low[:, c] <= best)]
            if len(at):
                d = x[at] - centroids[c]
                d = np.einsum("ij,ij->i", d, d)
                looked += len(at)
                better = (d < best[at]) | ((d == best[at]) & (c < which[at]))
                best[at[better]], which[at[better]] = d[better], c
    return which, best, looked


def _assigned(table: DataFrame, centroids: np.ndarray, axes: Axes, sums: bool) -> DataFrame:
    """Sums of the components by cluster (at = cluster * width + component, exact), or vec_id, cluster and distance of each row."""
    width, lead = axes.lead.shape

    def near(batches: Iterator[pa.RecordBatch]):
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(i, BLOCK)
                x = _matrix(batch, "x", width, np.int64)
                yield batch, x, *nearest(x, _matrix(batch, "lead", lead, np.float64), np.asarray(batch.column("rest")), centroids, axes)[:2]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, which, distance in near(batches):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros((len(centroids), width), dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for _, x, which, _ in near(batches):
            for c in range(len(centroids)):
                s[c] += x[which == c].sum(axis=0)
            n += np.bincount(which, minlength=len(centroids))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(s.size)), pa.array(s.ravel()), pa.array(np.repeat(n, width))], names=["at", "s", "n"])

    if not sums:
        return table.mapInArrow(rows, "vec_id long, cluster int, distance long")
    return table.select("x", "lead", "rest").mapInArrow(totals, "at long, s long, n long").select("at", F.col("s").cast("decimal(38,0)").alias("s"), "n")


def moved(table: DataFrame, centroids: np.ndarray, axes: Axes) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means; empty ones stay."""
    out, width = centroids.copy(), centroids.shape[1]
    for r in _summed(_assigned(table, centroids, axes, sums=True)):
        if r["n"]:
            out[r["at"] // width, r["at"] % width] = int(r["s"]) // int(r["n"])
    return out


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, share: float = SHARE, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    ints = whole(vectors, width)
    centroids = starts(ints, k, seed)
    if not len(centroids):
        return ints.select(
            "vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")
        ).filter(F.lit(False))
    axes = principal_axes(ints, width, share)
    table = settle(stored(ints, axes), "rotated")
    for _ in range(rounds):
        centroids = moved(table, centroids, axes)
    rows = settle(_assigned(table, centroids, axes, sums=False), "assigned")
    inertia = {r["at"]: int(r["s"]) for r in _summed(rows.select(F.col("cluster").alias("at"), F.col("distance").cast("decimal(38,0)").alias("s"), F.lit(1).alias("n")))}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = rows.sparkSession.createDataFrame([(c, inertia.get(c, 0), digests[c]) for c in range(len(centroids))], "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(sum(inertia.values())).cast("long").alias("inertia")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total, "centroid_sha256")


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 1) -> str:
    """The same in SQL, all distances in full, one step of CTEs for each round."""
    near = """(SELECT vec_id, x, c, dist FROM (SELECT vec_id, x, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS dist,
               row_number() OVER (PARTITION BY vec_id ORDER BY dist, c) AS rn FROM v, {0}) WHERE rn = 1)"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS {near.format(f'c{i}')}")
        steps.append(f"""e{i} AS (SELECT c, j, sum(x[j])::HUGEINT AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {width + 1})) AS j) GROUP BY c, j)""")
        steps.append(f"""g{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS m FROM e{i} GROUP BY c)""")
        steps.append(f"c{i + 1} AS (SELECT c, coalesce(g{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN g{i} USING (c))")
    return f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS c, x AS m FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k})),
        {', '.join(steps)},
        f AS {near.format(f'c{rounds}')},
        i AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM f GROUP BY c)
        SELECT vec_id, c AS cluster, dist AS distance, cluster_inertia, (SELECT sum(dist)::BIGINT FROM f) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM f JOIN i USING (c) JOIN c{rounds} USING (c)"""

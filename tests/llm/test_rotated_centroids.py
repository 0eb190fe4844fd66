"""Centroids against all distances in Python, and their SQL on messy rows."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from tidewell.llm import rotated_centroids
from tidewell.llm.common import read

FIELDS = "vec_id long, embedding array<float>"


def brute(rows, k=16, rounds=3, width=64):
    kept = [(i, [math.floor(64 * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == width and all(v is not None and math.isfinite(v) for v in x)]
    centroids = [x for _, x in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)[:k]]
    x = np.array([x for _, x in kept], dtype=np.int64)
    for n in range(rounds + 1):
        d = ((x[:, None] - np.array(centroids)[None]) ** 2).sum(axis=-1)
        which, least = d.argmin(axis=1), d.min(axis=1)
        for c in range(len(centroids)):
            own = x[which == c]
            if n < rounds and len(own):
                centroids[c] = [int(s) // len(own) for s in own.sum(axis=0)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, int(c), int(e), int(least[which == c].sum()), int(least.sum()), sha[c]) for (i, _), c, e in zip(kept, which, least, strict=True)), key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def messy(spark):
    rnd, rows = random.Random(2), []
    for i in range(300):
        x = [float(np.float32(rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 100), 0.0]))) for _ in range(64)]
        bad = rnd.choice([x[:63], x[:5] + [None] + x[6:], x[:5] + [math.nan] + x[6:], [math.inf] + x[1:], None])
        rows.append((rnd.choice([i, i, 7, None]), rnd.choice([x, x, x, [0.5] * 64, bad])))
    return spark.createDataFrame([(*r, 3, "x") for r in rows], FIELDS + ", cluster int, x string"), rows


def test_clusters_equal_brute_force(spark, sf_dir, messy):
    df = read(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings")
    assert plain(rotated_centroids.clusters(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])
    df, rows = messy
    assert plain(rotated_centroids.clusters(df)) == brute(rows)


def test_few_equal_and_no_vectors(spark, messy):
    few = [(i, [float(i % 2)] * 64) for i in range(9)]
    assert plain(rotated_centroids.clusters(spark.createDataFrame(few, FIELDS))) == brute(few)
    none = rotated_centroids.clusters(messy[0].filter("vec_id < 0"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_rule_out_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (16, 3)) @ rng.normal(0, 1, (3, 64))
    x = np.floor(centres[rng.integers(0, 16, 4000)] + rng.normal(0, 3, (4000, 64))).astype(np.int64)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = rotated_centroids.Axes(x.mean(axis=0), axes[:, ::-1][:, :4])
    c = x[:16]
    which, best, looked = rotated_centroids.nearest(x, *axes.rotated(x.astype(float)), c, axes)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=-1)
    assert (which == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all() and looked < 0.3 * d.size


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        rotated_centroids.clusters(spark.createDataFrame([(1, [3e6] * 64)], FIELDS)).count()


def test_sql_says_the_same(spark, messy):
    rows = [r for r in messy[1] if r[0] is not None]
    seen = set()
    rows = [r for r in rows if r[0] not in seen and not seen.add(r[0])]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        db.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
        assert sorted(db.sql(rotated_centroids.oracle()).fetchall(), key=str) == brute(rows)

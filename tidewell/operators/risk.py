"""Cox models of any number of features, penalties and folds, all fitted by the same few passes over the rows.

A `RiskTable` holds rows as (number of the time, event, fold, features), in blocks: a row of it has up to BLOCK of them, each column as the bytes of an
array, so a pass costs array operations and not rows. A pass evaluates all fits at once: first the sums of exp(score) by time, from which the driver
gets each fit's cumulative hazard; then, with that hazard, the gradient and a curvature matrix of the number of features. Neither needs sums of products
at each time, so hundreds of features are fine, and folds and penalties cost columns, not jobs. Boosting takes both from one pass where times and features
are few.

The driver holds TIMES numbers for each fit; a table with more distinct times takes them at TIMES quantiles, which makes ties of neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.ordered import settle

TIME, EVENT = "OS_YEARS", "OS_STATUS"
#: Rows of a task at least.
TASK = 10_000
#: Distinct times at most; numbers in a row of partial sums; numbers that tasks may send to the driver as they are; numbers of curvature in a pass.
TIMES, PIECE, DIRECT, CURVATURE = 65_536, 4096, 4_000_000, 4_000_000
#: Rows of a block and numbers of its features at most; features and sums of a task at most that are added up by time.
BLOCK, WIDE, FEW, BY_TIME = 32_768, 1_000_000, 32, 500_000
#: What the bytes of a block's columns are.
KINDS = {"t": np.int32, "e": np.int32, "fold": np.int32, "key": np.int64, "x": np.float64}


def added_up(table: DataFrame, length: int, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of a vector that each makes of its batches; large ones are added up by pieces before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = partial(batches)
        pieces = [(i, v[i : i + PIECE].tobytes()) for i in range(0, length, PIECE) if v[i : i + PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int64()), pa.array([b for _, b in pieces], pa.binary())], names=["at", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column("at").to_pylist(), batch.column("v").to_pylist(), strict=True):
                total[i] = total.get(i, 0.0) + np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["at", "v"])

    kind = "at long, v binary"
    parts = table.mapInArrow(run, kind)
    if length * partitions(table) > DIRECT:
        parts = parts.repartition("at").mapInArrow(merge, kind)
    out = np.zeros(length)
    for r in sorted(parts.collect(), key=lambda r: (r["at"], bytes(r["v"]))):  # in one order, whichever task ends first
        piece = np.frombuffer(r["v"])
        out[r["at"] : r["at"] + len(piece)] += piece
    return out


def partitions(table: DataFrame) -> int:
    """Partitions of a table, asked once."""
    if not hasattr(table, "_tw_partitions"):
        table._tw_partitions = table.rdd.getNumPartitions()
    return table._tw_partitions


def matrix(batch: pa.RecordBatch, name: str = "x", kind=np.float64) -> np.ndarray:
    c = batch.column(name)
    return np.asarray(c.flatten(), dtype=kind).reshape(len(c), -1) if len(c) else np.zeros((0, 0), dtype=kind)


def few_tasks(table: DataFrame, n: int) -> DataFrame:
    """No more partitions than a row count deserves, since each pass starts a task for each."""
    return table.coalesce(max(1, n // TASK))


def packed(arrays: dict[str, np.ndarray], kinds: dict = KINDS) -> pa.RecordBatch:
    """One row with arrays as bytes."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, dtype=kinds.get(c, np.float64)).tobytes()], pa.binary()) for c, a in arrays.items()], names=list(arrays))


def blocks(batches: Iterator[pa.RecordBatch], p: int, kinds: dict = KINDS) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each block; x by rows."""
    for b in batches:
        for i in range(b.num_rows):
            block = {c: np.frombuffer(b.column(c)[i].as_buffer(), kinds.get(c, np.float64)) for c in b.schema.names}
            yield block | ({"x": block["x"].reshape(len(block["t"]), p)} if "x" in block else {})


def in_blocks(parts: Iterator[dict[str, np.ndarray]], size: int, kinds: dict = KINDS) -> Iterator[pa.RecordBatch]:
    """Arrays of rows put together to blocks of about `size` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part["t"])
        if n >= size:
            yield packed({c: np.concatenate([h[c] for h in held]) for c in part}, kinds)
            held, n = [], 0
    if n:
        yield packed({c: np.concatenate([h[c] for h in held]) for c in held[0]}, kinds)


@dataclass(frozen=True)
class RiskTable:
    """rows: blocks of t (number of the time), e (event), fold, key (a hash of the row's key), x (standardised features)."""

    rows: DataFrame
    features: list[str]
    times: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    fold_mean: dict[int, np.ndarray]
    fold_sd: dict[int, np.ndarray]
    n: dict[int, int]


def time_numbers(df: DataFrame, time: str = TIME) -> np.ndarray:
    """The distinct times in order, or TIMES of their quantiles."""
    distinct = df.select(time).filter(F.col(time).isNotNull()).distinct()
    if distinct.count() <= TIMES:
        return np.array(sorted(r[0] for r in distinct.collect()), dtype=np.float64)
    cuts = df.agg(F.percentile_approx(time, F.from_json(F.lit(str([i / TIMES for i in range(1, TIMES + 1)])), "array<double>"), F.lit(4 * TIMES))).first()[0]
    return np.unique(np.array(cuts, dtype=np.float64))


def risk_table(df: DataFrame, features: list[str], fold: Column | None = None, key: str | None = None) -> RiskTable:
    """The table of some rows; a fit for fold f learns from the rows of the other folds, one for fold -1 from all. Rows without time or event, or with
    a gap in a feature, are an error of the caller and raise."""
    fold = F.lit(-2) if fold is None else fold
    rows = df.select(F.col(TIME).cast("double").alias(TIME), F.col(EVENT).cast("int").alias("e"), fold.cast("int").alias("fold"), F.xxhash64(*([key] if key else features)).alias("key"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)])
    p, names = len(features), [f"_{i}" for i in range(len(features))]
    gaps = F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in [*names, TIME, "e"]]))
    facts = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), gaps.alias("gaps"), *[F.sum(c).alias(f"s{c}") for c in names], *[F.sum(F.col(c) * F.col(c)).alias(f"q{c}") for c in names]).collect()
    if any(r["gaps"] for r in facts):
        raise ValueError("rows with gaps in time, event or features: impute or drop them first")
    sums = {r["fold"]: (r["n"], np.array([r[f"s{c}"] for c in names]), np.array([r[f"q{c}"] for c in names])) for r in facts}

    def moments(left_out: int) -> tuple[int, np.ndarray, np.ndarray]:
        kept = [v for f, v in sums.items() if f != left_out] or [(0, np.zeros(p), np.zeros(p))]
        n, s, q = (sum(v[i] for v in kept) for i in range(3))
        m = s / max(n, 1)
        sd = np.sqrt(np.maximum(q / max(n, 1) - m * m, 0))
        return n, m, np.where(sd > 1e-12 * np.maximum(np.abs(m), 1), sd, 1.0)

    of = {f: moments(f) for f in {*sums, -1}}
    times, (_, mean, sd) = time_numbers(df), of[-1]
    scaled = F.array(*[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(names, mean, sd, strict=True)]) if p else F.array().cast("array<double>")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            t = np.minimum(np.searchsorted(times, np.asarray(b.column("time"))), max(len(times) - 1, 0))
            yield {"t": t, **{c: np.asarray(b.column(c)) for c in ("e", "fold", "key")}, "x": matrix(b)}

    size = max(1, min(BLOCK, WIDE // max(p, 1)))
    table = few_tasks(rows.select(F.col(TIME).alias("time"), "e", "fold", "key", scaled.alias("x")), of[-1][0])
    table = table.mapInArrow(lambda batches: in_blocks(numbered(batches), size), ", ".join(f"{c} binary" for c in KINDS))
    return RiskTable(settle(table), features, times, mean, sd, {f: v[1] for f, v in of.items()}, {f: v[2] for f, v in of.items()}, {f: v[0] for f, v in of.items()})


@dataclass(frozen=True)
class Fit:
    """One fit: the fold that it leaves out (-1: none), and its penalties on standardised coefficients, added to the negative log likelihood."""

    fold: int = -1
    lasso: float = 0.0
    ridge: float = 0.0


@dataclass(frozen=True)
class Fitted:
    """beta: coefficients of the features as given; off: largest violation of the optimality conditions for each row fitted; loss: penalised."""

    fit: Fit
    beta: np.ndarray
    center: np.ndarray
    off: float
    loss: float
    steps: int


def event_counts(table: RiskTable, folds: np.ndarray) -> np.ndarray:
    """Events by (time, fit)."""
    k, m = len(table.times), len(folds)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, m))
        for b in blocks(batches, 0):
            used = b["e"][:, None] * (b["fold"][:, None] != folds[None])
            for f in range(m):
                out[:, f] += np.bincount(b["t"], used[:, f], k)
        return out.ravel()

    return added_up(table.rows.select("t", "e", "fold"), k * m, partial).reshape(k, m)


def at_risk(table: RiskTable, beta: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fit (a row of beta): sums of exp(score) over the risk set of each time, and the sum of scores over events."""
    (m, p), k = beta.shape, len(table.times)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        s0, eta = np.zeros((k, m)), np.zeros(m)
        for b in blocks(batches, p):
            score = b["x"] @ beta.T
            used = b["fold"][:, None] != folds[None]
            eta += (b["e"][:, None] * used * score).sum(axis=0)
            w = np.exp(np.minimum(score, 50.0)) * used
            for f in range(m):
                s0[:, f] += np.bincount(b["t"], w[:, f], k)
        return np.concatenate([s0.ravel(), eta])

    v = added_up(table.rows, k * m + m, partial)
    return v[: k * m].reshape(k, m)[::-1].cumsum(axis=0)[::-1], v[k * m :]


def slopes(table: RiskTable, beta: np.ndarray, folds: np.ndarray, hazard: np.ndarray, curved: bool, share: float = 1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Gradients of the log likelihood by fit, and the curvature X' diag(exp(score) * hazard) X, which bounds the negative Hessian. With a share, only
    rows whose hash draws below it count."""
    m, p = beta.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        g, a = np.zeros((m, p)), np.zeros((m, p, p) if curved else 0)
        for b in blocks(batches, p):
            x, used = b["x"], b["fold"][:, None] != folds[None]
            if share < 1:
                used = used & drawn(b["key"], seed, share)[:, None]
            h = np.exp(np.minimum(x @ beta.T, 50.0)) * hazard[b["t"]] * used
            g += (b["e"][:, None] * used - h).T @ x
            for f in range(m if curved else 0):
                a[f] += x.T @ (x * h[:, f : f + 1])
        return np.concatenate([g.ravel(), a.ravel()])

    v = added_up(table.rows, m * p + (m * p * p if curved else 0), partial)
    return v[: m * p].reshape(m, p), v[m * p :].reshape(m, p, p) if curved else None


def slopes_at_once(table: RiskTable, beta: np.ndarray, folds: np.ndarray, events: np.ndarray, share: float, seed: int) -> np.ndarray:
    """The gradients of `slopes` with the hazard at beta itself, from one pass that adds up exp(score) and its products with the features by time."""
    (m, p), k = beta.shape, len(table.times)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        s0, s1, g = np.zeros((m, k)), np.zeros((m, p, k)), np.zeros((m, p))
        for b in blocks(batches, p):
            columns, used = np.ascontiguousarray(b["x"].T), b["fold"] != folds[:, None]
            w = np.exp(np.minimum(beta @ columns, 50.0)) * used
            if share < 1:
                used = used & drawn(b["key"], seed, share)
            g += (b["e"] * used) @ b["x"]
            for f in range(m):
                s0[f] += np.bincount(b["t"], w[f], k)
                own = w[f] * used[f]
                for j in range(p):
                    s1[f, j] += np.bincount(b["t"], own * columns[j], k)
        return np.concatenate([s0.ravel(), s1.ravel(), g.ravel()])

    v = added_up(table.rows, m * (k + p * k + p), partial)
    s0, s1, g = np.split(v, [m * k, m * k * (1 + p)])
    hazard = hazards(events, s0.reshape(m, k).T[::-1].cumsum(axis=0)[::-1])
    return g.reshape(m, p) - np.einsum("fjk,kf->fj", s1.reshape(m, p, k), hazard)


def drawn(keys: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each key's draw, a mix of the key and the seed, lies below the share."""
    return uniform(keys, seed) < share


def uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A value in [0, 1) for each key (SplitMix64 of the key and the seed)."""
    with np.errstate(over="ignore"):
        z = keys.view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def hazards(events: np.ndarray, risk: np.ndarray) -> np.ndarray:
    """Cumulative hazard up to and including each time (Breslow's estimate)."""
    return np.divide(events, risk, out=np.zeros_like(risk), where=risk > 0).cumsum(axis=0)


def _least_quadratic(beta: np.ndarray, g: np.ndarray, a: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic bound at beta plus both penalties, by coordinate descent over the coefficients that move."""
    new, slope = beta.copy(), g.copy()  # slope: gradient of the likelihood's bound at `new`
    diagonal = np.maximum(np.diag(a), 1e-12)
    active, every = np.arange(len(beta)), np.arange(len(beta))
    for sweep in range(2000):
        moved = 0.0
        for j in active if sweep % 10 else every:
            u = slope[j] + diagonal[j] * new[j]
            to = np.sign(u) * max(abs(u) - lasso[j], 0.0) / (diagonal[j] + ridge[j])
            if (step := to - new[j]) != 0:
                slope -= a[:, j] * step
                new[j] = to
                moved = max(moved, abs(step) * np.sqrt(diagonal[j]))
        active = np.flatnonzero(new)
        if moved < 1e-9 and sweep % 10 == 0:
            break
        if moved < 1e-9:
            active = every
    return new


def _violation(beta: np.ndarray, g: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    pull = g - ridge * beta
    return np.where(beta != 0, np.abs(pull - lasso * np.sign(beta)), np.maximum(np.abs(pull) - lasso, 0.0)).max(axis=1, initial=0.0)


def fit_all(table: RiskTable, fits: list[Fit], tolerance: float = 1e-7, rounds: int = 200) -> list[Fitted]:
    """Every fit to the tolerance (of the optimality conditions, for each row that it learns from), two jobs a round for all that aren't done yet.
    A fit that doesn't get there in `rounds` raises."""
    p, size = len(table.features), max(1, CURVATURE // max(len(table.features) ** 2, len(table.times)))
    if len(fits) > size:
        return [x for i in range(0, len(fits), size) for x in fit_all(table, fits[i : i + size], tolerance, rounds)]
    folds, n = np.array([f.fold for f in fits]), np.array([max(table.n[f.fold], 1) for f in fits], dtype=float)
    own = np.array([table.fold_sd[f.fold] / table.sd for f in fits]).reshape(len(fits), p)
    lasso, ridge = np.array([f.lasso for f in fits])[:, None] * own, np.array([f.ridge for f in fits])[:, None] * own**2
    events = event_counts(table, folds)
    beta, last, best = np.zeros((len(fits), p)), np.zeros((len(fits), p)), np.full(len(fits), np.inf)
    off, steps, open_ = np.full(len(fits), np.inf), np.zeros(len(fits), dtype=int), np.arange(len(fits))
    for _ in range(rounds):
        risk, eta = at_risk(table, beta[open_], folds[open_])
        d = events[:, open_]
        cost = (d * np.log(np.where(risk > 0, risk, 1.0))).sum(axis=0) - eta
        cost += (lasso[open_] * np.abs(beta[open_]) + ridge[open_] * beta[open_] ** 2 / 2).sum(axis=1)
        worse = cost > best[open_] + 1e-9 * n[open_]
        beta[open_[worse]] = (beta[open_[worse]] + last[open_[worse]]) / 2
        steps[open_] += 1
        go = open_[~worse]
        if not len(go):
            continue
        best[go] = cost[~worse]
        g, a = slopes(table, beta[go], folds[go], hazards(d[:, ~worse], risk[:, ~worse]), True)
        off[go] = _violation(beta[go], g, lasso[go], ridge[go]) / n[go]
        for i, f in enumerate(go):
            if off[f] > tolerance:
                last[f], beta[f] = beta[f], _least_quadratic(beta[f], g[i], a[i], lasso[f], ridge[f])
        open_ = open_[off[open_] > tolerance]
        if not len(open_):
            return [Fitted(x, beta[i] / table.sd, table.fold_mean[x.fold], off[i], best[i], int(steps[i])) for i, x in enumerate(fits)]
    raise ArithmeticError(f"{len(open_)} of {len(fits)} fits are off by up to {off[open_].max():.1g} after {rounds} rounds")


def penalty_path(table: RiskTable, mixing: float, steps: int, least: float, fold: int = -1) -> list[Fit]:
    """Fits by falling penalty, from the smallest one at which all coefficients are zero down to `least` of it; penalties count for each row."""
    folds = np.array([fold])
    zero = np.zeros((1, len(table.features)))
    risk, _ = at_risk(table, zero, folds)
    g, _ = slopes(table, zero, folds, hazards(event_counts(table, folds), risk), False)
    n = max(table.n[fold], 1)
    top = float(np.abs(g[0] / (table.fold_sd[fold] / table.sd)).max()) / n / max(mixing, 1e-3)
    return [Fit(fold, lam * n * mixing, lam * n * (1 - mixing)) for lam in np.geomspace(top, top * least, steps)]


def boosted_lines(table: RiskTable, fits: list[Fit], rounds: int, rate: float, share: float = 1.0, seed: int = 42) -> list[Fitted]:
    """Componentwise boosting for each fold: a round moves the coefficient that explains the residuals of the drawn rows best."""
    folds, p = np.array([f.fold for f in fits]), len(table.features)
    table, beta = replace(table, rows=table.rows.persist()), np.zeros((len(fits), p))  # each round reads all of it; blocks in memory are read twice as fast

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((len(folds), p))
        for b in blocks(batches, p):
            out += (b["fold"][:, None] != folds[None]).T.astype(float) @ (b["x"] ** 2)
        return out.ravel()

    at_once = p <= FEW and len(fits) * len(table.times) * (1 + p) <= BY_TIME
    try:
        events = event_counts(table, folds)
        squares = share * added_up(table.rows.select("t", "fold", "x"), len(fits) * p, partial).reshape(len(fits), p)
        for r in range(rounds):
            if at_once:
                g = slopes_at_once(table, beta, folds, events, share, seed + r)
            else:
                risk, _ = at_risk(table, beta, folds)
                g, _ = slopes(table, beta, folds, hazards(events, risk), False, share, seed + r)
            slope = np.divide(g, squares, out=np.zeros_like(g), where=squares > 0)
            best = np.argmax(g * slope, axis=1)
            beta[np.arange(len(fits)), best] += rate * slope[np.arange(len(fits)), best]
    finally:
        table.rows.unpersist()
    return [Fitted(replace(x), beta[i] / table.sd, table.fold_mean[x.fold], np.nan, np.nan, rounds) for i, x in enumerate(fits)]

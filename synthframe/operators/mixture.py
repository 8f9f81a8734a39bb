"""Gaussian mixtures per column and over all columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.functions import special
from synthframe.functions.blocks import packed, unpacked
from synthframe.functions.frames import long_form, spread
from synthframe.operators.marginals import MIXTURE, Marginal
from synthframe.session import written

VARIANCE_FLOOR = 1e-6
MAX_COMPONENTS = 19
FIT_SCHEMA = ("column string, k int, component int, weight double, mean double, sd double, "
              "log_likelihood double, n bigint, bic double")


#: Exact EM over all values stops when the mean log likelihood changes by less (a fixed value), or after so many scans.
EXACT_TOLERANCE = 1e-3
EXACT_SCANS = 25
START_BINS = 2048


def column_histograms(df: DataFrame, columns: Sequence[str], bins: int = START_BINS) -> DataFrame:
    """(column, bin, n, value, var): at most `bins` weighted points per column.

    Bins are cut at quantiles, so a heavy tail keeps its share of points; mean and
    variance inside each bin are exact.  The search for a start of the mixture fit then
    costs the same however long the table is.
    """
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    steps = [i / bins for i in range(1, bins)]
    row = cast.agg(*[F.percentile_approx(c, steps, 4 * bins).alias(c) for c in columns]).first()
    cuts = [[-math.inf, *sorted(set(row[c] or [])), math.inf] for c in columns]
    names = [f"__bin{i}" for i in range(len(columns))]
    binned = Bucketizer(splitsArray=cuts, inputCols=list(columns), outputCols=names,
                        handleInvalid="keep").transform(cast)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(b).cast("int").alias("bin"),
                                         F.col(c).alias("value")) for c, b in zip(columns, names)]))
    return (binned.select(cells.alias("cell")).select("cell.*")
            .filter(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy("column", "bin").agg(F.count("*").alias("n"), F.avg("value").alias("m"),
                                          F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("var"))
            .withColumnRenamed("m", "value"))


def em_weighted(x: np.ndarray, n: np.ndarray, inner: np.ndarray, k: int, max_iter: int = 100,
                tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """EM for a 1-D mixture on weighted bin means with inner variances."""
    order = np.argsort(x)
    x, n, inner = x[order], n[order].astype(float), inner[order]
    total = n.sum()
    share = (np.cumsum(n) - n / 2) / total
    means = np.interp((np.arange(k) + 0.5) / k, share, x)
    for _ in range(20):  # weighted k-means start
        label = np.abs(x[:, None] - means[None, :]).argmin(axis=1)
        mass = np.bincount(label, n, k)
        moved = np.where(mass > 0, np.bincount(label, n * x, k) / np.maximum(mass, 1e-300), means)
        if np.allclose(moved, means):
            break
        means = moved
    r = np.eye(k)[label]
    last, ll = -np.inf, -np.inf
    for _ in range(max_iter):
        mass = (r * n[:, None]).sum(axis=0) + 1e-10
        means = (r * (n * x)[:, None]).sum(axis=0) / mass
        spread = (x[:, None] - means) ** 2 + inner[:, None]
        var = (r * n[:, None] * spread).sum(axis=0) / mass + VARIANCE_FLOOR
        log_p = np.log(mass / total) - 0.5 * np.log(2 * math.pi * var) - spread / (2 * var)
        top = log_p.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log_p - top).sum(axis=1))
        r = np.exp(log_p - norm[:, None])
        ll = float((n * norm).sum())
        if abs(ll - last) / total < tol:
            break
        last = ll
    weights = mass / mass.sum()
    return weights, means, np.sqrt(var), ll


def _fit_task(pdf: pd.DataFrame) -> pd.DataFrame:
    column, k = pdf["column"].iloc[0], int(pdf["k"].iloc[0])
    k = min(k, len(pdf))
    w, m, s, ll = em_weighted(pdf["value"].to_numpy(), pdf["n"].to_numpy(), pdf["var"].to_numpy(), k)
    n = int(pdf["n"].sum())
    bic = -2 * ll + (3 * k - 1) * math.log(n)
    order = np.argsort(m)
    return pd.DataFrame({"column": column, "k": int(pdf["k"].iloc[0]), "component": range(k),
                         "weight": w[order], "mean": m[order], "sd": s[order],
                         "log_likelihood": ll, "n": n, "bic": bic})


def mixture_starts(df: DataFrame, columns: Sequence[str], max_components: int = MAX_COMPONENTS,
                   bins: int = START_BINS, tasks: int | None = None) -> DataFrame:
    """Starts of the exact fit: EM over the bins of each column, one task per (column, k)."""
    hist = column_histograms(df, columns, bins)
    tasks = tasks or min(len(columns) * max_components, 4 * df.sparkSession.sparkContext.defaultParallelism)
    grid = hist.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_components))))
    return (grid.repartition(tasks, "column", "k").groupBy("column", "k")
            .applyInPandas(_fit_task, FIT_SCHEMA))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the distinct values of each column and their rows, counted before they move."""
    cells = long_form(df, columns).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"))


def _responsibilities(x: np.ndarray, w: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shares, distances to the means, log density) of values under a mixture, one line a component."""
    gap = x - mean[:, None]
    share = gap * gap
    share *= (-0.5 / var)[:, None]
    share += (np.log(w) - 0.5 * np.log(2 * math.pi * var))[:, None]
    top = share.max(axis=0)
    share -= top
    np.exp(share, out=share)
    whole = share.sum(axis=0)
    share /= whole
    return share, gap, top + np.log(whole)


def _expectation(counts: DataFrame, models: dict) -> dict:
    """Sums of one E-step of every model: mass, first and second moments about the means, log likelihood.

    `counts` holds blocks of values and their rows.  One scan serves all columns and
    sizes; a task sends one packed row per model.
    """
    def scan(batches):
        sums: dict = {}
        for column, (x, n) in unpacked(batches):
            for k, (w, mean, var) in models.get(column, {}).items():
                r, gap, density = _responsibilities(x, w, mean, var)
                r *= n
                first = r * gap
                packed_sums = np.concatenate([r.sum(1), first.sum(1), np.einsum("ij,ij->i", first, gap), [n @ density]])
                sums[column, k] = sums.get((column, k), 0.0) + packed_sums
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in sums]), pa.array([k for _, k in sums], pa.int32()),
                                              pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["column", "k", "sums"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"column": [key[0]], "k": [key[1]], "sums": [np.sum(np.stack(list(pdf["sums"])), axis=0)]})

    schema = "column string, k int, sums array<double>"
    rows = counts.mapInArrow(scan, schema).groupBy("column", "k").applyInPandas(add, schema).collect()
    return {(r["column"], r["k"]): np.array(r["sums"]) for r in rows}


def exact_mixtures(counts: DataFrame, starts: dict, totals: dict, tolerance: float = EXACT_TOLERANCE,
                   scans: int = EXACT_SCANS) -> dict:
    """EM over all values from `starts` {(column, k): (weights, means, variances)}.

    Returns {(column, k): (weights, means, variances, log likelihood)}; every scan
    advances all models that still move.  Values are packed into blocks once.
    """
    counts = spread(written(packed(counts, ["value", "n"], "column"), "mixture-values"))
    moving, last, done = dict(starts), {}, {}
    for scan in range(scans):
        models: dict = {}
        for (column, k), model in moving.items():
            models.setdefault(column, {})[k] = model
        for (column, k), sums in _expectation(counts, models).items():
            w, mean, var = moving[column, k]
            size, total, likelihood = len(w), totals[column], float(sums[-1])
            if abs(likelihood - last.get((column, k), -math.inf)) / total < tolerance or scan == scans - 1:
                done[column, k] = (w, mean, var, likelihood)
                del moving[column, k]
                continue
            last[column, k] = likelihood
            mass = sums[:size] + 1e-10
            step = sums[size:2 * size] / mass
            width = sums[2 * size:3 * size] / mass - step * step
            moving[column, k] = (mass / mass.sum(), mean + step, np.maximum(width, 0.0) + VARIANCE_FLOOR)
        if not moving:
            break
    return done


def mixture_candidates(df: DataFrame, columns: Sequence[str], max_components: int = MAX_COMPONENTS,
                       bins: int = START_BINS, tasks: int | None = None) -> DataFrame:
    """Every candidate mixture with its exact log likelihood and BIC.

    Bins only give the start; the fit itself runs over every distinct value and its count.
    """
    spark = df.sparkSession
    found = {}
    for r in mixture_starts(df, columns, max_components, bins, tasks).collect():
        found.setdefault((r["column"], r["k"]), []).append(r)
    starts = {key: tuple(np.array([r[c] for r in parts]) for c in ("weight", "mean", "sd")) for key, parts in found.items()}
    starts = {key: (np.maximum(w, 1e-300), m, s * s) for key, (w, m, s) in starts.items()}
    totals = {column: parts[0]["n"] for (column, _), parts in found.items()}
    rows = []
    if starts:
        for (column, k), (w, mean, var, likelihood) in exact_mixtures(value_counts(df, columns), starts, totals).items():
            n, size = totals[column], len(w)
            bic = -2 * likelihood + (3 * size - 1) * math.log(n)
            rows += [(column, k, i, float(w[j]), float(mean[j]), float(math.sqrt(var[j])), likelihood, n, bic)
                     for i, j in enumerate(np.argsort(mean, kind="stable"))]
    return spark.createDataFrame(rows, FIT_SCHEMA)


def best_mixtures(candidates: DataFrame) -> DataFrame:
    """Components of the candidate with the lowest BIC per column."""
    best = candidates.groupBy("column").agg(F.min_by("k", F.struct("bic", "k")).alias("k"))
    return candidates.join(F.broadcast(best), ["column", "k"])  # one row per column


def fit_mixtures(df: DataFrame, columns: Sequence[str], max_components: int = MAX_COMPONENTS,
                 bins: int = START_BINS) -> dict[str, Marginal]:
    """Mixture marginal per column, collected (at most 19 rows a column)."""
    from synthframe.operators.profile import column_ranges
    ranges = column_ranges(df, list(columns))
    rows = mixture_candidates(df, columns, max_components, bins).collect()
    fitted = {}
    for c in columns:
        own = [r for r in rows if r["column"] == c]
        lo, hi = ranges[c]
        if not own or lo == hi:
            fitted[c] = Marginal(c, "constant", lo or 0.0, hi or 0.0, mean=lo or 0.0)
            continue
        k = min(own, key=lambda r: (r["bic"], r["k"]))["k"]
        parts = sorted((r for r in own if r["k"] == k), key=lambda r: r["mean"])
        fitted[c] = Marginal(c, MIXTURE, lo, hi, weights=[r["weight"] for r in parts],
                             means=[r["mean"] for r in parts], sds=[r["sd"] for r in parts],
                             n=parts[0]["n"])
    return fitted


def mixture_rows(marginals: dict[str, Marginal]) -> list[tuple]:
    """(column, component, weight, mean, sd) rows of fitted mixtures."""
    return [(c, i, w, m, s) for c, f in marginals.items()
            for i, (w, m, s) in enumerate(zip(f.weights, f.means, f.sds))]


def mixture_pdf(x: Column, m: Marginal) -> Column:
    """Mixture density as a Column."""
    total = F.lit(0.0)
    for w, mean, sd in zip(m.weights, m.means, m.sds):
        z = (x - mean) / sd
        total = total + F.lit(w / (sd * math.sqrt(2 * math.pi))) * F.exp(-0.5 * z * z)
    return total


def mixture_cdf(x: Column, m: Marginal) -> Column:
    """Mixture distribution function as a Column."""
    total = F.lit(0.0)
    for w, mean, sd in zip(m.weights, m.means, m.sds):
        total = total + F.lit(w) * special.norm_cdf((x - mean) / sd)
    return F.when(x.isNotNull(), total)


# ------------------------------------------------------------- joint mixtures

@dataclass
class JointMixture:
    """Full-covariance mixture over several columns."""

    columns: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = 0.0
    n: int = 0

    @property
    def k(self) -> int:
        return len(self.weights)

    def bic(self) -> float:
        d = len(self.columns)
        free = self.k * (d + d * (d + 1) // 2) + self.k - 1
        return -2 * self.log_likelihood + free * math.log(max(self.n, 2))

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the whole mixture, in closed form."""
        mean = self.weights @ self.means
        second = sum(w * (s + np.outer(m, m))
                     for w, m, s in zip(self.weights, self.means, self.covariances))
        return mean, second - np.outer(mean, mean)


def log_densities(x: np.ndarray, model: JointMixture) -> np.ndarray:
    """log(weight * density) of every row under every component."""
    return densities_by_component(np.ascontiguousarray(x.T), model).T


def densities_by_component(columns: np.ndarray, model: JointMixture) -> np.ndarray:
    """As `log_densities`, one line a component: long lines add up much faster than short ones."""
    d, centre = len(columns), model.means.mean(axis=0)
    inverse = np.linalg.inv(np.linalg.cholesky(model.covariances))
    shift = np.einsum("jab,jb->aj", inverse, model.means - centre)
    level = np.log(np.maximum(model.weights, 1e-300)) + np.log(np.diagonal(inverse, axis1=1, axis2=2)).sum(axis=1) - 0.5 * d * math.log(2 * math.pi)
    centred, out = columns - centre[:, None], np.zeros((model.k, columns.shape[1]))
    for a in range(d):
        y = inverse[:, a] @ centred
        y -= shift[a][:, None]
        y *= y
        out += y
    out *= -0.5
    out += level[:, None]
    return out


#: Column with the number of equal rows that a row stands for; equal rows are merged where there are SAVING times as many rows as different ones.
ROWS, SAVING = "__rows", 4
STATISTICS = "model int, lane int, sums array<double>"
#: Executor cores that share one lane of the first merging level, and the most lanes there are.
CORES_PER_LANE, MOST_LANES = 16, 64


class Expectation:
    """One E-step folded over batches: sums of r, r*x and r*x*x' per component, and the log likelihood, packed per model."""

    def __init__(self, models: dict[int, JointMixture], columns: Sequence[str]):
        self.models, self.columns, self.totals = models, list(columns), {}

    def add(self, columns: np.ndarray, w: np.ndarray) -> None:
        """Finite rows, one line a column, and how many rows each stands for."""
        d, n = columns.shape
        powers = np.concatenate([np.ones((1, n)), columns, (columns[:, None] * columns[None]).reshape(d * d, n)]).T
        for key, model in self.models.items():
            r = densities_by_component(columns, model)
            top = r.max(axis=0)
            r -= top
            np.exp(r, out=r)
            total = r.sum(axis=0)
            r *= w / total
            self.totals[key] = self.totals.get(key, 0.0) + np.append((r @ powers).ravel(), w @ (top + np.log(total)))


def _merged(batches):
    """The packed sums of each model over a partition, added as they arrive: memory holds one row a model."""
    totals: dict = {}
    for pdf in batches:
        for key, lane, sums in zip(pdf["model"], pdf["lane"], pdf["sums"], strict=True):
            before = totals.get(key, (lane, 0.0))[1]
            totals[key] = (lane, before + np.asarray(sums, dtype=float))
    for key, (lane, sums) in totals.items():
        yield pd.DataFrame({"model": [key], "lane": [lane], "sums": [sums]})


def summed_statistics(rows: DataFrame, lanes: int, models: int) -> dict[int, np.ndarray]:
    """Packed sums per model, merged in levels: tasks into lanes, lanes into one row a model.

    However many tasks there were, the driver receives one row a model.
    """
    if lanes > 1:
        rows = rows.repartition(lanes, "lane").mapInPandas(_merged, STATISTICS)
    rows = rows.repartition(min(models, MOST_LANES), "model").mapInPandas(_merged, STATISTICS)
    return {r["model"]: np.array(r["sums"]) for r in rows.collect()}


def maximise(sums: dict[int, np.ndarray], active: dict[int, JointMixture], done: dict[int, JointMixture], tol: float) -> None:
    """M-step from merged statistics; converged models move from `active` to `done`."""
    for key, model in list(active.items()):
        d = len(model.columns)
        if key not in sums:
            done[key] = active.pop(key)
            continue
        stats, ll = sums[key][:-1].reshape(model.k, 1 + d + d * d), float(sums[key][-1])
        n = stats[:, 0].sum()
        mass = stats[:, 0] + 1e-10
        means = stats[:, 1:1 + d] / mass[:, None]
        second = stats[:, 1 + d:].reshape(model.k, d, d) / mass[:, None, None]
        cov = np.stack([positive_definite(s - np.outer(m, m) + VARIANCE_FLOOR * np.eye(d))
                        for s, m in zip(second, means)])
        active[key] = JointMixture(model.columns, mass / mass.sum(), means, cov, ll, int(round(n)))
        if model.n and abs(ll - model.log_likelihood) / n < tol:
            done[key] = active.pop(key)


def joint_em(df: DataFrame, starts: dict[int, JointMixture], max_iter: int = 50, tol: float = 1e-3,
             owner: dict[int, int] | None = None, cluster: str | None = None,
             lanes: int | None = None, weight: str | None = None) -> dict[int, JointMixture]:
    """K3, D3: EM from given starts; all models share one scan per iteration.

    Each task folds its rows into one packed row of sufficient statistics per model;
    these are merged in levels (`lanes` of tasks, then models), so the driver receives
    one row per model and iteration.  Columns with few values are scanned as their
    different rows and counts; `weight` names the counts of a table that holds them.  With `owner`, model `key` only sees the rows whose
    `cluster` is `owner[key]`.  Rows are packed into blocks once, which every iteration scans.
    """
    active, done = dict(starts), {}
    columns = next(iter(starts.values())).columns
    lanes = lanes or min(MOST_LANES, max(1, df.sparkSession.sparkContext.defaultParallelism // CORES_PER_LANE))
    keep = [F.col(cluster).cast("int").alias("__g")] if owner else []
    rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    sizes = (0, 1) if weight else rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*rows.columns))).first()
    if weight:
        rows = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns], F.col(weight).alias(ROWS))
    elif sizes[0] >= SAVING * max(sizes[1], 1):
        rows = spread(written(rows.groupBy(*rows.columns).agg(F.count("*").alias(ROWS)), "mixture-rows"))
    else:
        rows = rows.withColumn(ROWS, F.lit(1))
    blocks = packed(rows, [*columns, ROWS], "__g" if owner else None).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _advance(blocks, active, done, max_iter, tol, lanes, owner)
    finally:
        blocks.unpersist()
    done.update(active)
    return done


def _advance(blocks: DataFrame, active: dict, done: dict, max_iter: int, tol: float, lanes: int, owner: dict | None) -> None:
    """EM scans over packed rows until no model moves or `max_iter` is reached."""
    columns = next(iter(active.values())).columns
    for _ in range(max_iter):
        if not active:
            break
        groups: dict = {}
        for key, model in active.items():
            groups.setdefault(str(owner[key]) if owner else None, {})[key] = model

        def partial(batches, groups=groups):
            folds = {g: Expectation(models, columns) for g, models in groups.items()}
            for g, lines in unpacked(batches):
                if g in folds:
                    folds[g].add(lines[:-1], lines[-1])
            lane = TaskContext.get().partitionId() % lanes
            for fold in folds.values():
                for key, sums in fold.totals.items():
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([lane], pa.int32()),
                                                      pa.array([sums.tolist()], pa.list_(pa.float64()))], ["model", "lane", "sums"])

        maximise(summed_statistics(blocks.mapInArrow(partial, STATISTICS), lanes, len(active)), active, done, tol)


def positive_definite(cov: np.ndarray, floor: float = VARIANCE_FLOOR) -> np.ndarray:
    """V6: symmetric matrix with its eigenvalues lifted to a floor."""
    sym = (cov + cov.T) / 2
    values, vectors = np.linalg.eigh(sym)
    if values.min() >= floor:
        return sym
    return (vectors * np.maximum(values, floor)) @ vectors.T


def cholesky_factor(cov: np.ndarray) -> np.ndarray:
    """V6: lower factor of a d x d matrix, repaired by its eigenvalues where singular."""
    return np.linalg.cholesky(positive_definite(np.atleast_2d(np.asarray(cov, dtype=float))))

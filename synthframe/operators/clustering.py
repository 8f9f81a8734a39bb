"""KMeans, per-cluster models and the choice of k."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.frames import long_form, spread
from synthframe.functions.quantiles import exact_quantiles
from synthframe.functions.rng import hash_uniform
from synthframe.operators import dependence
from synthframe.operators.mixture import ROWS, SAVING, JointMixture, joint_em, positive_definite
from synthframe.session import written

FEATURES = "__features"
#: KMeans starts of joint mixtures run on the different rows and their counts from this length on, where that saves scanning.
MERGE_FROM = 1_000_000


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pack numeric columns into one vector column."""
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES).transform(df)


def fit_kmeans(features: DataFrame, k: int, seed: int = 0, max_iter: int = 20) -> KMeansModel:
    """KMeans on a view of `features`: of a persisted table itself it would decode every row again in each of its passes."""
    view = features.select(FEATURES, F.lit(1.0).alias(ROWS))
    return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=FEATURES, predictionCol="cluster").fit(view)


def kmeans_labels(df: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """K1, K2: rows with a `cluster` column, and the centroids."""
    features = assemble(df, columns)
    if k <= 1:
        return df.withColumn("cluster", F.lit(0)), np.zeros((1, len(columns)))
    held = spread(features.select(FEATURES)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_kmeans(held, k, seed)
    finally:
        held.unpersist()
    return model.transform(features).drop(FEATURES), np.array(model.clusterCenters())


def kmeans_path(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 0,
                visit: Callable | None = None) -> dict[int, object]:
    """Fit KMeans for several k over one persisted table; returns `visit(k, model, features)`."""
    features = spread(assemble(df, columns).select(FEATURES)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = {}
        for k in ks:
            model = fit_kmeans(features, k, seed)
            found[k] = visit(k, model, features) if visit else model.summary.trainingCost
        return found
    finally:
        features.unpersist()


def _largest_drop(costs: dict[int, float]) -> int:
    ks = sorted(costs)
    drops = [costs[a] - costs[b] for a, b in zip(ks, ks[1:])]
    return ks[int(np.argmax(drops))] if drops else ks[0]


def elbow_k(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 0
            ) -> tuple[int, dict[int, float]]:
    """K6: the k after which inertia falls most, and the inertia of every k."""
    costs = kmeans_path(df, columns, ks, seed)
    return _largest_drop(costs), costs


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette in squared Euclidean distance (linear in the rows)."""
    return ClusteringEvaluator(featuresCol=FEATURES, predictionCol="cluster").evaluate(labelled)


def silhouette_k(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 0
                 ) -> tuple[int, dict[int, float]]:
    """K7: the k with the best mean silhouette, and the score of every k."""
    scores = kmeans_path(df, columns, ks, seed, lambda k, m, f: silhouette(m.transform(f)))
    return max(scores, key=lambda k: (scores[k], -k)), scores


def cluster_spread(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Per cluster: size, centroid columns and mean Euclidean distance to it (`spread`)."""
    centres = df.groupBy(cluster).agg(*[F.avg(F.col(c).cast("double")).alias(f"centre_{c}") for c in columns])
    gap = sum(((F.col(c) - F.col(f"centre_{c}")) * (F.col(c) - F.col(f"centre_{c}")) for c in columns), F.lit(0.0))
    return (df.select(cluster, *columns).join(F.broadcast(centres), cluster)  # one row per cluster
            .groupBy(cluster, *[f"centre_{c}" for c in columns])
            .agg(F.count("*").alias("size"), F.avg(F.sqrt(gap)).alias("spread")))


def davies_bouldin(df: DataFrame, columns: Sequence[str], cluster: str) -> float:
    """K8: mean over clusters of the worst (spread_i + spread_j) / distance_ij.

    The rows are reduced to one per cluster in Spark; the driver compares those.
    """
    rows = [r for r in cluster_spread(df, columns, cluster).collect() if r[cluster] is not None]
    return _mean_worst_ratio(np.array([[r[f"centre_{c}"] for c in columns] for r in rows]), np.array([r["spread"] for r in rows]))


def _mean_worst_ratio(centre: np.ndarray, spread: np.ndarray) -> float:
    if len(spread) < 2:
        return 0.0
    apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(-1))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (spread[:, None] + spread[None]) / apart, 0.0)
    np.fill_diagonal(ratio, 0.0)
    return float(ratio.max(axis=1).mean())


def davies_bouldin_path(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 0) -> dict[int, float]:
    """K8 for KMeans labels of every k."""
    return kmeans_path(df, columns, ks, seed, lambda k, model, features: _model_davies_bouldin(model, features))


def _model_davies_bouldin(model: KMeansModel, features: DataFrame) -> float:
    labelled = model.transform(features).select("cluster", FEATURES)
    means = labelled.groupBy("cluster").agg(Summarizer.mean(F.col(FEATURES)).alias("centre"))
    own = F.zip_with(vector_to_array(FEATURES), vector_to_array("centre"), lambda x, y: (x - y) * (x - y))
    distance = F.sqrt(F.aggregate(own, F.lit(0.0), lambda total, x: total + x))
    rows = (labelled.join(F.broadcast(means), "cluster")  # one row per cluster
            .groupBy("cluster").agg(F.first("centre").alias("centre"), F.avg(distance).alias("spread")).collect())
    return _mean_worst_ratio(np.array([r["centre"].toArray() for r in rows]), np.array([r["spread"] for r in rows]))


def gap_statistic(df: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(1, 11), references: int = 3,
                  seed: int = 0) -> dict[int, float]:
    """K9: mean log inertia of uniform reference tables, as long as the data, minus that of the data."""
    from synthframe.operators.profile import column_ranges
    n = df.count()
    ranges = column_ranges(df, list(columns))
    log_w = lambda cost, size: math.log(max(cost / size, 1e-300))

    def costs(table: DataFrame) -> dict[int, float]:
        found = kmeans_path(table, columns, [k for k in ks if k > 1], seed)
        if 1 in ks:
            row = table.agg(*[(F.var_pop(c) * F.count(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
            found[1] = float(sum(row))
        return found

    expected = {k: 0.0 for k in ks}
    for b in range(references):
        table = df.sparkSession.range(n).select(
            *[(F.lit(ranges[c][0]) + F.lit(ranges[c][1] - ranges[c][0])
               * hash_uniform(F.col("id"), f"gap:{b}:{c}", seed)).alias(c) for c in columns])
        for k, cost in costs(table).items():
            expected[k] += log_w(cost, n) / references
    own = costs(df)
    return {k: expected[k] - log_w(own[k], n) for k in ks}


def eigen_gap_k(df: DataFrame, columns: Sequence[str], low: float = 25, high: float = 75
                ) -> tuple[int, np.ndarray, np.ndarray]:
    """K4: one more than the number of relative eigenvalue drops above the low percentile
    (a drop equal to the high percentile does not count); falls back to the largest drop.

    Returns k, the eigenvalues and the drops.
    """
    values = dependence.eigenvalues(dependence.covariance_matrix(df, columns))
    drops = dependence.relative_drops(values)
    if not len(drops):
        return 1, values, drops
    floor, ceiling = np.percentile(drops, [low, high])
    kept = int(((drops > floor) & (drops != ceiling)).sum())
    return (kept + 1 if kept else int(np.argmin(drops)) + 1), values, drops


def largest_drop_k(df: DataFrame, columns: Sequence[str]) -> int:
    """K5: position of the largest relative eigenvalue drop, plus two."""
    drops = dependence.relative_drops(dependence.eigenvalues(dependence.covariance_matrix(df, columns)))
    return int(np.argmin(drops)) + 2 if len(drops) else 1


METHOD_SCHEMA = "method string, k int, score double, chosen boolean"


def compare_cluster_counts(df: DataFrame, columns: Sequence[str], max_clusters: int = 10, seed: int = 0,
                           timings: dict[str, float] | None = None) -> DataFrame:
    """K10 (and K11 with `timings`): scores of all methods as (method, k, score, chosen)."""
    ks = range(2, max_clusters + 1)
    rows: list[tuple] = []

    def timed(name: str, work: Callable):
        start = time.perf_counter()
        value = work()
        if timings is not None:
            timings[name] = time.perf_counter() - start
        return value

    def add(name: str, scores: dict[int, float], chosen: int) -> None:
        rows.extend((name, int(k), float(v), k == chosen) for k, v in scores.items())

    if timings is None:  # one KMeans per k serves all three scores
        found = kmeans_path(df, columns, ks, seed, lambda k, m, f: (
            m.summary.trainingCost, silhouette(m.transform(f)), _model_davies_bouldin(m, f)))
        costs, widths, ratios = ({k: v[i] for k, v in found.items()} for i in range(3))
    else:
        costs = timed("elbow", lambda: elbow_k(df, columns, ks, seed))[1]
        widths = timed("silhouette", lambda: silhouette_k(df, columns, ks, seed))[1]
        ratios = timed("davies_bouldin", lambda: davies_bouldin_path(df, columns, ks, seed))
    add("elbow", costs, _largest_drop(costs))
    add("silhouette", widths, max(widths, key=lambda k: (widths[k], -k)))
    add("davies_bouldin", ratios, min(ratios, key=ratios.get))
    scores = timed("gap", lambda: gap_statistic(df, columns, range(1, max_clusters + 1), seed=seed))
    add("gap", scores, max(scores, key=scores.get))
    k, values, _ = timed("eigen_gap", lambda: eigen_gap_k(df, columns))
    add("eigen_gap", {i + 1: v for i, v in enumerate(values)}, k)
    k = timed("largest_drop", lambda: largest_drop_k(df, columns))
    add("largest_drop", {i + 1: v for i, v in enumerate(values)}, k)
    return df.sparkSession.createDataFrame(rows, METHOD_SCHEMA)


def time_cluster_counts(tables: dict[str, tuple[DataFrame, list[str]]], max_clusters: int = 5, seed: int = 0
                        ) -> DataFrame:
    """(table, method, seconds) of every method on every given table."""
    rows, spark = [], None
    for name, (df, columns) in tables.items():
        spark, spent = df.sparkSession, {}
        compare_cluster_counts(df, columns, max_clusters, seed, spent)
        rows += [(name, method, seconds) for method, seconds in spent.items()]
    return spark.createDataFrame(rows, "table string, method string, seconds double")


def cluster_summary(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """(cluster, column, n, mean, median, sd)."""
    cells = long_form(df, columns, keep=[cluster])
    moments = cells.groupBy(cluster, "column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                                   F.stddev_samp("value").alias("sd"))
    medians = exact_quantiles(cells, [cluster, "column"], {"median": 0.5})
    return (moments.join(F.broadcast(medians), [cluster, "column"])  # one row per cluster and column
            .select(cluster, "column", "n", "mean", "median", "sd"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n"))


# ------------------------------------------------- mixtures started from KMeans

def start_from_labels(labelled: DataFrame, columns: Sequence[str], k: int, cluster: str = "cluster") -> JointMixture:
    """Weights, means and covariances of labelled rows; tiny clusters borrow the pooled covariance."""
    columns = list(columns)
    d = len(columns)
    means = {r[cluster]: r for r in labelled.groupBy(cluster).agg(
        F.count("*").alias("__n"), *[F.avg(c).alias(c) for c in columns]).collect()}
    cov_rows = dependence.covariance(labelled, columns, cluster).collect()
    cov = {g: dependence.as_matrix([r for r in cov_rows if r[cluster] == g], columns) for g in means}
    n = sum(r["__n"] for r in means.values())
    pooled = sum(cov[g] * (means[g]["__n"] / n) for g in means)
    labels = [g for g in sorted(means) if means[g]["__n"] > 0][:k]
    return JointMixture(
        columns, np.array([means[g]["__n"] / n for g in labels]),
        np.array([[means[g][c] for c in columns] for g in labels], dtype=float),
        np.stack([positive_definite(cov[g] if means[g]["__n"] > d else pooled) for g in labels]))


def start_from_counts(counted: DataFrame, columns: Sequence[str], k: int, seed: int = 0) -> JointMixture:
    """The start of `start_from_labels` on KMeans clusters of k, from different rows and their counts (column ROWS)."""
    columns, d = list(columns), len(columns)
    features = assemble(counted, columns)
    if k > 1:
        model = KMeans(k=k, seed=seed, maxIter=20, featuresCol=FEATURES, predictionCol="cluster", weightCol=ROWS).fit(features)
        labelled, centres = model.transform(features), np.array(model.clusterCenters())
    else:
        row = counted.agg(*[(F.sum(F.col(c) * F.col(ROWS)) / F.sum(ROWS)).alias(c) for c in columns]).first()
        labelled, centres = features.withColumn("cluster", F.lit(0)), np.array([[row[c] for c in columns]])
    near = F.array(*[F.array(*[F.lit(float(v)) for v in line]) for line in centres])
    gaps = [F.col(c) - F.get(F.get(near, F.col("cluster")), F.lit(i)) for i, c in enumerate(columns)]
    parts = [F.sum(ROWS).alias("n"), *[F.sum(g * F.col(ROWS)).alias(f"s{i}") for i, g in enumerate(gaps)]]
    parts += [F.sum(gaps[i] * gaps[j] * F.col(ROWS)).alias(f"s{i}_{j}") for i in range(d) for j in range(d)]
    sums = labelled.groupBy("cluster").agg(*parts).orderBy("cluster").collect()
    sizes = np.array([float(r["n"]) for r in sums])
    first = np.array([[r[f"s{i}"] for i in range(d)] for r in sums]) / sizes[:, None]
    second = np.array([[[r[f"s{i}_{j}"] for j in range(d)] for i in range(d)] for r in sums])
    cov = (second - sizes[:, None, None] * first[:, :, None] * first[:, None, :]) / np.maximum(sizes - 1, 1)[:, None, None]
    pooled = np.einsum("g,gij->ij", sizes / sizes.sum(), cov)
    return JointMixture(columns, sizes / sizes.sum(), centres[[r["cluster"] for r in sums]] + first,
                        np.stack([positive_definite(c if n > d else pooled) for c, n in zip(cov, sizes, strict=True)]))


def mixtures_from_kmeans(df: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 0,
                         max_iter: int = 50) -> dict[int, JointMixture]:
    """K3, D3: joint mixtures for several k, each started from its KMeans clusters."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sizes = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    merged = sizes[0] >= max(MERGE_FROM, SAVING * sizes[1])
    if merged:
        rows = written(rows.groupBy(*columns).agg(F.count("*").alias(ROWS)), "mixture-rows")
    held = spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        starts = {}
        for k in ks:
            if merged:
                starts[k] = start_from_counts(held, columns, k, seed)
                continue
            labelled, _ = kmeans_labels(held, columns, k, seed)
            starts[k] = start_from_labels(labelled, columns, k)
        return joint_em(held, starts, max_iter, weight=ROWS if merged else None)
    finally:
        held.unpersist()


def best_joint_mixture(df: DataFrame, columns: Sequence[str], max_components: int = 19, seed: int = 0,
                       max_iter: int = 50) -> JointMixture:
    """D3: number of components by lowest BIC."""
    fitted = mixtures_from_kmeans(df, columns, range(1, max_components + 1), seed, max_iter)
    return min(fitted.values(), key=lambda m: (m.bic(), m.k))


def cluster_mixtures(labelled: DataFrame, columns: Sequence[str], cluster: str = "cluster", max_components: int = 3,
                     by_bic: bool = False, max_iter: int = 30) -> dict[int, JointMixture]:
    """One joint mixture inside every cluster.

    All clusters and candidate sizes advance in the same scans: a row is scored only
    by the models of its own cluster.  Starts are spread along each cluster's main
    axis.  Clusters with one row (or no variance) keep a single tight component.
    With `by_bic` the size is chosen by BIC, otherwise the largest one is used.
    """
    columns = list(columns)
    base = start_from_labels(labelled, columns, 10 ** 6, cluster)
    sizes = {r[cluster]: r["n"] for r in cluster_sizes(labelled, cluster).collect()}
    labels = sorted(sizes)
    starts, owner = {}, {}
    for at, g in enumerate(labels):
        mean, cov = base.means[at], base.covariances[at]
        values, vectors = np.linalg.eigh(cov)
        axis = vectors[:, -1] * math.sqrt(max(values[-1], 0.0))
        top = min(max_components, sizes[g])
        for k in range(1, top + 1) if by_bic else [top]:
            offsets = np.linspace(-1, 1, k) if k > 1 else np.zeros(1)
            key = len(starts)
            owner[key] = g
            starts[key] = JointMixture(columns, np.full(k, 1 / k), mean + offsets[:, None] * axis,
                                       np.stack([cov] * k))
    held = spread(labelled.select(cluster, *columns)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = joint_em(held, starts, max_iter, owner=owner, cluster=cluster)
    finally:
        held.unpersist()
    best = {}
    for key, model in fitted.items():
        g = owner[key]
        if g not in best or model.bic() < best[g].bic():
            best[g] = model
    return best

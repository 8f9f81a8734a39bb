"""Spectral clustering on a graph of neighbour edges.

The graph (`graph.build`) has a vertex per distinct row and an edge wherever the
Gaussian kernel is not negligible; its Laplacian is the unnormalised one, as the
clustering's definition has it.  Eigenvectors come from products over the edges, the
cluster count from the largest drop of the spectrum, and clusters from weighted KMeans
on the eigenvectors; every row gets the cluster of its vertex.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.operators import graph as graphs
from synthframe.operators.clustering import FEATURES, assemble
from synthframe.operators.graph import FLOOR, GAMMA, RIDGE, VERTICES, Graph, laplacian_edges, row_degrees  # noqa: F401
from synthframe.session import written

#: KMeans runs from different starts, of which the cheapest counts: single vertices far out trap some.
STARTS = 4


def affinity(x: Sequence[Column], y: Sequence[Column], gamma: float = GAMMA) -> Column:
    """Gaussian kernel exp(-gamma |x - y|^2) of two points given as columns."""
    total = F.lit(0.0)
    for a, b in zip(x, y):
        total = total + (a - b) * (a - b)
    return F.exp(-gamma * total)


def np_affinity(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] + (landmarks * landmarks).sum(1)[None] - 2 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(squared, 0.0))


def landmark_affinities(df: DataFrame, columns: Sequence[str], landmarks: np.ndarray,
                        gamma: float = GAMMA) -> DataFrame:
    """Add `affinity`, the kernel values of each row against a few given points."""
    columns = list(columns)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def kernel(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(list(np_affinity(cells[columns].to_numpy(dtype=float), landmarks, gamma)))

    return df.withColumn("affinity", kernel(F.struct(*[F.col(c).cast("double").alias(c) for c in columns])))


def laplacian_gap_k(graph: Graph, seed: int = 0) -> tuple[int, bool]:
    """The cluster count at the largest relative drop of the Laplacian spectrum, and whether it is certain."""
    return graphs.eigen_gap(graph, seed=seed)


def vertex_embedding(graph: Graph, k: int, seed: int = 0) -> DataFrame:
    """(cell, weight, spectral_1..): k eigenvectors from the small end, or as many as there are.

    The constant vector of a connected graph tells nothing and is left out.  Otherwise
    the components, largest first, span the null space, of which no one vector is the
    first, so all count.  Vectors have unit length over the rows; the entry of largest
    size is positive.
    """
    sizes = graph.nodes.groupBy("component").agg(F.sum("weight").alias("rows")).orderBy(F.desc("rows"), "component").limit(k + 1).collect()
    sizes = sizes[:k] if len(sizes) > 1 else []
    marks = [F.when(F.col("component") == r["component"], F.lit(float(r["rows"]) ** -0.5)).otherwise(F.lit(0.0)) for r in sizes]
    more = k - len(marks)
    known = graph._spectrum
    held = 0 if known is None or known.vectors is None else len(known.vectors.first()["y"])
    if more and held < more:
        known = graph._spectrum = graphs.smallest_eigenpairs(graph, more, seed)
        held = 0 if known.vectors is None else len(known.vectors.first()["y"])
    more = min(more, held)
    nodes = graph.nodes
    if more:
        y = known.vectors.select("vertex", "y")
        peaks = known.vectors.agg(*[F.max_by(F.col("y")[i], F.abs(F.col("y")[i])) for i in range(more)]).first()
        nodes = nodes.join(y, "vertex", "left")
        marks += [F.coalesce(F.col("y")[i] / F.sqrt("weight"), F.lit(0.0)) * (1.0 if p >= 0 else -1.0) for i, p in enumerate(peaks)]
    return written(nodes.select("cell", "weight", *[m.alias(f"spectral_{i + 1}") for i, m in enumerate(marks)]), "graph-embedding")


def spectral_embedding(df: DataFrame, graph: Graph, k: int, seed: int = 0) -> DataFrame:
    """Add coordinates spectral_1..k, the eigenvectors after the trivial one; null for rows that miss a coordinate."""
    return graphs.on_rows(df, graph, vertex_embedding(graph, k, seed))


def spectral_labels(df: DataFrame, columns: Sequence[str], k: int | None = None, gamma: float = GAMMA, floor: float = FLOOR,
                    most: int | None = None, seed: int = 0) -> tuple[DataFrame, Graph]:
    """Rows with a `cluster` column from KMeans on the embedding, null for rows that miss a coordinate."""
    graph = graphs.build(df, columns, gamma, floor, most)
    k = k or laplacian_gap_k(graph, seed)[0]
    embedded = vertex_embedding(graph, k, seed)
    names = [c for c in embedded.columns if c.startswith("spectral_")]
    if k <= 1 or not names:
        placed = embedded.withColumn("cluster", F.lit(0))
    else:
        features = assemble(embedded, names).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            tries = [KMeans(k=k, seed=seed + i, maxIter=20, featuresCol=FEATURES, predictionCol="cluster", weightCol="weight").fit(features) for i in range(STARTS)]
            model = min(tries, key=lambda m: m.summary.trainingCost)
            placed = written(model.transform(features).select("cell", "weight", "cluster"), "graph-clusters")
        finally:
            features.unpersist()
    return graphs.on_rows(df, graph, placed.select("cell", "weight", "cluster")), graph

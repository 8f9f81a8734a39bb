"""Covariance, correlation and eigenvalues (V1-V7)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.operators.mixture import cholesky_factor, positive_definite  # noqa: F401  (V6)

WIDE = 12  # beyond this many columns the pairs are summed by array blocks


def _pairs(columns: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]


def _pair_aggregates(df: DataFrame, columns: Sequence[str], function, cluster: str | None) -> DataFrame:
    keys = [cluster] if cluster else []
    wide = df.groupBy(*keys).agg(*[function(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double"))
                                   .alias(f"v{i}_{j}") for i, j in _pairs(columns)])
    cells = [F.struct(F.lit(columns[a]).alias("col_i"), F.lit(columns[b]).alias("col_j"),
                      F.col(f"v{min(a, b)}_{max(a, b)}").alias("value"))
             for a in range(len(columns)) for b in range(len(columns))]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("cell")).select(*keys, "cell.*")


def covariance(df: DataFrame, columns: Sequence[str], cluster: str | None = None) -> DataFrame:
    """V1, V2: sample covariance of every pair, long form (cluster, col_i, col_j, value).

    Up to `WIDE` columns this is one aggregate of built-in functions; wider tables go
    through `gram`, whose plan does not grow with the number of pairs.
    """
    if len(columns) <= WIDE:
        return _pair_aggregates(df, columns, F.covar_samp, cluster)
    return _moments_from_gram(df, columns, cluster, correlate=False)


def correlation(df: DataFrame, columns: Sequence[str], cluster: str | None = None) -> DataFrame:
    """V3: Pearson correlation of every pair, long form; null for a constant column."""
    if len(columns) <= WIDE:
        return _pair_aggregates(df, columns, F.corr, cluster)
    return _moments_from_gram(df, columns, cluster, correlate=True)


def gram(df: DataFrame, columns: Sequence[str], cluster: str | None = None) -> DataFrame:
    """Pairwise sums over rows where both cells are present.

    (cluster, i, j, n, si, sj, sii, sjj, sij), folded per task into d x d blocks of
    deviations from the column means, then summed by (cluster, i, j).
    """
    columns = list(columns)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([m or 0.0 for m in means])
    key = cluster or "__all"
    keyed = df.withColumn(key, F.lit(0)) if cluster is None else df

    def fold(batches):
        blocks: dict = {}
        for pdf in batches:
            for label, part in pdf.groupby(key, sort=False):
                x = part[columns].to_numpy(dtype=float) - shift
                here = np.isfinite(x)
                x = np.where(here, x, 0.0)
                m = here.astype(float)
                block = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
                blocks[label] = blocks.get(label, 0.0) + block
        index = np.array(_pairs(columns))
        for label, block in blocks.items():
            cells = block[:, index[:, 0], index[:, 1]]
            yield pd.DataFrame({key: label, "i": index[:, 0], "j": index[:, 1], "n": cells[0], "si": cells[1],
                                "sj": cells[2], "sii": cells[3], "sjj": cells[4], "sij": cells[5]})

    label_type = keyed.schema[key].dataType.simpleString()
    sums = ("n", "si", "sj", "sii", "sjj", "sij")
    return (keyed.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
            .mapInPandas(fold, f"`{key}` {label_type}, i int, j int, " + ", ".join(f"{s} double" for s in sums))
            .groupBy(key, "i", "j").agg(*[F.sum(s).alias(s) for s in sums]))


def _moments_from_gram(df: DataFrame, columns: Sequence[str], cluster: str | None, correlate: bool) -> DataFrame:
    sums = gram(df, columns, cluster)
    cov = F.col("sij") - F.col("si") * F.col("sj") / F.col("n")
    if correlate:
        vi = F.col("sii") - F.col("si") * F.col("si") / F.col("n")
        vj = F.col("sjj") - F.col("sj") * F.col("sj") / F.col("n")
        value = F.when((vi > 0) & (vj > 0), cov / F.sqrt(vi * vj))
    else:
        value = F.when(F.col("n") > 1, cov / (F.col("n") - 1))
    names = F.array(*[F.lit(c) for c in columns])
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    keys = [cluster] if cluster else []
    return (sums.select(*keys, F.explode(both).alias("at"), value.alias("value"))
            .select(*keys, F.get(names, F.col("at.i")).alias("col_i"), F.get(names, F.col("at.j")).alias("col_j"), "value"))


def as_matrix(rows, columns: Sequence[str]) -> np.ndarray:
    """Collected long rows of one cluster -> d x d array in column order; undefined -> 0."""
    at = {c: i for i, c in enumerate(columns)}
    out = np.zeros((len(columns), len(columns)))
    for r in rows:
        value = r["value"]
        out[at[r["col_i"]], at[r["col_j"]]] = 0.0 if value is None or np.isnan(value) else value
    return out


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    return as_matrix(covariance(df, columns).collect(), columns)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    m = as_matrix(correlation(df, columns).collect(), columns)
    np.fill_diagonal(m, 1.0)
    return m


def matrix_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """V4: left - right of two long matrices."""
    r = right.select("col_i", "col_j", F.col("value").alias("__right"))
    return left.join(r, ["col_i", "col_j"]).select("col_i", "col_j", (F.col("value") - F.col("__right")).alias("value"))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """V5: correlation of each column with the target - one aggregate, no full matrix."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "correlation")


def eigenvalues(matrix: np.ndarray) -> np.ndarray:
    """V7: eigenvalues of a symmetric matrix, largest first."""
    return np.linalg.eigvalsh(matrix)[::-1]


def relative_drops(values: np.ndarray) -> np.ndarray:
    """V7: change from each eigenvalue to the next, relative to the former."""
    values = np.asarray(values, dtype=float)
    return np.diff(values) / values[:-1]

"""Drawing new rows.

Every draw is a function of the row id, so generation has no shuffle and a lost task
recomputes the same rows.  With one cluster and families that have closed-form
quantiles, the whole chain is Column expressions; otherwise uniforms are hashed in
the JVM and one Arrow pass does the linear step and all quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from synthframe.functions import special
from synthframe.functions.rng import hash_uniform, md5_number
from synthframe.functions.sampling import smallest_by_hash
from synthframe.functions.scan import running_sum
from synthframe.operators.copula import NATIVE_QUANTILES, np_quantile, quantile_table
from synthframe.operators.encode import id_table
from synthframe.operators.marginals import Marginal
from synthframe.operators.mixture import JointMixture, cholesky_factor

MAX_EXPRESSION_COLUMNS = 24
LABEL = "__label"


def allocate_rows(sizes: DataFrame, num_rows: int, cluster: str = "cluster", method: str = "largest_remainder"
                  ) -> DataFrame:
    """(cluster, n, rows) with rows summing to `num_rows`.

    `largest_remainder` gives the spare rows to the largest fractions; `last` rounds
    each share half to even and leaves the rest to the last cluster.  The windows run
    over one row per cluster.
    """
    everything = W.partitionBy(F.lit(0))
    share = F.col("n") * F.lit(float(num_rows)) / F.sum("n").over(everything)
    if method == "last":
        rounded = sizes.withColumn("rows", F.bround(share).cast("bigint"))
        last = F.max(cluster).over(everything)
        others = F.sum(F.when(F.col(cluster) != F.col("__last"), F.col("rows")).otherwise(0)).over(everything)
        return (rounded.withColumn("__last", last)
                .withColumn("rows", F.when(F.col(cluster) == F.col("__last"), F.lit(num_rows) - others)
                            .otherwise(F.col("rows")))
                .select(cluster, "n", "rows"))
    quota = sizes.withColumn("__share", share).withColumn("__base", F.floor("__share"))
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.col("__share") - F.col("__base"), 9)), cluster)
    spare = F.lit(num_rows) - F.sum("__base").over(everything)
    ranked = quota.withColumn("__rank", F.row_number().over(order)).withColumn("__spare", spare)
    return ranked.select(cluster, "n", (F.col("__base") + (F.col("__rank") <= F.col("__spare")).cast("bigint"))
                         .alias("rows"))


@dataclass
class Draws:
    """What a generator needs: cluster shares, means, factors and marginals.

    Means and factors are those of the normal scores.  A score maps back to a value by
    the quantile of its normal probability, the exact inverse of how it was made.

    `marginals` maps a column - or (cluster, column) when `local` - to its marginal;
    None leaves the Gaussian draw as it is (a joint mixture on the data scale).
    """

    columns: list[str]
    labels: list[int]
    counts: list[float]
    means: np.ndarray
    factors: np.ndarray
    marginals: dict | None
    local: bool = False


def single_copula(columns: Sequence[str], correlation: np.ndarray, marginals: dict[str, Marginal]) -> Draws:
    """One covariance of normal scores, global marginals."""
    factor = cholesky_factor(correlation)
    return Draws(list(columns), [0], [1.0], np.zeros((1, len(columns))), factor[None], marginals)


def from_mixture(model: JointMixture) -> Draws:
    """Sampling a joint (or one-dimensional) mixture as it is."""
    return Draws(model.columns, list(range(model.k)), list(model.weights), model.means,
                 np.stack([cholesky_factor(c) for c in model.covariances]), None)


def _label_column(ids: DataFrame, draws: Draws, num_rows: int, seed: int, exact: bool) -> DataFrame:
    """Cluster of every row: exact proportional blocks, or a hashed component pick."""
    if len(draws.labels) == 1:
        return ids.withColumn(LABEL, F.lit(draws.labels[0]))
    shares = np.cumsum(np.array(draws.counts, dtype=float) / np.sum(draws.counts))
    if exact:
        quota = np.array(draws.counts) / np.sum(draws.counts) * num_rows
        rows = np.floor(quota).astype(int)
        for i in np.argsort(-(quota - rows), kind="stable")[:num_rows - rows.sum()]:
            rows[i] += 1
        at, cuts = F.col("row_id"), [int(v) for v in np.cumsum(rows)[:-1]]
    else:
        at, cuts = hash_uniform(F.col("row_id"), "component", seed), [float(v) for v in shares[:-1]]
    slot = sum(((at >= F.lit(cut)).cast("int") for cut in cuts), F.lit(0))
    return ids.withColumn(LABEL, F.get(F.array(*[F.lit(int(g)) for g in draws.labels]), slot))


def draw_rows(spark: SparkSession, draws: Draws, num_rows: int, seed: int = 0, exact: bool = True,
              arrow: bool | None = None) -> DataFrame:
    """`row_id`, the cluster label and one numeric column per fitted column.

    `arrow` forces or forbids the Arrow path; by default it is used where Column
    expressions cannot express the model or would grow too wide.
    """
    ids = _label_column(id_table(spark, num_rows), draws, num_rows, seed, exact)
    native = (len(draws.labels) == 1 and len(draws.columns) <= MAX_EXPRESSION_COLUMNS and not draws.local
              and draws.marginals is not None
              and all(m.family in NATIVE_QUANTILES for m in draws.marginals.values()))
    if arrow is False or (arrow is None and native):
        return _draw_native(ids, draws, seed)
    return _draw_arrow(ids, draws, seed)


def correlated_normals(ids: DataFrame, columns: Sequence[str], mean: np.ndarray, factor: np.ndarray,
                       row_id: str, seed: int = 0, uniform=hash_uniform) -> DataFrame:
    """Mean + factor * v with hashed standard normals v, as Column expressions."""
    base = special.with_norm_ppf(ids, {f"__v_{c}": uniform(F.col(row_id), f"normal:{c}", seed) for c in columns})
    mixed = [sum((F.lit(float(factor[i, j])) * F.col(f"__v_{columns[j]}") for j in range(i + 1)),
                 F.lit(float(mean[i]))).alias(c) for i, c in enumerate(columns)]
    return base.select(*ids.columns, *mixed)


def _draw_native(ids: DataFrame, draws: Draws, seed: int) -> DataFrame:
    scores = correlated_normals(ids, draws.columns, draws.means[0], draws.factors[0], "row_id", seed)
    p = scores.select(*ids.columns, *[special.norm_cdf(F.col(c)).alias(c) for c in draws.columns])
    made = quantile_table(p, draws.marginals)
    return special.sealed(made, ids.columns, {c: F.col(c) for c in draws.columns})


def _draw_arrow(ids: DataFrame, draws: Draws, seed: int) -> DataFrame:
    columns, labels = draws.columns, draws.labels
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in names])

    @F.pandas_udf(schema)
    def rows(cells: pd.DataFrame) -> pd.DataFrame:
        label = cells[LABEL].to_numpy()
        v = special.np_norm_ppf(cells[names].to_numpy(dtype=float))
        out = np.empty_like(v)
        for at, g in enumerate(labels):
            mine = label == g
            if not mine.any():
                continue
            u = draws.means[at] + v[mine] @ draws.factors[at].T
            if draws.marginals is None:
                out[mine] = u
                continue
            p = special.np_norm_cdf(u)
            out[mine] = np.column_stack([np_quantile(draws.marginals[(g, c) if draws.local else c], p[:, i])
                                         for i, c in enumerate(columns)])
        return pd.DataFrame(out, columns=names)

    cells = F.struct(F.col(LABEL), *[hash_uniform(F.col("row_id"), f"normal:{c}", seed).alias(n)
                                     for c, n in zip(columns, names)])
    return (ids.withColumn("__x", rows(cells))
            .select(*ids.columns, *[F.col(f"__x.{n}").alias(c) for c, n in zip(columns, names)]))


def dense_index(df: DataFrame, order_by: str) -> DataFrame:
    """Add `__index` = 0..n-1 in the order of a unique key, without a single-task sort."""
    counted = running_sum(df.withColumn("__one", F.lit(1)), [order_by], "__one")
    return counted.withColumn("__index", F.col("__one_before").cast("bigint")).drop("__one", "__one_cum", "__one_before")


def resample(real: DataFrame, num_rows: int, order_by: str, seed: int = 0) -> DataFrame:
    """`num_rows` rows drawn with replacement, by a hashed index."""
    n = real.count()
    picks = (real.sparkSession.range(num_rows)
             .select(F.pmod(md5_number(F.col("id"), "resample", seed), F.lit(n)).alias("__index")))
    return dense_index(real, order_by).join(picks, "__index").drop("__index")


def hybrid(real: DataFrame, synthetic: DataFrame, order_by: str, columns: Sequence[str], num_rows: int,
           seed: int = 0) -> DataFrame:
    """Half resampled real rows, half synthetic rows, tagged by `source`."""
    half = num_rows // 2
    left = resample(real.select(order_by, *[c for c in columns if c != order_by]), half, order_by, seed)
    right = smallest_by_hash(synthetic, num_rows - half, md5_number(F.col("row_id"), "hybrid", seed), "row_id")
    return (left.select(*columns, F.lit("real").alias("source"))
            .unionByName(right.select(*columns, F.lit("synthetic").alias("source"))))


def tagged(frames: dict[int, DataFrame], tag: str = "size") -> DataFrame:
    """Several generated tables as one, tagged by size."""
    parts = [df.withColumn(tag, F.lit(size)) for size, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def component_pick(row_id: Column, weights: Sequence[float], seed: int = 0, uniform=hash_uniform) -> Column:
    """Hashed component index by cumulative weight."""
    u = uniform(row_id, "component", seed)
    cuts = np.cumsum(np.asarray(weights) / np.sum(weights))[:-1]
    return sum(((u >= F.lit(float(cut))).cast("int") for cut in cuts), F.lit(0))

"""Missing values (M1-M7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions.rng import hash_uniform
from synthframe.functions.scan import ROWS_PER_BUCKET, ordered_fill


def add_missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1: `<column>_missing`, 1 where the value is null."""
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])


def fill_forward_backward(df: DataFrame, columns: Sequence[str], order_by: str,
                          rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """M2: previous non-null value in `order_by`, or the next one at the start."""
    return ordered_fill(df, [order_by], list(columns), rows_per_bucket=rows_per_bucket)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M3: null or NaN -> mean of the column."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    means = df.agg(*[F.avg(clean[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    fills = {c: F.coalesce(clean[c], F.lit(means[f"m{i}"])) for i, c in enumerate(columns)}
    return df.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in df.columns])


def missing_rates(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"r{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: row[f"r{i}"] or 0.0 for i, c in enumerate(columns)}


def reapply_missing(df: DataFrame, rates: dict[str, float], row_id: str, seed: int = 0,
                    uniform=hash_uniform) -> DataFrame:
    """M4: null each column at its observed rate, drawn by row id."""
    return df.select(*[F.when(uniform(F.col(row_id), f"missing:{c}", seed) >= rates[c], F.col(c)).alias(c)
                       if rates.get(c) else F.col(c) for c in df.columns])


def reapply_missing_by_position(df: DataFrame, real: DataFrame, columns: Sequence[str],
                                row_id: str) -> DataFrame:
    """M4, positional mode: null where the real row with the same id is null."""
    holes = real.select(row_id, *[F.col(c).isNull().alias(f"__hole_{c}") for c in columns])
    joined = df.join(holes, row_id, "left")
    return joined.select(*[F.when(~F.coalesce(F.col(f"__hole_{c}"), F.lit(False)), F.col(c)).alias(c)
                           if c in columns else F.col(c) for c in df.columns])


def fill_cluster_mean(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """M5: null or NaN score -> mean of its cluster.

    Means come from a grouped aggregate joined back by broadcast: a window over the
    cluster would put a whole cluster into one task.
    """
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    means = df.groupBy(cluster).agg(*[F.avg(clean[c]).alias(f"__mean_{c}") for c in columns])
    joined = df.join(F.broadcast(means), cluster, "left")  # one row per cluster
    return joined.select(*[F.coalesce(clean[c], F.col(f"__mean_{c}")).alias(c) if c in columns
                           else F.col(c) for c in df.columns])


def invalid_scores(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """M6: null/NaN and infinite scores per cluster and column."""
    wide = df.groupBy(cluster).agg(
        *[F.sum((F.col(c).isNull() | F.isnan(c)).cast("bigint")).alias(f"{c}|nan") for c in columns],
        *[F.sum(F.coalesce((F.abs(c) == float("inf")).cast("bigint"), F.lit(0))).alias(f"{c}|inf")
          for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}|nan").alias("n_nan"),
                                         F.col(f"{c}|inf").alias("n_inf")) for c in columns]))
    return wide.select(cluster, cells.alias("cell")).select(cluster, "cell.*")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))

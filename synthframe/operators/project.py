"""Projections, filters and per-value repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthframe.functions.frames import numeric_columns, string_columns  # noqa: F401  (F3)
from synthframe.functions.special import clamp_unit  # noqa: F401  (F11)


def reorder_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """project to the given column order."""
    return df.select(*columns)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """F2."""
    return df.drop(*columns)


def rows_of_cluster(df: DataFrame, cluster: str, label: int) -> DataFrame:
    """F4."""
    return df.filter(F.col(cluster) == label)


def within_range(c: Column, lo: float, hi: float) -> Column:
    """true inside [lo, hi]; null counts as outside."""
    return F.coalesce(c.between(lo, hi), F.lit(False))


def first_rows(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """first n rows in an explicit order (a distributed top-n)."""
    return df.orderBy(order_by).limit(n)


def clip(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """F8: clip to [lo, hi]; null stays null."""
    return df.select(*[F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(ranges[c][1])),
                                                               F.lit(ranges[c][0]))).alias(c)
                       if c in ranges else F.col(c) for c in df.columns])


def round_to_int(c: Column, absolute: bool = False) -> Column:
    """Round half to even and cast; optionally drop the sign first."""
    return F.bround(F.abs(c) if absolute else c).cast("bigint")


def truncate_to_int(c: Column) -> Column:
    """cast towards zero."""
    return c.cast("bigint")


def binarize(c: Column, threshold: float = 0.5) -> Column:
    """F10."""
    return (c > threshold).cast("int")


def sqrt_transform(c: Column) -> Column:
    """F12."""
    return F.sqrt(c)


def square_back(c: Column) -> Column:
    """F12, inverse."""
    return c * c


def row_vector(columns: Sequence[str]) -> Column:
    """the row as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def keep_non_null(df: DataFrame, column: str) -> DataFrame:
    """F14."""
    return df.filter(F.col(column).isNotNull())


def restore_types(df: DataFrame, dtypes: dict[str, str]) -> DataFrame:
    """Give generated numbers the type of the real column.

    Integer columns are rounded half to even; the range was clipped before, so a
    column without negative values stays non-negative.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    return df.select(*[F.bround(c).cast(dtypes[c]).alias(c) if dtypes.get(c) in whole
                       else F.col(c).cast(dtypes[c]).alias(c) if c in dtypes else F.col(c)
                       for c in df.columns])

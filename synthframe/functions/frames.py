"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 50_000
HOT_KEYS = 1_000


def numeric_columns(df: DataFrame) -> list[str]:
    """numeric column names in table order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def long_form(df: DataFrame, columns: Sequence[str], value_type: str = "double",
              keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value): one row per cell, for statistics grouped by column."""
    cast = df.select(*keep, *[F.col(c).cast(value_type).alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), "column", "value")


def spread(df: DataFrame) -> DataFrame:
    """Give a small table read from few files one partition per core before iterative work.

    A file of one row group is one task.  Tables larger than one default split per
    core already have enough tasks and are left alone, so nothing big is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = 0 < len(df.inputFiles()) < cores
    return df.repartition(cores) if few and size < cores * 128 * 2 ** 20 else df


def first_row(df: DataFrame) -> dict:
    """The single row of a global aggregate, as a dictionary."""
    return df.first().asDict()


def lookup_join(df: DataFrame, table: DataFrame, key: str, weight: str,
                broadcast_rows: int = BROADCAST_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Left join a dictionary onto rows whatever the dictionary's size and skew.

    A dictionary of at most `broadcast_rows` rows is broadcast.  A larger one is
    split: its `hot_keys` heaviest entries (by `weight`, the number of rows that
    carry the key) are broadcast, so no hot key reaches the shuffle; the rest is
    joined by shuffle.  Both ways return the same rows.
    """
    head = table.select(key).limit(broadcast_rows + 1).count()
    if head <= broadcast_rows:
        return df.join(F.broadcast(table.drop(weight)), key, "left")
    hot = table.orderBy(F.desc(weight), key).limit(hot_keys)
    slim = table.drop(weight)
    added = [c for c in slim.columns if c != key]
    tried = df.join(F.broadcast(hot.drop(weight).withColumn("__hot", F.lit(True))), key, "left")
    settled = F.col("__hot").isNotNull() | F.col(key).isNull()
    done = tried.filter(settled).drop("__hot")
    rest = tried.filter(~settled).drop("__hot", *added).join(slim.hint("merge"), key, "left")
    return done.unionByName(rest.select(*done.columns))

"""Ordered running sums and fills without a single-task window.

`Window.orderBy` with no partition sends every row to one task.  Here the order
keys are cut into buckets of similar size; per-bucket totals are carried over the
(small) bucket table, and the window only runs inside a bucket.  Bucket bounds are
explicit literals, so every evaluation and every retry of the plan puts a row into
the same bucket.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 512
SAMPLE_PER_BUCKET = 32
BUCKET = "__bucket"


def order_splits(df: DataFrame, keys: list[str], buckets: int) -> list[tuple]:
    """Bounds that cut the rows into about equal buckets.

    They come from the rows with the smallest key hashes - a uniform sample of at
    most `buckets * SAMPLE_PER_BUCKET` keys that is the same on every run.  Only
    bounds are sampled; every row is kept.
    """
    sample = (df.select(*keys).orderBy(F.xxhash64(*keys), *keys)
              .limit(buckets * SAMPLE_PER_BUCKET).collect())
    ordered = sorted({tuple(r) for r in sample})
    picks = [ordered[i * len(ordered) // buckets] for i in range(1, buckets)] if ordered else []
    return sorted(set(picks))


def _bucket_column(df: DataFrame, keys: list[str], splits: list[tuple]) -> DataFrame:
    fields = [df.schema[k].dataType for k in keys]
    if len(keys) == 1 and isinstance(fields[0], T.NumericType):
        cuts = sorted({float(s[0]) for s in splits})
        stage = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__key",
                           outputCol=BUCKET, handleInvalid="keep")
        out = stage.transform(df.withColumn("__key", F.col(keys[0]).cast("double")))
        return out.drop("__key").withColumn(BUCKET, F.col(BUCKET).cast("int"))
    bounds = F.array(*[F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, s, fields)])
                       for s in splits])
    key = F.struct(*[F.col(k) for k in keys])
    return df.withColumn(BUCKET, F.size(F.filter(bounds, lambda s: s <= key)))


def with_buckets(df: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET,
                 at_most: int | None = None) -> tuple[DataFrame, int]:
    """Add the bucket number; returns the frame and how many buckets there are.

    `at_most` is a known upper bound on the rows; one that fits a bucket saves the count.
    """
    rows = at_most if at_most is not None and at_most <= rows_per_bucket else df.count()
    buckets = min(MAX_BUCKETS, math.ceil(rows / rows_per_bucket))
    splits = order_splits(df, keys, buckets) if buckets > 1 else []
    if not splits:
        return df.withColumn(BUCKET, F.lit(0)), 1
    return _bucket_column(df, keys, splits), len(splits) + 1


def running_sum(df: DataFrame, keys: list[str], values: str | list[str], groups: tuple[str, ...] = (),
                rows_per_bucket: int = ROWS_PER_BUCKET, at_most: int | None = None) -> DataFrame:
    """Add `<value>_cum` (inclusive) and `<value>_before` in key order per group.

    (groups, keys) must identify a row; aggregate ties first.  `groups` must be few
    (column names, clusters): the carried table holds one row per group and bucket.
    """
    groups, values = list(groups), [values] if isinstance(values, str) else list(values)
    keyed, buckets = with_buckets(df, groups + keys, rows_per_bucket, at_most)
    inside = (W.partitionBy(*groups, BUCKET).orderBy(*keys)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    cum = {v: F.sum(v).over(inside) for v in values}
    if buckets > 1:
        earlier = W.partitionBy(*groups, F.lit(0)).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
        totals = keyed.groupBy(*groups, BUCKET).agg(*[F.sum(v).alias(f"__total_{v}") for v in values])
        offsets = totals.select(*groups, BUCKET, *[
            F.coalesce(F.sum(f"__total_{v}").over(earlier), F.lit(0)).alias(f"__offset_{v}") for v in values])
        keyed = keyed.join(F.broadcast(offsets), [*groups, BUCKET])
        cum = {v: c + F.col(f"__offset_{v}") for v, c in cum.items()}
    out = keyed.select(*df.columns, *[c.alias(f"{v}_cum") for v, c in cum.items()])
    return out.select("*", *[(F.col(f"{v}_cum") - F.col(v)).alias(f"{v}_before") for v in values])


def ordered_fill(df: DataFrame, keys: list[str], columns: list[str], leading: bool = True,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Forward fill in key order; leading nulls take the first value if `leading`."""
    keyed, _ = with_buckets(df, keys, rows_per_bucket)
    order = F.struct(*keys)

    def present(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), order)

    ends = keyed.groupBy(BUCKET).agg(
        *[F.max_by(c, present(c)).alias(f"__last_{c}") for c in columns],
        *[F.min_by(c, present(c)).alias(f"__first_{c}") for c in columns])
    earlier = W.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    carry = ends.select(
        BUCKET,
        *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}") for c in columns],
        *[F.first(f"__first_{c}", ignorenulls=True).over(whole).alias(f"__head_{c}") for c in columns])
    inside = W.partitionBy(BUCKET).orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = keyed.join(F.broadcast(carry), BUCKET)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(c))
            continue
        parts = [F.last(c, ignorenulls=True).over(inside), F.col(f"__carry_{c}")]
        out.append(F.coalesce(*parts, *([F.col(f"__head_{c}")] if leading else [])).alias(c))
    return filled.select(*out)

"""Exact quantiles of any number of rows.

The built-in `percentile` keeps every distinct value of a group in one task's
memory.  Here values are counted (map-side), ranked by the bucketed running sum, and
the two neighbouring order statistics are picked by plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.scan import ROWS_PER_BUCKET, running_sum


def exact_quantiles(cells: DataFrame, groups: Sequence[str], probabilities: dict[str, float], value: str = "value",
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(groups..., one column per named probability), linearly interpolated.

    `cells` holds one value per row; groups must be few (columns, clusters).
    """
    groups = list(groups)
    clean = cells.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = (clean.select(*groups, F.col(value).cast("double").alias("__x"))
              .groupBy(*groups, "__x").agg(F.count("*").alias("__k")))
    totals = counts.groupBy(*groups).agg((F.sum("__k") - 1).alias("__top"))
    ranked = running_sum(counts, ["__x"], "__k", groups=tuple(groups), rows_per_bucket=rows_per_bucket)
    joined = ranked.join(F.broadcast(totals), groups)  # one row per group
    parts = []
    for name, p in probabilities.items():
        at = F.col("__top") * F.lit(float(p))
        parts += [F.min(F.when(F.col("__k_cum") > F.floor(at), F.col("__x"))).alias(f"__lo_{name}"),
                  F.min(F.when(F.col("__k_cum") > F.ceil(at), F.col("__x"))).alias(f"__hi_{name}")]
    found = joined.groupBy(*groups, "__top").agg(*parts)

    def between(name: str, p: float):
        at = F.col("__top") * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (lo + (hi - lo) * (at - F.floor(at))).alias(name)

    return found.select(*groups, *[between(name, p) for name, p in probabilities.items()])

"""Taking the n rows of smallest hash when n itself is large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT_ROWS = 100_000
SLOTS = 4096
HASH_SPAN = 2 ** 32


def smallest_by_hash(df: DataFrame, n: int, rank: Column, tie: str, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exactly the rows of `orderBy(rank, tie).limit(n)`; `rank` is a 32-bit hash.

    A sort with a limit keeps n rows in every task and merges them in one.  Beyond
    `direct_rows` the cut-off hash is found by counting rows per hash slot, twice if
    needed (at most 4,096 counts reach the driver each time); rows below it are
    filtered in place and only the slot at the edge is sorted.
    """
    if n <= direct_rows:
        return df.orderBy(rank, tie).limit(n)
    keyed = df.withColumn("__rank", rank)
    low, width, taken = 0, HASH_SPAN, 0
    while width > 1:
        width = max(width // SLOTS, 1)
        inside = keyed.filter((F.col("__rank") >= low) & (F.col("__rank") < low + width * SLOTS))
        slot = F.floor((F.col("__rank") - low) / width).alias("slot")
        counts = {r["slot"]: r["n"] for r in inside.groupBy(slot).agg(F.count("*").alias("n")).collect()}
        edge = None
        for at in sorted(counts):
            if taken + counts[at] > n:
                edge = at
                break
            taken += counts[at]
        if edge is None:  # fewer rows than asked, or the cut falls between slots
            return keyed.filter(F.col("__rank") < low + width * SLOTS).drop("__rank")
        low += edge * width
        if counts[edge] <= direct_rows:
            break
    below = keyed.filter(F.col("__rank") < low)
    rest = keyed.filter((F.col("__rank") >= low) & (F.col("__rank") < low + width)).orderBy("__rank", tie).limit(n - taken)
    return below.unionByName(rest).drop("__rank")

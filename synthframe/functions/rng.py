"""Random numbers as hashes of (row id, stream name, seed).

`rand()` depends on how rows are spread over partitions, so a retried or
re-partitioned job would draw different values.  A hash of the row's own id gives
the same value wherever and however often the row is computed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(row_id: Column, stream: str, seed: int = 0) -> Column:
    """53-bit uniform in (0, 1) from xxhash64; the generator's default."""
    h = F.xxhash64(row_id, F.lit(stream), F.lit(seed))
    return F.shiftrightunsigned(h, 11) * F.lit(2.0 ** -53) + F.lit(2.0 ** -54)


def md5_number(row_id: Column, stream: str, seed: int = 0) -> Column:
    """32-bit integer from md5('id:stream:seed'); other SQL engines can repeat it."""
    digest = F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(stream), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def md5_uniform(row_id: Column, stream: str, seed: int = 0) -> Column:
    """32-bit uniform in (0, 1); used where results must agree across engines."""
    return (md5_number(row_id, stream, seed) + 0.5) / F.lit(2.0 ** 32)

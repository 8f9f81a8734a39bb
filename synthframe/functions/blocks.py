"""Rows packed into blocks of numbers, for work that scans the same rows many times.

Handing rows to Python one by one costs more than the arithmetic on them.  Packed once,
a scan moves a block of rows as one piece.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_ROWS = 16_384
#: One row a block: its group, how many rows it holds, and their numbers column after column.
BLOCKS = "part string, size int, body binary"


def packed(df: DataFrame, columns: Sequence[str], group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, size, body): the rows with finite numbers in all `columns`, each block of one value of `group`."""
    columns = list(columns)

    def pack(batches):
        waiting: dict = {}

        def block(key):
            body = np.concatenate(waiting.pop(key), axis=1)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([body.shape[1]], pa.int32()),
                                               pa.array([np.ascontiguousarray(body).tobytes()], pa.binary())], ["part", "size", "body"])

        for batch in batches:
            lines = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in columns])
            whole = np.isfinite(lines).all(axis=0)
            labels = np.array(batch["__part"].to_pylist(), dtype=object) if group else None
            for key in dict.fromkeys(labels[whole]) if group else [None]:
                mine = lines[:, whole & (labels == key)] if group else lines[:, whole]
                if not mine.shape[1]:
                    continue
                waiting.setdefault(key, []).append(mine)
                if sum(m.shape[1] for m in waiting[key]) >= block_rows:
                    yield block(key)
        for key in list(waiting):
            yield block(key)

    kept = df.select(*columns, *([df[group].cast("string").alias("__part")] if group else []))
    return kept.mapInArrow(pack, BLOCKS)


def unpacked(batches):
    """(part, numbers of the columns as lines) of every block."""
    for batch in batches:
        for part, size, body in zip(batch["part"].to_pylist(), batch["size"].to_pylist(), batch["body"], strict=True):
            yield part, np.frombuffer(body.as_buffer(), dtype=float).reshape(-1, size)

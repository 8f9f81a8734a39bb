"""What the text operators share: input shape, shared-folder tables, digests."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthframe.session import ship_package

#: Tables of keys are broadcast up to so many rows; larger ones are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Word separators are exactly these six bytes; `bytes.split()` uses the same set.
SPACE = r"[\x20\x09-\x0D]+"


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so no other column can clash; a null text is empty."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a private one only in local mode."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return "file://" + tempfile.mkdtemp(prefix="synthframe-")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends, the work is done once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, with the memory that it freed given back to the system when a task ends.

    Python workers outlive their tasks; what one keeps, the next operator's tasks lack.
    """
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def held_out() -> Column:
    """crc32(doc_id as text) mod 3 = 1; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About `most` rows of each value of `by`, the same on every run, from one more scan of the small columns.

    Values are counted first; each value's rows then pass a hash threshold, so no
    sort or window gathers a common value.
    """
    counts = rows.groupBy(by).count().collect()
    share = F.lit(0.0)
    for row in counts:
        share = F.when(F.col(by) == row[by], F.lit(min(1.0, most / row["count"]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share).limit(2 * most * max(1, len(counts)))

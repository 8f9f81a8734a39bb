"""Session defaults and the reliable-checkpoint helper."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Wide arithmetic projections compile into methods the JIT refuses to optimise
# (over 8,000 bytecodes).  Below this limit Spark splits the expressions into
# small methods instead; measured 2-4 times faster on 20-60 quantile columns.
RUNTIME_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators were measured with; ship the package once."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on every executor import this package.

    The archive is written on the driver, which serves it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_synthframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="synthframe-")) / "synthframe.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._synthframe_shipped = True


def local_session(app: str = "synthframe", cpus: str | int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder named by `spark.checkpoint.dir`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="synthframe-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a private one only where driver and executors are one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return "file://" + tempfile.mkdtemp(prefix="synthframe-")


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs started inside pass rows to Python in batches of about `size`: with wide rows each task holds several batches outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends and the work is done once."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Timing of actions."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FITTING, GENERATION, POST_PROCESS = "fitting", "generation", "post_process"


class StageTimer:
    """Collects (process, phase, seconds); time an action, since plans alone cost nothing."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, float]] = []

    @contextmanager
    def stage(self, process: str, phase: str = FITTING):
        """I1."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((process, phase, time.perf_counter() - start))

    def timings(self, spark: SparkSession) -> DataFrame:
        """One row per timed stage, in order."""
        rows = [(i, *r) for i, r in enumerate(self.rows)]
        return spark.createDataFrame(rows, "step int, process string, phase string, seconds double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """Seconds per phase."""
        return self.timings(spark).groupBy("phase").agg(F.sum("seconds").alias("seconds"))

"""Applying fitted models to a stream.  Scoring is stateless per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.operators.copula import normal_scores
from synthframe.operators.marginals import Marginal


def score_stream(stream: DataFrame, models: dict[str, Marginal]) -> DataFrame:
    """C4 on `readStream`: fitted columns become normal scores, row by row."""
    return normal_scores(stream, models)


def adherence_per_window(stream: DataFrame, ranges: dict[str, tuple[float, float]], time: str, window: str,
                         lateness: str = "1 hour") -> DataFrame:
    """Q1 per tumbling window: (window, column, n, inside) against the fitted ranges.

    State is one row per open window and column; the watermark bounds it.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).between(lo, hi), F.lit(False)).cast("int").alias("inside"))
        for c, (lo, hi) in ranges.items()]))
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
            .select(F.window(time, window).alias("window"), cells.alias("cell"))
            .groupBy("window", "cell.column").agg(F.count("*").alias("n"), F.sum("cell.inside").alias("inside")))

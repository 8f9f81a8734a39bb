"""Scoring a synthetic table against the real one (Q1-Q14)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions.frames import long_form, numeric_columns, string_columns
from synthframe.functions.quantiles import exact_quantiles
from synthframe.functions.rng import md5_uniform
from synthframe.functions.scan import ROWS_PER_BUCKET, running_sum
from synthframe.operators import dependence
from synthframe.operators.marginals import corrected_kurtosis, corrected_skewness
from synthframe.operators.profile import column_ranges

SCORES = "column string, score double"
PAIR_BINS = 10


def both_sources(real: DataFrame, synthetic: DataFrame, columns: Sequence[str], value_type: str) -> DataFrame:
    """(column, value, real, synthetic): how often each value occurs on either side."""
    def cells(df: DataFrame, r: int, s: int) -> DataFrame:
        return long_form(df, columns, value_type).select(
            "column", "value", F.lit(r).alias("r"), F.lit(s).alias("s"))
    return (cells(real, 1, 0).unionByName(cells(synthetic, 0, 1)).groupBy("column", "value")
            .agg(F.sum("r").alias("real"), F.sum("s").alias("synthetic")))


def comparable(real: DataFrame, synthetic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with dates and timestamps of the real one as seconds since 1970 and its booleans as text.

    Dates are then scored as numbers, booleans as categories; other columns stay.
    """
    types = {f.name: f.dataType for f in real.schema}

    def side(df: DataFrame) -> DataFrame:
        out = []
        for f in df.schema:
            c, kind = F.col(f"`{f.name}`"), types.get(f.name)
            if isinstance(kind, T.DateType):
                c = F.unix_date(c.cast("date")) * 86400.0
            elif isinstance(kind, T.TimestampNTZType):
                c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / 1e6
            elif isinstance(kind, T.TimestampType):
                c = c.cast("timestamp").cast("double")
            elif isinstance(kind, T.BooleanType):
                c = c.cast("string")
            out.append(c.alias(f.name))
        return df.select(*out)

    return side(real), side(synthetic)


def boundary_adherence(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q1: share of synthetic values inside the real range; null counts as outside."""
    ranges = column_ranges(real, list(columns))
    inside = synthetic.agg(*[F.avg(F.coalesce(F.col(c).between(*ranges[c]), F.lit(False)).cast("double")).alias(c)
                             for c in columns])
    return inside.unpivot([], list(columns), "column", "score")


def category_coverage(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q2: share of the real distinct values that occur in the synthetic table; null is a value."""
    seen = both_sources(real, synthetic, columns, "string").filter(F.col("real") > 0)
    return seen.groupBy("column").agg(F.avg((F.col("synthetic") > 0).cast("double")).alias("score"))


def range_coverage(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q3: 1 minus the uncovered parts at both ends of the real range; null for a zero range."""
    r, s = column_ranges(real, list(columns)), column_ranges(synthetic, list(columns))
    rows = []
    for c in columns:
        (r_lo, r_hi), (s_lo, s_hi) = r[c], s[c]
        width = None if r_lo is None or s_lo is None else r_hi - r_lo
        rows.append((c, 1 - max((s_lo - r_lo) / width, 0.0) - max((r_hi - s_hi) / width, 0.0) if width else None))
    return real.sparkSession.createDataFrame(rows, SCORES)


STATISTICS = ("mean", "median", "sd", "range", "iqr", "skewness", "kurtosis")


def descriptive_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q4: (column, mean, median, sd, range, iqr, skewness, kurtosis), quantiles exact."""
    x = F.col("value")
    cells = long_form(df, columns)
    moments = cells.groupBy("column").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), (F.max(x) - F.min(x)).alias("range"),
        corrected_skewness(x).alias("skewness"), corrected_kurtosis(x).alias("kurtosis"))
    quartiles = exact_quantiles(cells, ["column"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return moments.join(F.broadcast(quartiles), "column").select(  # one row per column
        "column", "mean", "median", "sd", "range", (F.col("q3") - F.col("q1")).alias("iqr"), "skewness", "kurtosis")


def compare_stats(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q5: (column, statistic, real, synthetic)."""
    def melted(df: DataFrame, name: str) -> DataFrame:
        return descriptive_stats(df, columns).unpivot("column", list(STATISTICS), "statistic", name)
    return melted(real, "real").join(melted(synthetic, "synthetic"), ["column", "statistic"])


def ks_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str],
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Q6: 1 - two-sample KS distance per numeric column."""
    counts = both_sources(real, synthetic, columns, "double").filter(F.col("value").isNotNull())
    totals = counts.groupBy("column").agg(F.sum("real").alias("n_real"), F.sum("synthetic").alias("n_syn"))
    ranked = running_sum(counts, ["value"], ["real", "synthetic"], groups=("column",), rows_per_bucket=rows_per_bucket)
    gap = F.abs(F.try_divide("real_cum", "n_real") - F.try_divide("synthetic_cum", "n_syn"))
    return (ranked.join(F.broadcast(totals), "column")  # one row per column name
            .groupBy("column").agg((1 - F.max(gap)).alias("score")))


def _total_variation(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("real").alias("n_real"), F.sum("synthetic").alias("n_syn"))
    gap = F.abs(F.try_divide("real", "n_real") - F.try_divide("synthetic", "n_syn"))
    return (counts.join(F.broadcast(totals), list(keys))  # one row per column or pair
            .groupBy(*keys).agg((1 - F.sum(gap) / 2).alias("score")))


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q6: 1 - total variation distance of the shares per category column."""
    counts = both_sources(real, synthetic, columns, "string").filter(F.col("value").isNotNull())
    return _total_variation(counts, ["column"])


def column_shapes(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str] | None = None,
                  categories: Sequence[str] | None = None) -> DataFrame:
    """Q6: (column, metric, score) of every column; dates count as numbers, booleans as categories."""
    real, synthetic = comparable(real, synthetic)
    numeric = numeric_columns(real) if numeric is None else numeric
    categories = string_columns(real) if categories is None else categories
    parts = []
    if numeric:
        parts.append(ks_complement(real, synthetic, numeric).withColumn("metric", F.lit("ks_complement")))
    if categories:
        parts.append(tv_complement(real, synthetic, categories).withColumn("metric", F.lit("tv_complement")))
    if not parts:
        return real.sparkSession.createDataFrame([], "column string, metric string, score double")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select("column", "metric", "score")


def _binned(c: str, lo: float, hi: float, bins: int = PAIR_BINS) -> Column:
    if lo is None or hi is None or lo == hi:
        return F.when(F.col(c).isNotNull(), F.lit("0"))
    slot = F.floor((F.col(c).cast("double") - lo) / (hi - lo) * bins)
    return F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("string")


def correlation_similarity(real: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Q7: (col_i, col_j, real_corr, synthetic_corr, score = 1 - |difference| / 2) for i < j."""
    at = {c: i for i, c in enumerate(columns)}

    def upper(df: DataFrame, name: str) -> DataFrame:
        m = dependence.correlation(df, columns)
        order = F.create_map(*[F.lit(v) for c in columns for v in (c, at[c])])
        return m.filter(order[F.col("col_i")] < order[F.col("col_j")]).withColumnRenamed("value", name)

    both = upper(real, "real_corr").join(upper(synthetic, "synthetic_corr"), ["col_i", "col_j"])
    return both.withColumn("score", 1 - F.abs(F.col("real_corr") - F.col("synthetic_corr")) / 2)


def contingency_similarity(real: DataFrame, synthetic: DataFrame, pairs: Sequence[tuple[str, str]],
                           numeric: Sequence[str] = ()) -> DataFrame:
    """Q7: (col_i, col_j, score) of joint shares; numeric sides are cut into ten real-range bins.

    Pairs of *columns* are exploded per row and counted on the map side.
    """
    ranges = column_ranges(real, [c for c in numeric]) if numeric else {}

    def cells(df: DataFrame, r: int, s: int) -> DataFrame:
        side = {c: (_binned(c, *ranges[c]) if c in ranges else F.col(c).cast("string"))
                for pair in pairs for c in pair}
        made = F.array(*[F.struct(F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), side[a].alias("a"),
                                  side[b].alias("b")) for a, b in pairs])
        return df.select(F.explode(made).alias("cell")).select(
            "cell.*", F.lit(r).alias("r"), F.lit(s).alias("s"))

    counts = (cells(real, 1, 0).unionByName(cells(synthetic, 0, 1)).groupBy("col_i", "col_j", "a", "b")
              .agg(F.sum("r").alias("real"), F.sum("s").alias("synthetic")))
    return _total_variation(counts, ["col_i", "col_j"])


def pair_trends(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str] | None = None,
                categories: Sequence[str] | None = None) -> DataFrame:
    """Q7: (col_i, col_j, metric, score) of every pair of columns; dates count as numbers, booleans as categories."""
    real, synthetic = comparable(real, synthetic)
    numeric = numeric_columns(real) if numeric is None else list(numeric)
    categories = string_columns(real) if categories is None else list(categories)
    parts = []
    if len(numeric) > 1:
        parts.append(correlation_similarity(real, synthetic, numeric)
                     .select("col_i", "col_j", F.lit("correlation_similarity").alias("metric"), "score"))
    mixed = [*combinations(categories, 2), *[(n, c) for n in numeric for c in categories]]
    if mixed:
        parts.append(contingency_similarity(real, synthetic, mixed, numeric if categories else ())
                     .select("col_i", "col_j", F.lit("contingency_similarity").alias("metric"), "score"))
    if not parts:
        return real.sparkSession.createDataFrame([], "col_i string, col_j string, metric string, score double")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def quality_score(real: DataFrame, synthetic: DataFrame, numeric: Sequence[str] | None = None,
                  categories: Sequence[str] | None = None) -> DataFrame:
    """Q8: (property, score): both properties and their mean, `Overall`."""
    shapes = column_shapes(real, synthetic, numeric, categories).agg(F.avg("score").alias("score"))
    trends = pair_trends(real, synthetic, numeric, categories).agg(F.avg("score").alias("score"))
    both = (shapes.select(F.lit("Column Shapes").alias("property"), "score")
            .unionByName(trends.select(F.lit("Column Pair Trends").alias("property"), "score")))
    with_total = both.rollup("property").agg(F.avg("score").alias("score"))
    return with_total.select(F.coalesce("property", F.lit("Overall")).alias("property"), "score")


def score_table(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Q9: (column, model...) with an `Average` row, from long (column, model, score)."""
    wide = scores.groupBy("column").pivot("model", list(models)).agg(F.first("score"))
    mean = wide.agg(*[F.avg(m).alias(m) for m in models]).select(F.lit("Average").alias("column"), *models)
    return wide.unionByName(mean)


def average_row(table: DataFrame) -> DataFrame:
    """the last row of a score table, its averages."""
    return table.filter(F.col("column") == "Average")


def rank_models(scores: DataFrame) -> DataFrame:
    """Q10: (model, score) best first."""
    return (scores.groupBy("model").agg(F.avg("score").alias("score"))
            .orderBy(F.desc("score"), "model"))


def merge_scores(first: DataFrame, second: DataFrame) -> DataFrame:
    """Q11: outer merge of two (column, model, score) tables; the first non-null score wins."""
    other = second.withColumnRenamed("score", "__second")
    return (first.join(other, ["column", "model"], "full_outer")
            .select("column", "model", F.coalesce("score", "__second").alias("score")))


def holdout_split(df: DataFrame, row_id: str, share: float = 0.4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rest, holdout) by a hash of the row id - stable under any partitioning."""
    held = md5_uniform(F.col(row_id), "split", seed) < share
    return df.filter(~held), df.filter(held)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Q13: (column, n), most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), column))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Q14: (bin, lo, hi, n) of equal-width bins over the range; the last bin is closed."""
    (lo, hi), = column_ranges(df, [column]).values()
    width = (hi - lo) / bins if hi > lo else 1.0
    slot = F.least(F.floor((F.col(column).cast("double") - lo) / width), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(column).isNotNull()).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), "n"))

"""Turning columns into numbers and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synthframe.functions import special
from synthframe.functions.frames import BROADCAST_ROWS, long_form, lookup_join
from synthframe.functions.rng import hash_uniform, md5_number
from synthframe.functions.scan import ordered_fill, running_sum
from synthframe.operators.profile import HYPHEN_PATTERN, PREFIX_PATTERN, day_number

Uniform = Callable[[Column, str, int], Column]


def category_intervals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, n, share, lo, hi), most frequent first, ties by name.

    The interval of a category has its share as width.  Bounds are quotients of
    integer running counts, so neighbouring intervals meet exactly.
    """
    counts = (long_form(df, columns, "string").filter(F.col("value").isNotNull())
              .groupBy("column", F.col("value").alias("category")).agg(F.count("*").alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    ordered = running_sum(counts.withColumn("__rank", -F.col("n")), ["__rank", "category"], "n",
                          groups=("column",))
    return (ordered.join(F.broadcast(totals), "column")  # one row per column name
            .select("column", "category", "n", (F.col("n") / F.col("total")).alias("share"),
                    (F.col("n_before") / F.col("total")).alias("lo"),
                    (F.col("n_cum") / F.col("total")).alias("hi")))


def category_value(lo: Column, hi: Column, u: Column, within_interval: bool = True) -> Column:
    """Probability at which a standard normal draw has to be taken.

    The draw has mean (lo+hi)/2 and sd (hi-lo)/6, truncated to the interval itself
    or, with `within_interval=False`, to [0, 1].
    """
    mean, sd = (lo + hi) / 2, (hi - lo) / 6
    a = (lo - mean) / sd if within_interval else (0 - mean) / sd
    b = (hi - mean) / sd if within_interval else (1 - mean) / sd
    left, right = special.norm_cdf(a), special.norm_cdf(b)
    if within_interval:  # both bounds lie exactly three deviations out
        left, right = (F.lit(float(special.np_norm_cdf(x))) for x in (-3.0, 3.0))
    return left + u * (right - left)


def encode_categories(df: DataFrame, columns: Sequence[str], intervals: DataFrame, row_id: str,
                      seed: int = 0, within_interval: bool = True,
                      uniform: Uniform = hash_uniform) -> DataFrame:
    """Replace each category by a draw from its interval; unknown or null -> null."""
    out, targets, bounds = df, {}, {}
    for i, c in enumerate(columns):
        table = (intervals.filter(F.col("column") == c)
                 .select(F.col("category").alias(c), F.col("n").alias("__n"),
                         F.col("lo").alias(f"__lo{i}"), F.col("hi").alias(f"__hi{i}")))
        out = lookup_join(out.withColumn(c, F.col(c).cast("string")), table, c, "__n")
        bounds[c] = (F.col(f"__lo{i}"), F.col(f"__hi{i}"))
        targets[f"__z{i}"] = category_value(*bounds[c], uniform(F.col(row_id), c, seed), within_interval)
    scored = special.with_norm_ppf(out, targets)
    value = {c: (lo + hi) / 2 + (hi - lo) / 6 * F.col(f"__z{i}")
             for i, (c, (lo, hi)) in enumerate(bounds.items())}
    return scored.select(*[F.least(F.greatest(value[c], bounds[c][0]), bounds[c][1]).alias(c)
                           if c in value and within_interval
                           else value[c].alias(c) if c in value else F.col(c) for c in df.columns])


def decode_categories(df: DataFrame, columns: Sequence[str], intervals: DataFrame,
                      row_id: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Number -> category whose interval holds it.

    Values are clamped to [0, 1]; 1 belongs to the last category.  Dictionaries of up
    to `broadcast_rows` entries become a binary search over literals.  Larger ones
    are merged with the rows in value order and filled forward (`row_id` breaks
    ties there), which needs neither a range join nor a bound on the dictionary.
    """
    out = df
    for c in columns:
        table = intervals.filter(F.col("column") == c).select("category", "lo")
        known = table.limit(broadcast_rows + 1).collect()
        if len(known) <= broadcast_rows:
            out = _decode_small(out, c, sorted((r["lo"], r["category"]) for r in known))
        else:
            out = _decode_large(out, c, table, row_id)
    return out


def _decode_small(df: DataFrame, c: str, known: list[tuple[float, str]]) -> DataFrame:
    if not known:
        return df.withColumn(c, F.lit(None).cast("string"))
    names = F.array(*[F.lit(name) for _, name in known])
    if len(known) == 1:
        return df.withColumn(c, F.when(F.col(c).isNotNull(), names[0]))
    splits = [float("-inf"), *[lo for lo, _ in known[1:]], float("inf")]
    cut = Bucketizer(splits=splits, inputCol=c, outputCol="__slot", handleInvalid="keep")
    found = cut.transform(df.withColumn(c, F.col(c).cast("double")))
    label = F.when(F.col(c).isNotNull() & ~F.isnan(c), F.get(names, F.col("__slot").cast("int")))
    return found.withColumn(c, label).drop("__slot")


def _decode_large(df: DataFrame, c: str, table: DataFrame, row_id: str | None) -> DataFrame:
    if row_id is None:
        raise ValueError("decoding against a large dictionary needs row_id")
    x = F.col(c).cast("double")
    x = F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x)
    rows = df.select(*[F.col(k).alias(f"__row_{k}") for k in df.columns],
                     x.alias("__x"), F.lit(1).alias("__kind"),
                     F.col(row_id).cast("string").alias("__tie"), F.lit(None).cast("string").alias("__category"))
    usable = F.col("__x").isNotNull() & ~F.isnan("__x")
    marks = table.select(F.col("lo").alias("__x"), F.lit(0).alias("__kind"),
                         F.col("category").alias("__tie"), F.col("category").alias("__category"))
    merged = rows.filter(usable).unionByName(marks, allowMissingColumns=True)
    filled = ordered_fill(merged, ["__x", "__kind", "__tie"], ["__category"], leading=False)
    decoded = filled.filter(F.col("__kind") == 1).unionByName(rows.filter(~usable))
    return decoded.select(*[F.col("__category").alias(k) if k == c else F.col(f"__row_{k}").alias(k)
                            for k in df.columns])


def dates_to_days(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Date, timestamp or date-string columns -> days since 1970-01-01 (double)."""
    types = {f.name: f.dataType for f in df.schema}
    return df.select(*[day_number(F.col(c), types[c]).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def day_to_date(days: Column) -> Column:
    """Days -> whole date, rounding half to even."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.bround(days).cast("int"))


def days_to_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[day_to_date(F.col(c)).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def random_digits(row_id: Column, length: int, stream: str, seed: int = 0) -> Column:
    """Zero-padded random digits; nine per hash, so any length is covered."""
    pieces = []
    for at in range(0, length, 9):
        width = min(9, length - at)
        number = F.pmod(md5_number(row_id, f"{stream}/{at}", seed), F.lit(10 ** width))
        pieces.append(F.lpad(number.cast("string"), width, "0"))
    return F.concat(*pieces) if pieces else F.lit("")


def prefixed_id(row_id: Column, prefix: str, digits: int, stream: str = "id", seed: int = 0) -> Column:
    """Prefix followed by random digits."""
    return F.concat(F.lit(prefix), random_digits(row_id, digits, stream, seed))


def hyphenated_id(row_id: Column, digits: Sequence[int], stream: str = "id", seed: int = 0) -> Column:
    """Random digit groups joined by hyphens."""
    return F.concat_ws("-", *[random_digits(row_id, d, f"{stream}-{i}", seed)
                              for i, d in enumerate(digits)])


def repad_id(c: Column, digits: Sequence[int]) -> Column:
    """Pad each group of a hyphenated id back to its observed width."""
    parts = F.split(c, "-")
    widths = F.array(*[F.lit(d) for d in digits])
    return F.array_join(F.zip_with(parts, widths, lambda part, width: F.when(
        F.length(part) < width, F.lpad(part, width, F.lit("0"))).otherwise(part)), "-")


def id_number(c: Column) -> Column:
    """Numeric part of a prefixed id."""
    return F.regexp_extract(c, PREFIX_PATTERN, 2).cast("bigint")


def hyphen_groups(c: Column) -> Column:
    """The three groups of a hyphenated id as numbers."""
    return F.array(*[F.regexp_extract(c, HYPHEN_PATTERN, g).cast("bigint") for g in (1, 2, 3)])


def minmax_bounds(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Fit of the min-max scaler."""
    from synthframe.operators.profile import column_ranges
    return column_ranges(df, list(columns))


def minmax_scale(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Apply fitted bounds, on the fitting table or any other; constants -> 0."""
    def scaled(c: str) -> Column:
        lo, hi = bounds[c]
        return ((F.col(c) - lo) / (hi - lo) if hi > lo else F.col(c) * 0.0).alias(c)
    return df.select(*[scaled(c) if c in bounds else F.col(c) for c in df.columns])


def standard_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population sd) per column, one aggregate."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def standardize(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / sd; a constant column becomes 0."""
    def scored(c: str) -> Column:
        mean, sd = moments[c]
        return ((F.col(c) - mean) / (sd if sd > 0 else 1.0)).alias(c)
    return df.select(*[scored(c) if c in moments else F.col(c) for c in df.columns])


MAX_INDICATORS = 1_000


def category_levels(df: DataFrame, column: str, limit: int = MAX_INDICATORS) -> list:
    """Distinct non-null values in order; refuses a dictionary too wide for columns."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values; use one_hot_vectors")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """A 0/1 column per fitted level; an unknown value gives all zeros."""
    kept = [F.col(c) for c in df.columns if c not in levels]
    made = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
            for c, values in levels.items() for v in values]
    return df.select(*kept, *made)


def one_hot_vectors(columns: Sequence[str]) -> Pipeline:
    """Sparse form for wide dictionaries, as a Spark ML pipeline."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    index = StringIndexer(inputCols=list(columns), outputCols=[f"{c}_index" for c in columns],
                          handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=index.getOutputCols(), dropLast=True,
                           outputCols=[f"{c}_vector" for c in columns])
    return Pipeline(stages=[index, encode])


def binarize_labels(df: DataFrame, column: str, classes: Sequence) -> DataFrame:
    """One 0/1 column per class, one-vs-rest."""
    return df.select("*", *[F.coalesce((F.col(column) == F.lit(k)).cast("int"), F.lit(0))
                            .alias(f"{column}_is_{k}") for k in classes])


def id_table(spark: SparkSession, n: int) -> DataFrame:
    """Row ids 0..n-1 in a column `row_id`, generated in parallel."""
    return spark.range(n).withColumnRenamed("id", "row_id")

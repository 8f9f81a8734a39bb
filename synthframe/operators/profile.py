"""Column profiling and role inference."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions.frames import first_row

# The identifier formats recognised in unique string columns.
PREFIX_PATTERN = r"^([A-Za-z]+)([0-9]+)"
HYPHEN_PATTERN = r"^([0-9]+)-([0-9]+)-([0-9]+)"

NUMERIC, CATEGORY, DATETIME = "numeric", "category", "datetime"
PREFIXED_ID, HYPHEN_ID, SURROGATE_ID, TEXT_ID = "prefixed_id", "hyphen_id", "surrogate_id", "text_id"

PROFILE_SCHEMA = ("column string, dtype string, role string, n bigint, n_null bigint, "
                  "n_distinct bigint, min double, max double, prefix string, digits array<int>")
_TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass
class ColumnProfile:
    column: str
    dtype: str
    role: str
    n: int
    n_null: int
    n_distinct: int
    min: float | None = None
    max: float | None = None
    prefix: str | None = None
    digits: list[int] = field(default_factory=list)


def day_number(c: Column, dtype: T.DataType) -> Column:
    """Days since 1970-01-01 as double, independent of the session time zone.

    Strings that do not parse become null.
    """
    local = (F.try_to_timestamp(c) if isinstance(dtype, T.StringType) else c).cast("timestamp_ntz")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, local) / F.lit(86_400_000_000.0)


def _check_flat(df: DataFrame) -> None:
    nested = [f.name for f in df.schema
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if nested:
        raise ValueError(f"flatten or drop nested columns first: {', '.join(nested)}")


def profile_columns(df: DataFrame, order_by: str | None = None, exact_distinct: bool = False,
                    date_share: float = 0.95, unique_numbers_as_category: bool = False
                    ) -> list[ColumnProfile]:
    """One profile per column, in table order.

    All counts, ranges and pattern tests are one aggregate.  Distinct counts are
    HyperLogLog estimates unless `exact_distinct`; a column whose estimate comes
    near the row count is always counted exactly, since uniqueness decides roles.
    """
    _check_flat(df)
    if not df.columns:
        return []
    aggregates = [F.count(F.lit(1)).alias("n")]
    dated = df.select("*", *[day_number(F.col(f"`{f.name}`"), f.dataType).alias(f"__days_{i}")  # parse once per row
                             for i, f in enumerate(df.schema) if isinstance(f.dataType, (*_TIME_TYPES, T.StringType))])
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        aggregates += [F.count(c).alias(f"{i}_filled"),
                       F.approx_count_distinct(c, 0.02).alias(f"{i}_approx")]
        if isinstance(f.dataType, T.NumericType):
            aggregates += [F.min(c).cast("double").alias(f"{i}_min"),
                           F.max(c).cast("double").alias(f"{i}_max")]
        elif isinstance(f.dataType, (*_TIME_TYPES, T.StringType)):
            days = F.col(f"__days_{i}")
            aggregates += [F.min(days).alias(f"{i}_min"), F.max(days).alias(f"{i}_max"),
                           F.count(days).alias(f"{i}_dates")]
        if isinstance(f.dataType, T.StringType):
            order = F.col(order_by) if order_by else c
            aggregates += [F.bool_and(c.rlike(PREFIX_PATTERN)).alias(f"{i}_prefixed"),
                           F.bool_and(c.rlike(HYPHEN_PATTERN)).alias(f"{i}_hyphen"),
                           F.min_by(c, F.when(c.isNotNull(), order)).alias(f"{i}_first")]
    facts = first_row(dated.agg(*aggregates))
    n = facts["n"]
    names = df.columns
    exact = [c for i, c in enumerate(names)
             if exact_distinct or facts[f"{i}_approx"] >= 0.9 * facts[f"{i}_filled"] > 0]
    distinct = dict(zip(names, (facts[f"{i}_approx"] for i in range(len(names)))))
    distinct.update(distinct_counts(df, exact))

    profiles = []
    for i, f in enumerate(df.schema):
        filled = facts[f"{i}_filled"]
        p = ColumnProfile(f.name, f.dataType.simpleString(), "", n, n - filled, distinct[f.name])
        unique = n > 0 and p.n_distinct == n
        is_date = filled > 0 and facts.get(f"{i}_dates", 0) >= date_share * filled
        if isinstance(f.dataType, _TIME_TYPES) or (isinstance(f.dataType, T.StringType) and is_date):
            p.role = DATETIME
        elif isinstance(f.dataType, T.NumericType):
            fractional = isinstance(f.dataType, (T.FractionalType, T.DecimalType))
            p.role = NUMERIC if not unique or (fractional and not unique_numbers_as_category) \
                else CATEGORY if unique_numbers_as_category else SURROGATE_ID
        elif unique and facts.get(f"{i}_prefixed"):
            p.role = PREFIXED_ID
        elif unique and facts.get(f"{i}_hyphen"):
            p.role = HYPHEN_ID
        else:
            p.role = TEXT_ID if unique else CATEGORY
        if p.role in (NUMERIC, DATETIME, SURROGATE_ID):
            p.min, p.max = facts[f"{i}_min"], facts[f"{i}_max"]
        profiles.append(p)
        if p.role in (PREFIXED_ID, HYPHEN_ID):
            p.prefix, p.digits = _id_format(facts[f"{i}_first"], p.role)
    if not any(p.role in (PREFIXED_ID, HYPHEN_ID) for p in profiles):
        for p in profiles:  # P4: no identifier format anywhere - unique text is a category
            p.role = CATEGORY if p.role == TEXT_ID else p.role
    return profiles


def _id_format(first: str, role: str) -> tuple[str | None, list[int]]:
    import re
    if role == PREFIXED_ID:
        prefix, number = re.match(PREFIX_PATTERN, first).groups()
        return prefix, [len(number)]
    return None, [len(g) for g in re.match(HYPHEN_PATTERN, first).groups()]


def profile_frame(df: DataFrame, **options) -> DataFrame:
    """The profile as a DataFrame, one row per column of `df`."""
    rows = [tuple(asdict(p).values()) for p in profile_columns(df, **options)]
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null counts of several columns, each in its own type.

    Columns of one type are unpivoted together, so no value turns into a string; a
    column's values are made distinct before the shuffle and counted after it.
    """
    parts = []
    for kind in {f.dataType.simpleString(): None for f in df.schema if f.name in columns}:
        named = [(i, c) for i, c in enumerate(columns) if df.schema[c].dataType.simpleString() == kind]
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"`{c}`").alias("value")) for i, c in named]))
        parts.append(df.select(cells.alias("cell")).select("cell.*").filter("value IS NOT NULL")
                     .distinct().groupBy("at").agg(F.count("*").alias("n")))
    if not parts:
        return {}
    found = {r["at"]: r["n"] for r in reduce(DataFrame.unionByName, parts).collect()}  # one row per column
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def prefix_parts(c: Column) -> Column:
    """struct(matched, prefix, digits) of a prefixed identifier."""
    number = F.regexp_extract(c, PREFIX_PATTERN, 2)
    return F.struct(c.rlike(PREFIX_PATTERN).alias("matched"),
                    F.regexp_extract(c, PREFIX_PATTERN, 1).alias("prefix"),
                    F.length(number).alias("digits"))


def hyphen_parts(c: Column) -> Column:
    """struct(matched, digits array) of a hyphenated number."""
    return F.struct(c.rlike(HYPHEN_PATTERN).alias("matched"),
                    F.array(*[F.length(F.regexp_extract(c, HYPHEN_PATTERN, g)) for g in (1, 2, 3)])
                    .alias("digits"))


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P5, M7: null count and share per column."""
    columns = columns or df.columns
    counts = df.agg(F.count(F.lit(1)).alias("__n"),
                    *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    return (counts.unpivot(["__n"], columns, "column", "n_null")
            .select("column", "n_null", F.try_divide("n_null", "__n").alias("null_share")))


def dtype_groups(df: DataFrame) -> DataFrame:
    """Column names per data type."""
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "position int, column string, dtype string")
    return (types.groupBy("dtype")
            .agg(F.count("*").alias("n_columns"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))),
                                          lambda s: s["column"]), ",").alias("columns")))


def columns_of_type(df: DataFrame, dtype: str) -> DataFrame:
    """The columns of one data type."""
    return df.select(*[f.name for f in df.schema if f.dataType.simpleString() == dtype])


def zero_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of zeros per column, one aggregate."""
    shares = df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(c) for c in columns])
    return shares.unpivot([], columns, "column", "zero_share")


def prune_near_constant(df: DataFrame, threshold: float = 0.99, keep: tuple[str, ...] = (),
                        columns: list[str] | None = None) -> DataFrame:
    """Drop columns whose share of zeros reaches the threshold, except `keep`."""
    columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    shares = zero_shares(df, [c for c in columns if c not in keep])
    return df.drop(*[r["column"] for r in shares.filter(F.col("zero_share") >= threshold).collect()])


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P10: whether a column holds a single distinct value (min equals max)."""
    flags = df.agg(*[(F.min(c).eqNullSafe(F.max(c)) & F.min(c).isNotNull()).alias(c) for c in columns])
    return flags.unpivot([], columns, "column", "is_constant")


def equal_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """Pairs of columns that agree in more than `threshold` of the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    agg = df.agg(*[F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    ratio = agg.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "equal_share")
    parts = F.split("pair", r"\|")
    return (ratio.filter(F.col("equal_share") > threshold)
            .select(parts[0].alias("col_i"), parts[1].alias("col_j"), "equal_share"))


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(min, max) per column on the driver, one aggregate."""
    row = first_row(df.agg(*[F.min(c).cast("double").alias(f"lo_{i}") for i, c in enumerate(columns)],
                           *[F.max(c).cast("double").alias(f"hi_{i}") for i, c in enumerate(columns)]))
    return {c: (row[f"lo_{i}"], row[f"hi_{i}"]) for i, c in enumerate(columns)}

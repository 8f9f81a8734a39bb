"""Queries on generation, scoring, learning utility, sources and timing."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.rng import md5_uniform
from synthframe.operators import encode, generate, quality, trees, utility
from synthframe.operators.timing import GENERATION, StageTimer
from synthframe.plans import sqltext as S
from synthframe.plans.queries_prepare import GAPPY, MEASURES, gappy_orders
from synthframe.plans.registry import Tables, query
from synthframe.plans.synthesizer import Synthesizer
from synthframe.sources import tables as io

NUMERIC = ["o_totalprice", "o_custkey"]
CATEGORIES = ["o_orderstatus", "o_orderpriority"]


def real_orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", *NUMERIC, *CATEGORIES)


def synthetic_orders(t: Tables) -> DataFrame:
    """A stand-in synthetic table of full size: prices scaled and priorities redrawn by hash, some nulls."""
    key = F.col("o_orderkey")
    u, v = md5_uniform(key, "price"), md5_uniform(key, "priority")
    return t.orders.select(
        "o_orderkey", F.round(F.col("o_totalprice") * (0.7 + 0.5 * u), 2).alias("o_totalprice"),
        F.when(u < 0.95, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.when(v < 0.4, "1-URGENT").when(v < 0.7, "2-HIGH").when(v < 0.9, F.col("o_orderpriority")).alias("o_orderpriority"))


_U, _V = S.md5_uniform("o_orderkey", "price"), S.md5_uniform("o_orderkey", "priority")
REAL = "(SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderpriority FROM orders)"
SYNTHETIC = f"""(SELECT o_orderkey, round(o_totalprice * (0.7 + 0.5 * {_U}), 2) AS o_totalprice,
  CASE WHEN {_U} < 0.95 THEN o_custkey END AS o_custkey, o_orderstatus, CASE WHEN {_V} < 0.4 THEN '1-URGENT'
  WHEN {_V} < 0.7 THEN '2-HIGH' WHEN {_V} < 0.9 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


# ------------------------------------------------------------------ generation

def _orders_model(t: Tables, preset: str, **options):
    orders = t.orders.drop("o_custkey")
    return Synthesizer(preset, row_id="o_orderkey", **options).fit(orders), orders.count()


def _preset_query(name: str, preset: str, ids: str, **options) -> None:
    @query(name, ids)
    def run(t):
        model, n = _orders_model(t, preset, **options)
        return model.sample(t.spark, n)


_preset_query("synth_mixture_copula", "mixture_copula", "G1 G2 G11 D2 C1 C8 S2")
_preset_query("synth_joint_mixture", "joint_mixture", "G8 D3 G11", joint_components=3)
_preset_query("synth_parametric_copula", "parametric_copula", "G3 K3 K4 G11")
_preset_query("synth_elbow_copula", "elbow_copula", "G4 K6 V2 G11")
_preset_query("synth_silhouette_copula", "silhouette_copula", "G4 K7 V2 G11")
_preset_query("synth_local_copula", "local_copula", "G5 G6 G7 K2 D9 C3 M5", k=3)
_preset_query("synth_spectral_copula", "spectral_copula", "G4 K12 K13 K14 K15 K16 V2")
_preset_query("synth_spectral_mixture", "spectral_mixture", "K17 G3", k=3)


@query("synth_with_ids_and_gaps", "E7 E8 M2 M4 G2 G11")
def synth_with_ids_and_gaps(t):
    """Customers with two identifier formats, a date string and missing cells."""
    key = F.col("c_custkey")
    df = t.customer.select(
        F.concat(F.lit("C"), F.lpad(key.cast("string"), 6, "0")).alias("code"),
        F.concat_ws("-", F.lpad((key % 1000).cast("string"), 3, "0"), F.lpad(key.cast("string"), 7, "0"),
                    F.lit("1")).alias("policy"), "c_custkey", "c_nationkey",
        F.when(key % 9 != 4, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 6 != 1, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd").alias("joined"))
    return Synthesizer("elbow_copula", row_id="c_custkey", k=3).fit(df).sample(t.spark, df.count())


@query("quality_of_synthetic", "Q1 Q2 Q3 Q6 Q7 Q8 G3")
def quality_of_synthetic(t):
    model, n = _orders_model(t, "parametric_copula", k=3)
    real = t.orders.select("o_totalprice", "o_orderstatus", "o_orderpriority")
    return quality.quality_score(real, model.sample(t.spark, n).select(*real.columns))


def _sizes_sql(expression: str) -> str:
    return f"""WITH s AS (SELECT p_size AS cluster, count(*) AS n FROM part GROUP BY 1),
q AS (SELECT *, n * 12345.0 / sum(n) OVER () AS share FROM s) {expression}"""


@query("allocate_rows", "G4", _sizes_sql("""SELECT cluster, n, cast(floor(share) as bigint) + cast(row_number() OVER (
  ORDER BY round(share - floor(share), 9) DESC, cluster) <= 12345 - sum(cast(floor(share) as bigint)) OVER () as bigint) AS rows FROM q"""))
def allocate_rows(t):
    sizes = t.part.groupBy(F.col("p_size").alias("cluster")).agg(F.count("*").alias("n"))
    return generate.allocate_rows(sizes, 12345)


@query("allocate_rows_rounded", "G5", _sizes_sql("""SELECT cluster, n, cast(CASE WHEN cluster = max(cluster) OVER () THEN 12345 -
  (sum(cast(round_even(share, 0) as bigint)) OVER () - cast(round_even(share, 0) as bigint)) ELSE round_even(share, 0) END as bigint) AS rows FROM q"""))
def allocate_rows_rounded(t):
    sizes = t.part.groupBy(F.col("p_size").alias("cluster")).agg(F.count("*").alias("n"))
    return generate.allocate_rows(sizes, 12345, method="last")


_RESAMPLE = """SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
JOIN (SELECT cast('0x' || substr(md5(cast(i as varchar) || ':resample:0'), 1, 8) as bigint) % (SELECT count(*) FROM orders) AS pos
  FROM (SELECT unnest(range({rows})) AS i)) USING (pos)"""


@query("resample", "G10", _RESAMPLE.format(rows="(SELECT count(*) FROM orders)"))
def resample(t):
    df = t.orders.select("o_orderkey", "o_totalprice")
    return generate.resample(df, df.count(), "o_orderkey")


@query("hybrid_resample", "G10", f"""SELECT o_totalprice, 'real' AS source FROM ({_RESAMPLE.format(rows="(SELECT count(*) // 2 FROM orders)")})
UNION ALL SELECT o_totalprice, 'synthetic' FROM (SELECT o_totalprice FROM {SYNTHETIC}
  ORDER BY {S.md5_number('o_orderkey', 'hybrid')}, o_orderkey LIMIT (SELECT count(*) - count(*) // 2 FROM orders))""")
def hybrid_resample(t):
    synthetic = synthetic_orders(t).select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return generate.hybrid(t.orders, synthetic, "o_orderkey", ["o_totalprice"], t.orders.count())


@query("size_sweep", "G13")
def size_sweep(t):
    model, n = _orders_model(t, "parametric_copula", k=2)
    swept = generate.tagged({size: model.sample(t.spark, size) for size in (n // 2, n, 2 * n)})
    return swept.groupBy("size").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))


# --------------------------------------------------------------------- scoring

def _per_column(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("boundary_adherence", "Q1 F5", _per_column(NUMERIC, "SELECT '{c}' AS \"column\", round(avg(cast(coalesce({c} BETWEEN (SELECT min({c}) FROM "
       + REAL + ") AND (SELECT max({c}) FROM " + REAL + "), false) as int)), 9) AS score FROM " + SYNTHETIC))
def boundary_adherence(t):
    return quality.boundary_adherence(real_orders(t), synthetic_orders(t), NUMERIC).withColumn("score", F.round("score", 9))


@query("category_coverage", "Q2", _per_column(CATEGORIES, "SELECT '{c}' AS \"column\", round((SELECT count(*) FROM (SELECT DISTINCT {c} FROM " + REAL
       + " INTERSECT SELECT DISTINCT {c} FROM " + SYNTHETIC + ")) / cast((SELECT count(*) FROM (SELECT DISTINCT {c} FROM " + REAL + ")) as double), 9) AS score"))
def category_coverage(t):
    return quality.category_coverage(real_orders(t), synthetic_orders(t), CATEGORIES).withColumn("score", F.round("score", 9))


@query("range_coverage", "Q3", _per_column(NUMERIC, "SELECT '{c}' AS \"column\", round(1 - greatest((s0 - r0) / (r1 - r0), 0) - greatest((r1 - s1) / (r1 - r0), 0), 9) AS score "
       "FROM (SELECT min({c}) AS r0, cast(max({c}) as double) AS r1 FROM " + REAL + "), (SELECT min({c}) AS s0, max({c}) AS s1 FROM " + SYNTHETIC + ")"))
def range_coverage(t):
    return quality.range_coverage(real_orders(t), synthetic_orders(t), NUMERIC).withColumn("score", F.round("score", 9))


def _stats_sql(columns, table: str) -> str:
    return _per_column(columns, "SELECT '{c}' AS \"column\", avg({c}) AS mean, quantile_cont(cast({c} as double), 0.5) AS median, stddev_samp({c}) AS sd, "
                       "cast(max({c}) - min({c}) as double) AS range, quantile_cont(cast({c} as double), 0.75) - quantile_cont(cast({c} as double), 0.25) AS iqr, "
                       "skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM " + table)


def _rounded(table: str) -> str:
    return 'SELECT "column", ' + ", ".join(f"round({s}, 5) AS {s}" for s in quality.STATISTICS) + f" FROM ({table})"


@query("descriptive_stats", "Q4", _rounded(_stats_sql(MEASURES, "lineitem")))
def descriptive_stats(t):
    return quality.descriptive_stats(t.lineitem, MEASURES).select("column", *[F.round(s, 5).alias(s) for s in quality.STATISTICS])


def _melted(table: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT \"column\", '{s}' AS statistic, round({s}, 4) AS \"{name}\" FROM ({table})" for s in quality.STATISTICS)


@query("stats_compare", "Q5", f"""SELECT "column", statistic, "real", synthetic FROM ({_melted(_stats_sql(NUMERIC, REAL), 'real')})
JOIN ({_melted(_stats_sql(NUMERIC, SYNTHETIC), 'synthetic')}) USING ("column", statistic)""")
def stats_compare(t):
    made = quality.compare_stats(real_orders(t), synthetic_orders(t), NUMERIC)
    return made.select("column", "statistic", *[F.round(c, 4).alias(c) for c in ("real", "synthetic")])


def _ks2_sql(columns=NUMERIC, real: str = REAL, synthetic: str = SYNTHETIC) -> str:
    cells = _per_column(columns, "SELECT '{c}' AS \"column\", cast({c} as double) AS value, 1 AS r, 0 AS s FROM " + real + " UNION ALL SELECT '{c}', {c}, 0, 1 FROM " + synthetic)
    return f"""SELECT "column", 'ks_complement' AS metric, 1 - max(abs(cr / cast(nr as double) - cs / cast(ns as double))) AS score FROM (
  SELECT "column", sum(r) OVER w AS cr, sum(s) OVER w AS cs, sum(r) OVER p AS nr, sum(s) OVER p AS ns
  FROM (SELECT "column", value, sum(r) AS r, sum(s) AS s FROM ({cells}) WHERE value IS NOT NULL GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY "column")) GROUP BY 1"""


def _tv_sql(columns=CATEGORIES, real: str = REAL, synthetic: str = SYNTHETIC) -> str:
    cells = _per_column(columns, "SELECT '{c}' AS \"column\", {c} AS value, 1 AS r, 0 AS s FROM " + real + " UNION ALL SELECT '{c}', {c}, 0, 1 FROM " + synthetic)
    return f"""SELECT "column", 'tv_complement' AS metric, 1 - sum(abs(r / cast(nr as double) - s / cast(ns as double))) / 2 AS score FROM (
  SELECT "column", r, s, sum(r) OVER p AS nr, sum(s) OVER p AS ns FROM (SELECT "column", value, sum(r) AS r, sum(s) AS s
    FROM ({cells}) WHERE value IS NOT NULL GROUP BY 1, 2) WINDOW p AS (PARTITION BY "column")) GROUP BY 1"""


SHAPES = f"({_ks2_sql()} UNION ALL {_tv_sql()})"


@query("column_shapes", "Q6", f'SELECT "column", metric, round(score, 8) AS score FROM {SHAPES}')
def column_shapes(t):
    return quality.column_shapes(real_orders(t), synthetic_orders(t), NUMERIC, CATEGORIES).withColumn("score", F.round("score", 8))


def _dated(t, later, doubt) -> DataFrame:
    """Orders with a date and a boolean, moved by `later` days and turned where `doubt` holds."""
    large = F.col("o_totalprice") > 100000
    return t.orders.select("o_totalprice", (F.col("o_orderdate") + F.make_interval(days=later)).alias("o_orderdate"),
                           F.when(doubt, ~large).otherwise(large).alias("large"))


def _dated_tables(t) -> tuple[DataFrame, DataFrame]:
    key = F.col("o_orderkey")
    moved = F.floor(200 * md5_uniform(key, "day")).cast("int")
    return _dated(t, F.lit(0), F.lit(False)), _dated(t, moved, md5_uniform(key, "large") < 0.3)


_LARGE = "CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END"
_DATED_REAL = f"(SELECT o_totalprice, epoch(o_orderdate) AS o_orderdate, {_LARGE} AS large FROM orders)"
_DATED_SYNTHETIC = f"""(SELECT o_totalprice, epoch(o_orderdate) + 86400 * floor(200 * {S.md5_uniform('o_orderkey', 'day')}) AS o_orderdate,
  CASE WHEN {S.md5_uniform('o_orderkey', 'large')} < 0.3 THEN CASE WHEN o_totalprice > 100000 THEN 'false' ELSE 'true' END ELSE {_LARGE} END AS large FROM orders)"""
_DATED_NUMBERS = ["o_totalprice", "o_orderdate"]


@query("date_boolean_shapes", "Q6", f"""SELECT "column", metric, round(score, 8) AS score
FROM ({_ks2_sql(_DATED_NUMBERS, _DATED_REAL, _DATED_SYNTHETIC)} UNION ALL {_tv_sql(["large"], _DATED_REAL, _DATED_SYNTHETIC)})""")
def date_boolean_shapes(t):
    """Column shapes of dates and booleans, found by their types."""
    return quality.column_shapes(*_dated_tables(t)).withColumn("score", F.round("score", 8))


def _dated_pairs_sql() -> str:
    def cells(c: str, table: str, r: int, s: int) -> str:
        lo, hi = f"(SELECT min({c}) FROM {_DATED_REAL})", f"(SELECT max({c}) FROM {_DATED_REAL})"
        return f"""SELECT '{c}' AS col_i, cast(least(greatest(floor(({c} - {lo}) / cast({hi} - {lo} as double) * 10), 0), 9) as varchar) AS a, large AS b,
  {r} AS r, {s} AS s FROM {table}"""

    both = " UNION ALL ".join(cells(c, table, r, s) for c in _DATED_NUMBERS for table, r, s in ((_DATED_REAL, 1, 0), (_DATED_SYNTHETIC, 0, 1)))
    return f"""SELECT 'o_totalprice' AS col_i, 'o_orderdate' AS col_j, 'correlation_similarity' AS metric, round(1 - abs((SELECT corr(o_totalprice, o_orderdate) FROM {_DATED_REAL})
  - (SELECT corr(o_totalprice, o_orderdate) FROM {_DATED_SYNTHETIC})) / 2, 8) AS score
UNION ALL SELECT col_i, 'large', 'contingency_similarity', round(1 - sum(abs(r / cast(nr as double) - s / cast(ns as double))) / 2, 8) FROM (
  SELECT col_i, r, s, sum(r) OVER p AS nr, sum(s) OVER p AS ns FROM (SELECT col_i, a, b, sum(r) AS r, sum(s) AS s FROM ({both}) GROUP BY ALL)
  WINDOW p AS (PARTITION BY col_i)) GROUP BY 1, 2"""


@query("date_boolean_trends", "Q7", _dated_pairs_sql())
def date_boolean_trends(t):
    """Pair trends with dates and booleans, found by their types."""
    return quality.pair_trends(*_dated_tables(t)).withColumn("score", F.round("score", 8))


def _pairs_sql() -> str:
    corr = f"""SELECT 'o_totalprice' AS col_i, 'o_custkey' AS col_j, 'correlation_similarity' AS metric, 1 - abs((SELECT corr(o_totalprice, o_custkey) FROM {REAL})
  - (SELECT corr(o_totalprice, o_custkey) FROM {SYNTHETIC})) / 2 AS score"""
    pairs = [("o_orderstatus", "o_orderpriority"), *[(n, c) for n in NUMERIC for c in CATEGORIES]]

    def side(c: str) -> str:
        if c in CATEGORIES:
            return c
        lo, hi = f"(SELECT min({c}) FROM orders)", f"(SELECT max({c}) FROM orders)"
        return f"cast(least(greatest(floor(({c} - {lo}) / cast({hi} - {lo} as double) * 10), 0), 9) as varchar)"

    cells = " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, {side(a)} AS a, {side(b)} AS b, {r} AS r, {s} AS s FROM {table}"
                               for a, b in pairs for r, s, table in ((1, 0, REAL), (0, 1, SYNTHETIC)))
    return f"""({corr} UNION ALL SELECT col_i, col_j, 'contingency_similarity', 1 - sum(abs(r / cast(nr as double) - s / cast(ns as double))) / 2 FROM (
  SELECT col_i, col_j, r, s, sum(r) OVER p AS nr, sum(s) OVER p AS ns FROM (SELECT col_i, col_j, a, b, sum(r) AS r, sum(s) AS s FROM ({cells})
    GROUP BY ALL) WINDOW p AS (PARTITION BY col_i, col_j)) GROUP BY 1, 2)"""


PAIRS = _pairs_sql()


@query("pair_trends", "Q7 V3", f"SELECT col_i, col_j, metric, round(score, 8) AS score FROM {PAIRS}")
def pair_trends(t):
    return quality.pair_trends(real_orders(t), synthetic_orders(t), NUMERIC, CATEGORIES).withColumn("score", F.round("score", 8))


@query("quality_score", "Q8", f"""WITH a AS (SELECT 'Column Shapes' AS property, avg(score) AS score FROM {SHAPES} UNION ALL
  SELECT 'Column Pair Trends', avg(score) FROM {PAIRS}) SELECT property, round(score, 8) AS score FROM a UNION ALL SELECT 'Overall', round(avg(score), 8) FROM a""")
def quality_score(t):
    return quality.quality_score(real_orders(t), synthetic_orders(t), NUMERIC, CATEGORIES).withColumn("score", F.round("score", 8))


def _model_scores(t: Tables) -> DataFrame:
    real = real_orders(t)
    hashed = quality.column_shapes(real, synthetic_orders(t), NUMERIC, CATEGORIES).select("column", F.lit("hashed").alias("model"), "score")
    same = quality.column_shapes(real, real, NUMERIC, CATEGORIES).select("column", F.lit("copy").alias("model"), "score")
    return hashed.unionByName(same)


MODEL_SCORES = f"""(SELECT "column", 'hashed' AS model, score FROM {SHAPES} UNION ALL SELECT DISTINCT "column", 'copy', 1.0 FROM {SHAPES})"""
_WIDE = f"""SELECT "column", max(CASE WHEN model = 'copy' THEN score END) AS "copy", max(CASE WHEN model = 'hashed' THEN score END) AS hashed FROM {MODEL_SCORES} GROUP BY 1"""


@query("score_table", "Q9", f"""SELECT "column", round("copy", 8) AS "copy", round(hashed, 8) AS hashed FROM ({_WIDE}) UNION ALL
SELECT 'Average', round(avg("copy"), 8), round(avg(hashed), 8) FROM ({_WIDE})""")
def score_table(t):
    made = quality.score_table(_model_scores(t), ["copy", "hashed"])
    return made.select("column", F.round("copy", 8).alias("copy"), F.round("hashed", 8).alias("hashed"))


@query("average_row", "F7 Q9", f"""SELECT 'Average' AS "column", round(avg("copy"), 8) AS "copy", round(avg(hashed), 8) AS hashed FROM ({_WIDE})""")
def average_row(t):
    made = quality.average_row(quality.score_table(_model_scores(t), ["copy", "hashed"]))
    return made.select("column", F.round("copy", 8).alias("copy"), F.round("hashed", 8).alias("hashed"))


@query("rank_models", "Q10", f"SELECT model, round(avg(score), 8) AS score FROM {MODEL_SCORES} GROUP BY 1")
def rank_models(t):
    return quality.rank_models(_model_scores(t)).withColumn("score", F.round("score", 8))


@query("merge_scores", "Q11", f"""SELECT "column", model, round(coalesce(a.score, b.score), 8) AS score FROM (SELECT * FROM {MODEL_SCORES} WHERE "column" <> 'o_orderstatus') a
FULL JOIN (SELECT "column", model, score * 0.5 AS score FROM {MODEL_SCORES} WHERE model = 'hashed') b USING ("column", model)""")
def merge_scores(t):
    scores = _model_scores(t)
    first = scores.filter(F.col("column") != "o_orderstatus")
    second = scores.filter(F.col("model") == "hashed").withColumn("score", F.col("score") * 0.5)
    return quality.merge_scores(first, second).withColumn("score", F.round("score", 8))


_HELD = f"{S.md5_uniform('o_orderkey', 'split')} < 0.4"


@query("hash_split", "U1", f"SELECT o_orderkey, CASE WHEN {_HELD} THEN 'test' ELSE 'train' END AS part FROM orders")
def hash_split(t):
    train, test = utility.train_test_split(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("holdout_baseline", "Q12 U1", (f'SELECT "column", metric, round(score, 8) AS score FROM {SHAPES}')
       .replace(SYNTHETIC, "@held").replace(REAL, f"(SELECT * FROM orders WHERE NOT ({_HELD}))").replace("@held", f"(SELECT * FROM orders WHERE {_HELD})"))
def holdout_baseline(t):
    rest, held = quality.holdout_split(real_orders(t), "o_orderkey")
    return quality.column_shapes(rest, held, NUMERIC, CATEGORIES).withColumn("score", F.round("score", 8))


@query("value_counts", "Q13", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t):
    return quality.value_counts(t.orders, "o_orderpriority")


@query("histogram", "Q14", """WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem)
SELECT cast(least(floor((l_extendedprice - lo) / w), 19) as int) AS bin, round(any_value(lo) + least(floor((l_extendedprice - any_value(lo)) / any_value(w)), 19) * any_value(w), 4) AS lo,
  count(*) AS n FROM lineitem, b GROUP BY 1, least(floor((l_extendedprice - lo) / w), 19)""".replace(
    "round(any_value(lo) + least(floor((l_extendedprice - any_value(lo)) / any_value(w)), 19) * any_value(w), 4) AS lo",
    "round(any_value(lo) + least(floor((l_extendedprice - lo) / w), 19) * any_value(w), 4) AS lo"))
def histogram(t):
    return quality.histogram(t.lineitem, "l_extendedprice").select("bin", F.round("lo", 4).alias("lo"), "n")


@query("skewed_histogram", "Q14", """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events)
SELECT cast(least(floor((value - lo) / w), 49) as int) AS bin, count(*) AS n FROM events, b GROUP BY 1""")
def skewed_histogram(t):
    return quality.histogram(t.events, "value", 50).select("bin", "n")


# --------------------------------------------------------------------- utility

@query("hash_sample", "U2", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {S.md5_number('o_orderkey', 'sample')}, o_orderkey LIMIT 5000")
def hash_sample(t):
    return utility.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), 5000, "o_orderkey")


@query("augment_union", "U3", f"""SELECT o_orderkey, o_totalprice, 'real' AS origin FROM {REAL} WHERE NOT ({_HELD}) UNION ALL
SELECT o_orderkey, o_totalprice, 'synthetic' FROM (SELECT o_orderkey, o_totalprice FROM {SYNTHETIC}
  ORDER BY {S.md5_number('o_orderkey', 'sample')}, o_orderkey LIMIT (SELECT cast(round_even(count(*) / 2, 0) as bigint) FROM orders))""")
def augment_union(t):
    columns = ["o_orderkey", "o_totalprice"]
    train, _ = utility.train_test_split(real_orders(t).select(*columns), "o_orderkey")
    return utility.augment(train, synthetic_orders(t).select(*columns), round(t.orders.count() / 2), "o_orderkey")


PREDICTED = "(SELECT l_extendedprice AS y, l_quantity * 2000 + l_tax * 10000 AS yhat FROM lineitem)"


def _predicted(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000 + F.col("l_tax") * 10000).alias("yhat"))


_REGRESSION = f"""SELECT n, round(mae, 4) AS mae, round(mse, 1) AS mse, round(sqrt(mse), 4) AS rmse, round(1 - mse / v, 8) AS r2, round(ape * 100, 6) AS mape{{extra}}
FROM (SELECT count(*) AS n, avg(abs(yhat - y)) AS mae, avg(pow(yhat - y, 2)) AS mse, var_pop(y) AS v, avg(CASE WHEN y <> 0 THEN abs((yhat - y) / y) END) AS ape FROM {PREDICTED})"""
_REGRESSION_DIGITS = {"mae": 4, "mse": 1, "rmse": 4, "r2": 8, "mape": 6, "adjusted_r2": 8}


@query("regression_metrics", "U8", _REGRESSION.format(extra=""))
def regression_metrics(t):
    made = utility.regression_metrics(_predicted(t), "y", "yhat")
    return made.select("n", *[F.round(c, _REGRESSION_DIGITS[c]).alias(c) for c in made.columns if c != "n"])


@query("adjusted_r2", "U9", _REGRESSION.format(extra=", round(1 - (mse / v) * (n - 1) / (n - 2 - 1), 8) AS adjusted_r2"))
def adjusted_r2(t):
    made = utility.regression_metrics(_predicted(t), "y", "yhat", predictors=2)
    return made.select("n", *[F.round(c, _REGRESSION_DIGITS[c]).alias(c) for c in made.columns if c != "n"])


GUESSED = f"(SELECT o_orderstatus AS y, CASE WHEN {_U} < 0.7 THEN o_orderstatus WHEN {_U} < 0.9 THEN 'F' ELSE 'O' END AS yhat FROM orders)"


@query("classification_metrics", "U10", f"""WITH c AS (SELECT y, yhat, count(*) AS n FROM {GUESSED} GROUP BY 1, 2),
k AS (SELECT y, sum(n) AS actual, sum(CASE WHEN y = yhat THEN n ELSE 0 END) AS hit FROM c GROUP BY 1),
g AS (SELECT yhat AS y, sum(n) AS guessed FROM c GROUP BY 1),
m AS (SELECT actual, hit, coalesce(hit / cast(guessed as double), 0) AS p, hit / cast(actual as double) AS r FROM k LEFT JOIN g USING (y))
SELECT round(sum(hit) / cast(sum(actual) as double), 9) AS accuracy, round(sum(actual * p) / sum(actual), 9) AS precision,
  round(sum(actual * r) / sum(actual), 9) AS recall, round(sum(actual * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(actual), 9) AS f1 FROM m""")
def classification_metrics(t):
    u = md5_uniform(F.col("o_orderkey"), "price")
    guessed = t.orders.select(F.col("o_orderstatus").alias("y"), F.when(u < 0.7, F.col("o_orderstatus")).when(u < 0.9, "F").otherwise("O").alias("yhat"))
    made = utility.classification_metrics(guessed, "y", "yhat")
    return made.select(*[F.round(c, 9).alias(c) for c in made.columns])


_AUC_SCORE = "round(l_quantity / 50.0 + l_tax, 2)"
_RANKED = f"""(SELECT k AS class, cast(l_returnflag = k as int) AS pos, CASE k WHEN 'A' THEN {_AUC_SCORE} WHEN 'N' THEN 1 - {_AUC_SCORE} ELSE l_discount END AS score
  FROM lineitem, (SELECT unnest(['A', 'N', 'R']) AS k))"""
_AUC = f"""SELECT class, sum(pos) AS positives, sum(pos * (below + neg / 2.0)) / (sum(pos) * cast(sum(neg) as double)) AS auc FROM (
  SELECT class, pos, neg, sum(neg) OVER (PARTITION BY class ORDER BY score ROWS UNBOUNDED PRECEDING) - neg AS below
  FROM (SELECT class, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM {_RANKED} GROUP BY 1, 2)) GROUP BY 1"""


def _ranked(t: Tables) -> DataFrame:
    score = F.round(F.col("l_quantity") / 50.0 + F.col("l_tax"), 2)
    return t.lineitem.select("l_returnflag", score.alias("s_a"), (1 - score).alias("s_n"), F.col("l_discount").alias("s_r"))


@query("class_auc", "U10", f"SELECT class, cast(positives as bigint) AS positives, round(auc, 8) AS auc FROM ({_AUC})")
def class_auc(t):
    made = utility.class_auc(_ranked(t), "l_returnflag", {"A": "s_a", "N": "s_n", "R": "s_r"})
    return made.select("class", "positives", F.round("auc", 8).alias("auc"))


@query("weighted_gini", "U10", f"SELECT round(a, 8) AS auc, round(2 * a - 1, 8) AS gini FROM (SELECT sum(auc * positives) / sum(positives) AS a FROM ({_AUC}))")
def weighted_gini(t):
    made = utility.gini_score(_ranked(t), "l_returnflag", {"A": "s_a", "N": "s_n", "R": "s_r"})
    return made.select(F.round("auc", 8).alias("auc"), F.round("gini", 8).alias("gini"))


_METRIC_NAMES = ["mean_price", "max_price", "mean_quantity"]
_GROUPED = """(SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS mean_price, max(l_extendedprice) AS max_price, avg(l_quantity) AS mean_quantity
  FROM lineitem GROUP BY 1, 2)"""


def _grouped_metrics(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(
        F.avg("l_extendedprice").alias("mean_price"), F.max("l_extendedprice").alias("max_price"), F.avg("l_quantity").alias("mean_quantity"))


@query("metrics_unpivot", "U11", " UNION ALL ".join(
    f"SELECT l_returnflag, l_linenumber, '{m}' AS metric, round({m}, 5) AS value, 'lines' AS model FROM {_GROUPED}" for m in _METRIC_NAMES))
def metrics_unpivot(t):
    made = utility.melt_metrics(_grouped_metrics(t), ["l_returnflag", "l_linenumber"], _METRIC_NAMES, "lines")
    return made.withColumn("value", F.round("value", 5))


@query("boxplot_summary", "U12", " UNION ALL ".join(
    f"SELECT l_returnflag, '{m}' AS metric, " + ", ".join(f"round(quantile_cont(cast({m} as double), {p}), 5) AS {n}" for n, p in
    (("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0))) + " FROM lineitem GROUP BY l_returnflag" for m in ("l_quantity", "l_extendedprice")))
def boxplot_summary(t):
    long = utility.melt_metrics(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    made = utility.boxplot_summary(long, ["l_returnflag", "metric"])
    return made.select("l_returnflag", "metric", *[F.round(c, 5).alias(c) for c in ("min", "q1", "median", "q3", "max")])


def _learning_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    real = t.part.select("p_partkey", "p_size", "p_type", "p_retailprice")
    model = Synthesizer("parametric_copula", row_id="p_partkey", k=2).fit(real)
    return real, model.sample(t.spark, real.count())


@query("augmentation_experiment", "U4 U6 E11 E13")
def augmentation_experiment(t):
    real, synthetic = _learning_rows(t)
    return utility.augmentation_experiment(real, synthetic, "p_retailprice", "p_partkey")


@query("learning_curve", "U5 G13")
def learning_curve(t):
    real = t.part.select("p_partkey", "p_size", "p_type", "p_retailprice")
    model, n = Synthesizer("parametric_copula", row_id="p_partkey", k=2).fit(real), real.count()
    return utility.learning_curve({s: model.sample(t.spark, s) for s in (n // 2, n)}, real, "p_retailprice", ("p_partkey",))


@query("boosting_utility", "U7 U10 E14")
def boosting_utility(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", F.col("l_linestatus"),
                           (F.col("l_linenumber") > 3).cast("int").alias("late"), "l_orderkey")
    train, test = utility.train_test_split(df, "l_orderkey")
    return utility.evaluate_model(train, test, "late", "classification", ("l_orderkey",), draws=1, folds=2, trees=(5,), rates=(0.1,), depths=(3,), split=(2,), leaf=(1,))


@query("forest_grid", "U6")
def forest_grid(t):
    """Mean absolute error of every point of the forest grid: trees, depth, criterion."""
    df = t.part.select("p_size", "p_type", "p_retailprice")
    return t.spark.createDataFrame(trees.forest_search(df, ["p_size"], ["p_type"], "p_retailprice").scores)


@query("boosting_draws", "U7")
def boosting_draws(t):
    """Accuracy of every draw of the boosting search on three classes of price."""
    tier = F.when(F.col("p_retailprice") < 930, "low").when(F.col("p_retailprice") < 970, "middle").otherwise("high")
    df = t.part.select("p_partkey", "p_size", "p_type", tier.alias("tier"))
    return t.spark.createDataFrame(trees.boosting_search(df, ["p_partkey", "p_size"], ["p_type"], "tier").scores)


@query("synthetic_and_real_test", "U13")
def synthetic_and_real_test(t):
    real, synthetic = _learning_rows(t)
    return utility.synthetic_and_real_test(synthetic, real, "p_retailprice", "p_partkey")


@query("real_only_baseline", "U14")
def real_only_baseline(t):
    real, synthetic = _learning_rows(t)
    return utility.baseline_comparison(real, synthetic, "p_retailprice", "p_partkey")


# ------------------------------------------------------------ sources, timing

@query("csv_roundtrip", "S1 S3 S4", f"SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM ({GAPPY})")
def csv_roundtrip(t):
    """Write orders as CSV and read them back with inferred types."""
    folder = _scratch(t)
    io.write_csv(gappy_orders(t), f"{folder}/orders_csv")
    return io.read_csv(t.spark, f"{folder}/orders_csv").withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


def _scratch(t: Tables) -> str:
    """A fresh folder beside the shared checkpoints, or a temporary one in local mode."""
    import uuid
    context = t.spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/synthframe-{uuid.uuid4().hex}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="synthframe-")


@query("model_save_load", "G2 D12 S3")
def model_save_load(t):
    """Draws from a stored and reloaded model."""
    from synthframe.plans.synthesizer import FittedModel
    model, n = _orders_model(t, "parametric_copula", k=2)
    folder = f"{_scratch(t)}/model"
    model.save(folder)
    return FittedModel.load(t.spark, folder).sample(t.spark, n)


@query("stage_timings", "I1 I2 I3")
def stage_timings(t):
    timer = StageTimer()
    with timer.stage("intervals"):
        intervals = encode.category_intervals(t.orders, CATEGORIES)
        intervals.collect()
    with timer.stage("encode"):
        encode.encode_categories(real_orders(t), CATEGORIES, intervals, "o_orderkey").write.format("noop").mode("overwrite").save()
    with timer.stage("resample", GENERATION):
        generate.resample(t.orders, 1000, "o_orderkey").count()
    return timer.summary(t.spark).unionByName(timer.timings(t.spark).select(F.col("process").alias("phase"), "seconds"))



"""Queries on marginals, copula transforms, dependence and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.rng import md5_uniform
from synthframe.operators import (clustering, copula, dependence, generate, graph, marginals, mixture, spectral)
from synthframe.operators.marginals import Marginal
from synthframe.plans import sqltext as S
from synthframe.plans.queries_prepare import KEY, MEASURES
from synthframe.plans.registry import Tables, query

TESTED = ("norm", "uniform", "expon", "truncnorm")

# Parameters of the example distributions the CDF queries evaluate.
PRICE_NORM = Marginal("l_extendedprice", "norm", 0.0, 110000.0, mean=52000.0, sd=29000.0, sd_sample=29000.0)
PRICE_UNIFORM = Marginal("l_extendedprice", "uniform", 900.0, 105000.0)
PRICE_EXPON = Marginal("l_extendedprice", "expon", 900.0, 105000.0, mean=52000.0)
PRICE_TRUNC = Marginal("l_extendedprice", "truncnorm", 900.0, 105000.0, mean=52000.0, sd=29000.0, sd_sample=29000.0)
PRICE_MIX = Marginal("l_extendedprice", "mixture", 0.0, 110000.0, weights=[0.3, 0.5, 0.2],
                     means=[18000.0, 50000.0, 85000.0], sds=[9000.0, 16000.0, 11000.0])


def embedding_columns(t: Tables, *keep: str) -> tuple[DataFrame, list[str]]:
    """Embeddings with one numeric column per dimension."""
    width = len(t.embeddings.select("embedding").first()[0])
    names = [f"e{i}" for i in range(width)]
    return t.embeddings.select(*keep, *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


# ------------------------------------------------------------------ marginals

def _moments_sql(columns, table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS sd, stddev_samp({c}) AS sd_sample, "
        f"min({c}) AS lo, max({c}) AS hi, skewness({c}) AS skew FROM {table}" for c in columns)


@query("moments_by_column", "D7 P12", f"""SELECT "column", n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(sd_sample, 5) AS sd_sample, lo, hi,
  round(skew, 7) AS skew FROM ({_moments_sql(MEASURES, 'lineitem')})""")
def moments_by_column(t):
    rows = marginals.moments(t.lineitem, MEASURES)
    made = t.spark.createDataFrame([tuple(r[k] for k in ("column", "n", "mean", "sd", "sd_sample", "lo", "hi", "skew")) for r in rows],
                                   "column string, n bigint, mean double, sd double, sd_sample double, lo double, hi double, skew double")
    return made.select("column", "n", *[F.round(c, 5).alias(c) for c in ("mean", "sd", "sd_sample")], "lo", "hi",
                       F.round("skew", 7).alias("skew"))


def _gate_sql(columns, table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT avg(cast({c} = lo as int) + cast({c} = hi as int)) FROM {table}) AS tail, lo, skew FROM
  (SELECT min({c}) AS lo, max({c}) AS hi, skewness({c}) AS skew FROM {table})""" for c in columns)


@query("tail_gate", "D5", f"""SELECT "column", round(tail, 9) AS tail, tail >= 0.05 AS truncated, tail < 0.05 AND lo >= 0 AND skew <= 1 AS beta_allowed
FROM ({_gate_sql(MEASURES, 'lineitem')})""")
def tail_gate(t):
    facts = {(None, m["column"]): m for m in marginals.moments(t.lineitem, MEASURES)}
    marginals.tail_facts(t.lineitem, facts, MEASURES, None)
    rows = [(c, f["tail"], f["tail"] >= 0.05, f["tail"] < 0.05 and f["lo"] >= 0 and f["skew"] <= 1) for (_, c), f in facts.items()]
    made = t.spark.createDataFrame(rows, "column string, tail double, truncated boolean, beta_allowed boolean")
    return made.withColumn("tail", F.round("tail", 9))


def ks_sql(columns, table: str, cluster: str = "0") -> str:
    """KS distances of four families per (cluster, column)."""
    cells = " UNION ALL ".join(f"SELECT {cluster} AS cluster, '{c}' AS \"column\", cast({c} as double) AS value FROM {table}" for c in columns)
    return f"""SELECT cluster, "column", max(greatest(fn - below, upto - fn)) AS norm, max(greatest(fu - below, upto - fu)) AS uniform,
  max(greatest(fe - below, upto - fe)) AS expon, max(greatest(ft - below, upto - ft)) AS truncnorm
FROM (SELECT cluster, "column", below, upto, pz AS fn, (value - lo) / (hi - lo) AS fu, 1 - exp(-(value - lo) / (mean - lo)) AS fe,
    CASE WHEN value <= lo THEN 0.0 WHEN value >= hi THEN 1.0 ELSE (pt - pa) / (pb - pa) END AS ft
  FROM (SELECT *, {S.norm_cdf('z')} AS pz, {S.norm_cdf('zt')} AS pt, {S.norm_cdf('za')} AS pa, {S.norm_cdf('zb')} AS pb
    FROM (SELECT *, (value - mean) / sd AS z, (value - mean) / sds AS zt, (lo - mean) / sds AS za, (hi - mean) / sds AS zb,
        (upc - k) / cast(n as double) AS below, upc / cast(n as double) AS upto
      FROM (SELECT cluster, "column", value, count(*) AS k, sum(count(*)) OVER (PARTITION BY cluster, "column" ORDER BY value) AS upc
        FROM ({cells}) GROUP BY 1, 2, 3)
      JOIN (SELECT cluster, "column", count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, stddev_samp(value) AS sds,
          min(value) AS lo, max(value) AS hi FROM ({cells}) GROUP BY 1, 2) USING (cluster, "column"))))
GROUP BY 1, 2"""


@query("ks_distances", "D6 D8", f"""SELECT "column", round(norm, 7) AS norm, round(uniform, 7) AS uniform, round(expon, 7) AS expon,
  round(truncnorm, 7) AS truncnorm FROM ({ks_sql(MEASURES, 'lineitem')})""")
def ks_distances(t):
    facts = {(None, m["column"]): m for m in marginals.moments(t.lineitem, MEASURES)}
    return (marginals.ks_distances(t.lineitem, facts, MEASURES, TESTED)
            .select("column", *[F.round(f, 7).alias(f) for f in TESTED]))


_PRICES = ["o_totalprice", "o_custkey"]


@query("best_family", "D4 D8", f"""SELECT "column", CASE least(norm, uniform, expon, truncnorm) WHEN norm THEN 'norm' WHEN uniform THEN 'uniform'
  WHEN expon THEN 'expon' ELSE 'truncnorm' END AS family, round(least(norm, uniform, expon, truncnorm), 7) AS distance
FROM ({ks_sql(_PRICES, 'orders')})""")
def best_family(t):
    fitted = marginals.fit_marginals(t.orders, _PRICES, gates=False, allowed=TESTED)
    rows = [(c, m.family, m.distances[m.family]) for (_, c), m in fitted.items()]
    return t.spark.createDataFrame(rows, "column string, family string, distance double").withColumn("distance", F.round("distance", 7))


@query("gated_family", "D5 D7 D8")
def gated_family(t):
    """All five families with the gates; the beta fit has no SQL form."""
    fitted = marginals.fit_marginals(t.lineitem, MEASURES)
    rows = [(c, m.family, m.distances.get(m.family), m.p_value(), m.a, m.b) for (_, c), m in fitted.items()]
    return t.spark.createDataFrame(rows, "column string, family string, distance double, p_value double, a double, b double")


_LOCAL = ["l_quantity", "l_extendedprice"]


@query("family_by_cluster", "D9", f"""SELECT cluster, "column", CASE least(norm, uniform, expon, truncnorm) WHEN norm THEN 'norm' WHEN uniform THEN 'uniform'
  WHEN expon THEN 'expon' ELSE 'truncnorm' END AS family, round(least(norm, uniform, expon, truncnorm), 7) AS distance
FROM ({ks_sql(_LOCAL, 'lineitem', 'l_linenumber')})""")
def family_by_cluster(t):
    fitted = marginals.fit_marginals(t.lineitem, _LOCAL, cluster="l_linenumber", gates=False, allowed=TESTED)
    rows = [(int(g), c, m.family, m.distances[m.family]) for (g, c), m in fitted.items()]
    made = t.spark.createDataFrame(rows, "cluster int, column string, family string, distance double")
    return made.withColumn("distance", F.round("distance", 7))


@query("kernel_density", "D10", """WITH f AS (SELECT count(value) AS n, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
b AS (SELECT value AS m, count(*) AS w FROM events WHERE value IS NOT NULL GROUP BY 1),
g AS (SELECT i, lo + i * (hi - lo) / 100 AS x, sd * pow(n, -0.2) AS h, n FROM f, (SELECT unnest(range(101)) AS i))
SELECT cast(i as int) AS i, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - m) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM g, b GROUP BY i, x""")
def kernel_density(t):
    made = marginals.kernel_density(t.events, "value")
    return made.select("i", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("mixture_candidates", "D1")
def mixture_candidates(t):
    made = mixture.mixture_candidates(t.lineitem, _LOCAL)
    return made.select("column", "k", "bic").distinct().withColumn("bic", F.round("bic", 2))


@query("mixture_fit", "D1 D2 D12")
def mixture_fit(t):
    fitted = mixture.fit_mixtures(t.lineitem, _LOCAL)
    return t.spark.createDataFrame(mixture.mixture_rows(fitted), "column string, component int, weight double, mean double, sd double")


@query("joint_mixture_bic", "D3 K3")
def joint_mixture_bic(t):
    columns = ["l_quantity", "l_discount"]
    fitted = clustering.mixtures_from_kmeans(t.lineitem, columns, range(1, 20))
    rows = [(k, i, float(w), m.bic(), *[float(v) for v in mean]) for k, m in fitted.items()
            for i, (w, mean) in enumerate(zip(m.weights, m.means))]
    return t.spark.createDataFrame(rows, "k int, component int, weight double, bic double, mean_quantity double, mean_discount double")


_MIX_PDF = " + ".join(f"{w / (s * np.sqrt(2 * np.pi))!r} * exp(-0.5 * pow((l_extendedprice - {m}) / {s}, 2))".replace("np.float64(", "").replace(") *", " *")
                      for w, m, s in zip(PRICE_MIX.weights, PRICE_MIX.means, PRICE_MIX.sds))


@query("mixture_density", "D11", f"SELECT {KEY}, round(1000000 * ({_MIX_PDF}), 7) AS density FROM lineitem")
def mixture_density(t):
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(1000000 * mixture.mixture_pdf(F.col("l_extendedprice"), PRICE_MIX), 7).alias("density"))


# -------------------------------------------------------- copula transforms

_Z = ", ".join(f"(l_extendedprice - {m}) / {s} AS z{i}" for i, (m, s) in enumerate(zip(PRICE_MIX.means, PRICE_MIX.sds)))
_MIX_CDF = " + ".join(f"{w} * {S.norm_cdf(f'z{i}')}" for i, w in enumerate(PRICE_MIX.weights))


@query("mixture_cdf", "C1", f"SELECT {KEY}, round({_MIX_CDF}, 8) AS p FROM (SELECT {KEY}, {_Z} FROM lineitem)")
def mixture_cdf(t):
    made = copula.with_cdf(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), {"l_extendedprice": PRICE_MIX})
    return made.select("l_orderkey", "l_linenumber", F.round("__p_l_extendedprice", 8).alias("p"))


@query("mixture_cdf_expression", "C1", f"SELECT {KEY}, round({_MIX_CDF}, 8) AS p FROM (SELECT {KEY}, {_Z} FROM lineitem)")
def mixture_cdf_expression(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(mixture.mixture_cdf(F.col("l_extendedprice"), PRICE_MIX), 8).alias("p"))


def _parametric_sql() -> str:
    return f"""SELECT {KEY}, {S.norm_cdf('z')} AS norm,
  CASE WHEN x <= 900 THEN 0.0 WHEN x >= 105000 THEN 1.0 ELSE (x - 900) / 104100 END AS uniform,
  CASE WHEN x <= 900 THEN 0.0 ELSE 1 - exp(-(x - 900) / 51100) END AS expon,
  CASE WHEN x <= 900 THEN 0.0 WHEN x >= 105000 THEN 1.0 ELSE ({S.norm_cdf('z')} - {PRICE_TRUNC.cdf_lo!r}) / {PRICE_TRUNC.cdf_hi - PRICE_TRUNC.cdf_lo!r} END AS truncnorm
FROM (SELECT {KEY}, l_extendedprice AS x, (l_extendedprice - 52000) / 29000 AS z FROM lineitem)"""


@query("cdf_parametric", "C2", f"""SELECT {KEY}, round({S.clamp('norm')}, 9) AS norm, round({S.clamp('uniform')}, 9) AS uniform,
  round({S.clamp('expon')}, 9) AS expon, round({S.clamp('truncnorm')}, 9) AS truncnorm FROM ({_parametric_sql()})""")
def cdf_parametric(t):
    models = {"norm": PRICE_NORM, "uniform": PRICE_UNIFORM, "expon": PRICE_EXPON, "truncnorm": PRICE_TRUNC}
    x = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col("l_extendedprice").alias(n) for n in models])
    made = copula.cdf_table(x, models)
    return made.select("l_orderkey", "l_linenumber", *[F.round(n, 9).alias(n) for n in models])


@query("cdf_by_cluster", "C3", f"""SELECT {KEY}, round({S.clamp('p')}, 8) AS p FROM (SELECT {KEY}, {S.norm_cdf('z')} AS p FROM (
  SELECT {KEY}, (l_quantity - avg(l_quantity) OVER w) / stddev_pop(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)))""")
def cdf_by_cluster(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    fitted = marginals.fit_marginals(df, ["l_quantity"], cluster="l_linenumber", gates=False, allowed=("norm",))
    made = copula.cluster_cdf(df, ["l_quantity"], fitted, "l_linenumber")
    return made.select("l_orderkey", "l_linenumber", F.round("l_quantity", 8).alias("p"))


@query("scores_by_cluster", "C3 C4")
def scores_by_cluster(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fitted = marginals.fit_marginals(df, _LOCAL, cluster="l_linenumber")
    return copula.cluster_scores(df, _LOCAL, fitted, "l_linenumber")


@query("normal_scores", "C4 C5", f"""SELECT {KEY}, round({S.norm_ppf('pu')}, 7) AS uniform, round({S.norm_ppf('pe')}, 7) AS expon
FROM (SELECT {KEY}, {S.clamp('uniform')} AS pu, {S.clamp('expon')} AS pe FROM ({_parametric_sql()}))""")
def normal_scores(t):
    models = {"uniform": PRICE_UNIFORM, "expon": PRICE_EXPON}
    x = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col("l_extendedprice").alias(n) for n in models])
    made = copula.normal_scores(x, models)
    return made.select("l_orderkey", "l_linenumber", *[F.round(n, 7).alias(n) for n in models])


@query("mixture_scores", "C5 D2 C1 C4")
def mixture_scores(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return copula.normal_scores(df, mixture.fit_mixtures(df, _LOCAL))


@query("mixture_bounds", "C6")
def mixture_bounds(t):
    rows = [(c, *copula.mixture_bounds(m)) for c, m in mixture.fit_mixtures(t.lineitem, _LOCAL).items()]
    return t.spark.createDataFrame(rows, "column string, lower double, upper double")


@query("bound_check", "C7", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p} AS p, -1 AS sign_lower, 1 AS sign_upper" for c in _LOCAL for p in (0.1, 0.5, 0.9)))
def bound_check(t):
    made = copula.bound_check(t.spark, mixture.fit_mixtures(t.lineitem, _LOCAL), [0.1, 0.5, 0.9])
    return made.select("column", "p", "sign_lower", "sign_upper")


_SAME = f"SELECT {KEY}, l_extendedprice AS x FROM lineitem"


@query("quantile_roundtrip", "C2 C9", f"SELECT {KEY}, l_extendedprice AS norm, least(greatest(l_extendedprice, 900.0), 105000.0) AS truncnorm, "
       "least(greatest(l_extendedprice, 900.0), 105000.0) AS uniform, greatest(l_extendedprice, 900.0) AS expon FROM lineitem")
def quantile_roundtrip(t):
    models = {"norm": PRICE_NORM, "uniform": PRICE_UNIFORM, "expon": PRICE_EXPON, "truncnorm": PRICE_TRUNC}
    x = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col("l_extendedprice").alias(n) for n in models])
    back = copula.quantile_table(copula.cdf_table(x, models), models)
    return back.select("l_orderkey", "l_linenumber", *[F.round(n, 2).alias(n) for n in models])


@query("quantile_roundtrip_mixture", "C1 C8", _SAME)
def quantile_roundtrip_mixture(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    return copula.quantile_table(copula.cdf_table(x, {"x": PRICE_MIX}), {"x": PRICE_MIX}).withColumn("x", F.round("x", 2))


@query("quantile_roundtrip_beta", "C2 C9 D7", _SAME)
def quantile_roundtrip_beta(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"))
    fitted = {c: m for (_, c), m in marginals.fit_marginals(x, ["x"], gates=False, allowed=("beta",)).items()}
    back = copula.quantile_table(copula.cdf_table(x, fitted), fitted)
    return back.withColumn("x", F.round("x", 2))


@query("quantile_roundtrip_cluster", "C3 C9", f"SELECT {KEY}, l_quantity, l_extendedprice FROM lineitem")
def quantile_roundtrip_cluster(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fitted = marginals.fit_marginals(df, _LOCAL, cluster="l_linenumber", gates=False, allowed=("norm", "uniform"))
    back = copula.cluster_quantiles(copula.cluster_cdf(df, _LOCAL, fitted, "l_linenumber"), _LOCAL, fitted, "l_linenumber")
    return back.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in _LOCAL])


@query("normal_draws", "C10", f"""SELECT o_orderkey, round(mean + sd * {S.norm_ppf('p')}, 3) AS o_totalprice FROM (SELECT o_orderkey,
  {S.md5_uniform('o_orderkey', 'o_totalprice')} AS p FROM orders), (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders)""")
def normal_draws(t):
    m = marginals.fit_marginals(t.orders, ["o_totalprice"], gates=False, allowed=("norm",))[None, "o_totalprice"]
    made = copula.draw_normal(t.orders.select("o_orderkey"), m, "o_orderkey", uniform=md5_uniform)
    return made.withColumn("o_totalprice", F.round("o_totalprice", 3))


# ------------------------------------------------------------------ dependence

def _matrix_sql(function: str, columns, table: str, group: str = "", digits: int = 6, where: str = "") -> str:
    head = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return " UNION ALL ".join(f"SELECT {head}'{a}' AS col_i, '{b}' AS col_j, round({function}({a}, {b}), {digits}) AS value FROM {table}{where}{tail}"
                              for a in columns for b in columns)


@query("covariance_matrix", "V1", _matrix_sql("covar_samp", MEASURES, "lineitem", digits=4))
def covariance_matrix(t):
    return dependence.covariance(t.lineitem, MEASURES).withColumn("value", F.round("value", 4))


@query("correlation_matrix", "V3", _matrix_sql("corr", MEASURES, "lineitem", digits=8))
def correlation_matrix(t):
    return dependence.correlation(t.lineitem, MEASURES).withColumn("value", F.round("value", 8))


_NOISY = """(SELECT l_linenumber, l_quantity + l_discount * 100 AS l_quantity, l_extendedprice, l_discount + l_tax AS l_discount,
  l_tax * l_linenumber AS l_tax FROM lineitem)"""


def noisy_lineitem(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select("l_linenumber", (c("l_quantity") + c("l_discount") * 100).alias("l_quantity"), "l_extendedprice",
                             (c("l_discount") + c("l_tax")).alias("l_discount"), (c("l_tax") * c("l_linenumber")).alias("l_tax"))


@query("correlation_difference", "V4", f"""SELECT col_i, col_j, round(x.value - y.value, 7) AS value
FROM ({_matrix_sql('corr', MEASURES, 'lineitem', digits=15)}) x JOIN ({_matrix_sql('corr', MEASURES, _NOISY, digits=15)}) y USING (col_i, col_j)""")
def correlation_difference(t):
    made = dependence.matrix_difference(dependence.correlation(t.lineitem, MEASURES), dependence.correlation(noisy_lineitem(t), MEASURES))
    return made.withColumn("value", F.round("value", 7))


@query("target_correlation", "V5", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(corr({c}, l_extendedprice), 8) AS correlation FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def target_correlation(t):
    made = dependence.target_correlation(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return made.withColumn("correlation", F.round("correlation", 8))


@query("cluster_covariance", "V2", _matrix_sql("covar_samp", MEASURES, "lineitem", "l_linenumber", digits=4))
def cluster_covariance(t):
    return dependence.covariance(t.lineitem, MEASURES, "l_linenumber").withColumn("value", F.round("value", 4))


_DIMS = "(SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query("wide_correlation", "V3 F13", f"""SELECT 'e' || x.i AS col_i, 'e' || y.i AS col_j, round(corr(cast(x.v as double), cast(y.v as double)), 7) AS value
FROM {_DIMS} x JOIN {_DIMS} y USING (vec_id) GROUP BY x.i, y.i""")
def wide_correlation(t):
    df, names = embedding_columns(t)
    return dependence.correlation(df, names).withColumn("value", F.round("value", 7))


@query("wide_cluster_covariance", "V2", f"""SELECT x.label AS label, 'e' || x.i AS col_i, 'e' || y.i AS col_j,
  round(covar_samp(cast(x.v as double), cast(y.v as double)), 9) AS value FROM {_DIMS} x JOIN {_DIMS} y USING (vec_id) GROUP BY x.label, x.i, y.i""")
def wide_cluster_covariance(t):
    df, names = embedding_columns(t, "label")
    return dependence.covariance(df, names, "label").withColumn("value", F.round("value", 9))


@query("cholesky_product", "V6", _matrix_sql("covar_samp", MEASURES, "lineitem", digits=3))
def cholesky_product(t):
    """L times its transpose gives the covariance back."""
    factor = dependence.cholesky_factor(dependence.covariance_matrix(t.lineitem, MEASURES))
    back = factor @ factor.T
    rows = [(a, b, float(back[i, j])) for i, a in enumerate(MEASURES) for j, b in enumerate(MEASURES)]
    return t.spark.createDataFrame(rows, "col_i string, col_j string, value double").withColumn("value", F.round("value", 3))


@query("eigenvalues", "V7")
def eigenvalues(t):
    df, names = embedding_columns(t)
    values = dependence.eigenvalues(dependence.covariance_matrix(df, names))
    drops = [None, *[float(v) for v in dependence.relative_drops(values)]]
    return t.spark.createDataFrame([(i, float(v), d) for i, (v, d) in enumerate(zip(values, drops))],
                                   "position int, eigenvalue double, relative_drop double")


# ------------------------------------------------------------------ clustering

@query("kmeans_labels", "K1 K2")
def kmeans_labels(t):
    df, names = embedding_columns(t, "vec_id")
    labelled, _ = clustering.kmeans_labels(df, names, 10)
    return labelled.select("vec_id", "cluster")


@query("cluster_summary", "K19", " UNION ALL ".join(
    f"SELECT p_type, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(cast(median({c}) as double), 6) AS median, "
    f"round(stddev_samp({c}), 6) AS sd FROM part GROUP BY p_type" for c in ("p_size", "p_retailprice")))
def cluster_summary(t):
    made = clustering.cluster_summary(t.part, ["p_size", "p_retailprice"], "p_type")
    return made.select("p_type", "column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "sd")])


_CENTRES = f"(SELECT label, i, avg(cast(v as double)) AS c FROM {_DIMS} GROUP BY label, i)"
_SPREAD = f"""(SELECT label, count(*) AS size, avg(d) AS spread FROM (SELECT vec_id, x.label AS label, sqrt(sum(pow(cast(v as double) - c, 2))) AS d
  FROM {_DIMS} x JOIN {_CENTRES} y ON x.label = y.label AND x.i = y.i GROUP BY vec_id, x.label) GROUP BY label)"""


@query("cluster_spread", "K8", f"SELECT label, size, round(spread, 8) AS spread FROM {_SPREAD}")
def cluster_spread(t):
    df, names = embedding_columns(t, "label")
    return clustering.cluster_spread(df, names, "label").select("label", "size", F.round("spread", 8).alias("spread"))


@query("davies_bouldin", "K8", f"""SELECT round(avg(worst), 7) AS score FROM (SELECT a.label, max((a.spread + b.spread) / d) AS worst
FROM (SELECT x.label AS p, y.label AS q, sqrt(sum(pow(x.c - y.c, 2))) AS d FROM {_CENTRES} x JOIN {_CENTRES} y ON x.i = y.i AND x.label <> y.label GROUP BY 1, 2)
JOIN {_SPREAD} a ON a.label = p JOIN {_SPREAD} b ON b.label = q GROUP BY a.label)""")
def davies_bouldin(t):
    df, names = embedding_columns(t, "label")
    return t.spark.createDataFrame([(round(clustering.davies_bouldin(df, names, "label"), 7),)], "score double")


def _scores(t: Tables, scores: dict, chosen: int) -> DataFrame:
    return t.spark.createDataFrame([(int(k), float(v), k == chosen) for k, v in scores.items()], "k int, score double, chosen boolean")


@query("elbow_k", "K6")
def elbow_k(t):
    df, names = embedding_columns(t)
    k, costs = clustering.elbow_k(df, names)
    return _scores(t, costs, k)


@query("silhouette_k", "K7")
def silhouette_k(t):
    df, names = embedding_columns(t)
    k, scores = clustering.silhouette_k(df, names)
    return _scores(t, scores, k)


@query("davies_bouldin_path", "K8")
def davies_bouldin_path(t):
    df, names = embedding_columns(t)
    scores = clustering.davies_bouldin_path(df, names, range(2, 11))
    return _scores(t, scores, min(scores, key=scores.get))


@query("gap_statistic", "K9")
def gap_statistic(t):
    df, names = embedding_columns(t)
    scores = clustering.gap_statistic(df, names)
    return _scores(t, scores, max(scores, key=scores.get))


@query("eigen_gap_k", "K4 K5 V7")
def eigen_gap_k(t):
    df, names = embedding_columns(t)
    k, _, _ = clustering.eigen_gap_k(df, names)
    return t.spark.createDataFrame([("percentile", k), ("largest_drop", clustering.largest_drop_k(df, names))], "rule string, k int")


@query("cluster_count_methods", "K10")
def cluster_count_methods(t):
    return clustering.compare_cluster_counts(t.part, ["p_size", "p_retailprice"])


@query("cluster_count_timings", "K11 I1")
def cluster_count_timings(t):
    df, names = embedding_columns(t)
    return clustering.time_cluster_counts({"two_columns": (df, names[:2]), "all_columns": (df, names)})


@query("mixtures_in_clusters", "K17 K18")
def mixtures_in_clusters(t):
    columns = ["l_quantity", "l_extendedprice"]
    labelled = t.lineitem.select(F.col("l_linenumber").alias("cluster"), *columns)
    fitted = clustering.cluster_mixtures(labelled, columns, max_components=15, by_bic=True)
    rows = [(int(g), i, float(w), *[float(v) for v in mean]) for g, m in fitted.items() for i, (w, mean) in enumerate(zip(m.weights, m.means))]
    return t.spark.createDataFrame(rows, "cluster int, component int, weight double, l_quantity double, l_extendedprice double")


# ------------------------------------------------------------ spectral variant

_CENTROID_DISTANCE = f"""SELECT vec_id, y.label AS centre, exp(-5.0 * sum(pow(cast(v as double) - c, 2))) AS weight
  FROM {_DIMS} x JOIN {_CENTRES} y ON x.i = y.i GROUP BY vec_id, y.label"""


def _centroids(t: Tables) -> tuple[DataFrame, list[str], np.ndarray, list[int]]:
    df, names = embedding_columns(t, "vec_id", "label")
    rows = df.groupBy("label").agg(*[F.avg(c).alias(c) for c in names]).orderBy("label").collect()
    return df, names, np.array([[r[c] for c in names] for r in rows]), [r["label"] for r in rows]


@query("landmark_affinity", "K12", f"SELECT vec_id, centre, round(weight, 10) AS weight FROM ({_CENTROID_DISTANCE})")
def landmark_affinity(t):
    df, names, centres, labels = _centroids(t)
    made = spectral.landmark_affinities(df, names, centres)
    cells = F.array(*[F.struct(F.lit(g).alias("centre"), F.col("affinity")[i].alias("weight")) for i, g in enumerate(labels)])
    return (made.select("vec_id", F.explode(cells).alias("c"))
            .select("vec_id", "c.centre", F.round("c.weight", 10).alias("weight")))


_EDGES = f"""SELECT x.label AS src, y.label AS dst, exp(-5.0 * sum(pow(x.c - y.c, 2))) AS weight
  FROM {_CENTRES} x JOIN {_CENTRES} y ON x.i = y.i GROUP BY 1, 2"""


@query("graph_laplacian", "K13", f"""WITH e AS (SELECT * FROM ({_EDGES}) WHERE src <> dst)
SELECT src, dst, round(-weight, 10) AS value FROM e UNION ALL SELECT src, src, round(sum(weight), 10) FROM e GROUP BY src""")
def graph_laplacian(t):
    """Laplacian of the class-centroid graph."""
    df, names, centres, labels = _centroids(t)
    table = df.groupBy(F.col("label").alias("src")).agg(*[F.avg(c).alias(c) for c in names])
    made = spectral.landmark_affinities(table, names, centres)
    cells = F.array(*[F.struct(F.lit(g).alias("dst"), F.col("affinity")[i].alias("weight")) for i, g in enumerate(labels)])
    edges = made.select("src", F.explode(cells).alias("c")).select("src", "c.*")
    return spectral.laplacian_edges(edges).withColumn("value", F.round("value", 10))


#: Kernel weights below this have no edge in the graph of the embeddings.
_EMBEDDING_FLOOR = 1e-4

_NEIGHBOURS = f"""(SELECT x.vec_id AS src, y.vec_id AS dst, exp(-5.0 * pow(list_distance(x.e, y.e), 2)) AS weight
  FROM (SELECT vec_id, list_transform(embedding, lambda v: cast(v AS double)) AS e FROM embeddings) x
  JOIN (SELECT vec_id, list_transform(embedding, lambda v: cast(v AS double)) AS e FROM embeddings) y ON x.vec_id <> y.vec_id
  WHERE pow(list_distance(x.e, y.e), 2) <= {graph.radius_of(_EMBEDDING_FLOOR) ** 2!r})"""


def _embedding_graph(t: Tables) -> tuple[DataFrame, graph.Graph]:
    df, names = embedding_columns(t, "vec_id")
    return df, graph.build(df, names, floor=_EMBEDDING_FLOOR)


@query("neighbour_edges", "K12", f"SELECT src, dst, round(weight, 10) AS weight FROM {_NEIGHBOURS}")
def neighbour_edges(t):
    """Edges of every two vectors whose kernel is not negligible."""
    x = t.embeddings.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    edges = graph.neighbour_edges(x, "vec_id", len(x.select("x").first()[0]), _EMBEDDING_FLOOR)
    return edges.select("src", "dst", F.round("weight", 10).alias("weight"))


@query("spectral_degrees", "K13", f"""SELECT e.vec_id, round(coalesce(sum(weight), 0), 9) AS degree
FROM embeddings e LEFT JOIN {_NEIGHBOURS} ON src = e.vec_id GROUP BY e.vec_id""")
def spectral_degrees(t):
    df, made = _embedding_graph(t)
    return graph.row_degrees(df, made).select("vec_id", F.round("degree", 9).alias("degree"))


@query("spectral_gap_k", "K14")
def spectral_gap_k(t):
    _, made = _embedding_graph(t)
    k, certain = graph.eigen_gap(made)
    return t.spark.createDataFrame([(k, certain)], "k int, certain boolean")


@query("spectral_embedding", "K15")
def spectral_embedding(t):
    df, made = _embedding_graph(t)
    found = spectral.spectral_embedding(df, made, 4)
    return found.select("vec_id", *[c for c in found.columns if c.startswith("spectral_")])


@query("spectral_labels", "K16 K12")
def spectral_labels(t):
    df, names = embedding_columns(t, "vec_id")
    labelled, _ = spectral.spectral_labels(df, names, 4, floor=_EMBEDDING_FLOOR)
    return labelled.select("vec_id", "cluster")


# -------------------------------------------------------------- exact sampling

_FACTOR = np.array([[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [-0.3, 0.4, 0.8660254037844386]])
_NAMES = ["a", "b", "c"]


def _draws_sql() -> str:
    p = ", ".join(f"{S.md5_uniform('o_orderkey', f'normal:{c}')} AS p{i}" for i, c in enumerate(_NAMES))
    v = ", ".join(f"{S.norm_ppf(f'p{i}')} AS v{i}" for i in range(3))
    u = ", ".join(" + ".join(f"{float(_FACTOR[i, j])!r} * v{j}" for j in range(i + 1)) + f" AS u{i}" for i in range(3))
    return f"SELECT o_orderkey, {u} FROM (SELECT o_orderkey, {v} FROM (SELECT o_orderkey, {p} FROM orders))"


@query("correlated_normals", "G1 G6", f"SELECT o_orderkey, round(u0, 7) AS a, round(u1, 7) AS b, round(u2, 7) AS c FROM ({_draws_sql()})")
def correlated_normals(t):
    made = generate.correlated_normals(t.orders.select("o_orderkey"), _NAMES, np.zeros(3), _FACTOR, "o_orderkey", uniform=md5_uniform)
    return made.select("o_orderkey", *[F.round(c, 7).alias(c) for c in _NAMES])


@query("copula_draws", "G1 C9", f"""SELECT o_orderkey, round(52000 + 29000 * u0, 2) AS a, round(900 + 104100 * p1, 2) AS b, round(900 - 51100 * ln(1 - p2), 2) AS c
FROM (SELECT o_orderkey, u0, {S.norm_cdf('u1')} AS p1, {S.norm_cdf('u2')} AS p2 FROM ({_draws_sql()}))""")
def copula_draws(t):
    from synthframe.functions.special import norm_cdf
    z = generate.correlated_normals(t.orders.select("o_orderkey"), _NAMES, np.zeros(3), _FACTOR, "o_orderkey", uniform=md5_uniform)
    p = z.select("o_orderkey", *[norm_cdf(F.col(c)).alias(c) for c in _NAMES])
    made = copula.quantile_table(p, {"a": PRICE_NORM, "b": PRICE_UNIFORM, "c": PRICE_EXPON})
    return made.select("o_orderkey", *[F.round(c, 2).alias(c) for c in _NAMES])


@query("mixture_draws", "G9", f"""SELECT o_orderkey, cast(k as int) AS component, round(CASE k WHEN 0 THEN 18000 + 9000 * z WHEN 1 THEN 50000 + 16000 * z ELSE 85000 + 11000 * z END, 3) AS x
FROM (SELECT o_orderkey, cast(c >= 0.3 as int) + cast(c >= 0.8 as int) AS k, {S.norm_ppf('p')} AS z FROM (SELECT o_orderkey,
  {S.md5_uniform('o_orderkey', 'component')} AS c, {S.md5_uniform('o_orderkey', 'mixture')} AS p FROM orders))""")
def mixture_draws(t):
    from synthframe.functions.special import with_norm_ppf
    key = F.col("o_orderkey")
    k = generate.component_pick(key, PRICE_MIX.weights, uniform=md5_uniform)
    z = with_norm_ppf(t.orders.select(key, k.alias("component")), {"z": md5_uniform(key, "mixture")})
    mean = F.get(F.array(*[F.lit(m) for m in PRICE_MIX.means]), F.col("component"))
    sd = F.get(F.array(*[F.lit(s) for s in PRICE_MIX.sds]), F.col("component"))
    return z.select("o_orderkey", "component", F.round(mean + sd * F.col("z"), 3).alias("x"))

"""Distribution functions, normal scores and quantiles of fitted tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthframe.functions import special
from synthframe.functions.rng import hash_uniform
from synthframe.functions.special import CLAMP, clamp_unit
from synthframe.operators.marginals import (BETA_EPSILON, CONSTANT, MIXTURE, PARAMETERS, Marginal,
                                            family_cdf, standard_term)
from synthframe.operators.mixture import mixture_cdf

TABLE_POINTS = 4096
NATIVE_QUANTILES = ("norm", "uniform", "expon", "truncnorm", CONSTANT)


def marginal_cdf(x: Column, m: Marginal) -> Column:
    """Distribution function of a fitted marginal as a Column."""
    x = x.cast("double")
    if m.family == MIXTURE:
        return mixture_cdf(x, m)
    return family_cdf(m.family, x, lambda name: F.lit(float(getattr(m, name))))


def with_cdf(df: DataFrame, marginals: dict[str, Marginal]) -> DataFrame:
    """Add `__p_<column>`, the CDF value under each fitted marginal.

    Parametric families are Column expressions over a bound standardised value.  All
    mixture columns share one Arrow pass: a sum of up to 19 polynomials per column
    would outgrow a generated method.
    """
    mixed = [c for c, m in marginals.items() if m.family == MIXTURE]
    plain = {c: m for c, m in marginals.items() if m.family != MIXTURE}

    def literal(m: Marginal):
        return lambda name: F.lit(float(getattr(m, name)))

    terms = {c: standard_term(m.family, F.col(c).cast("double"), literal(m)) for c, m in plain.items()}
    out = df.select("*", *[z.alias(f"__z_{c}") for c, z in terms.items() if z is not None])
    if mixed:
        cells = F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(mixed)])
        out = out.withColumn("__mixed", mixture_probabilities([marginals[c] for c in mixed])(cells))
    made = {c: family_cdf(m.family, F.col(c).cast("double"), literal(m),
                          F.col(f"__z_{c}") if terms[c] is not None else None) for c, m in plain.items()}
    made.update({c: F.col(f"__mixed.c{i}") for i, c in enumerate(mixed)})
    return out.select(*df.columns, *[made[c].alias(f"__p_{c}") for c in marginals])


def mixture_probabilities(models: Sequence[Marginal]):
    """C1 as one Arrow function over a struct of columns c0, c1, ...; null stays null."""
    names = [f"c{i}" for i in range(len(models))]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def probabilities(cells: pd.DataFrame) -> pd.DataFrame:
        out = {}
        for n, m in zip(names, models):
            x = cells[n].to_numpy(dtype=float)
            out[n] = pd.Series(np.where(np.isnan(x), np.nan, np_mixture_cdf(x, m))).astype(object).where(~np.isnan(x), None)
        return pd.DataFrame(out)

    return probabilities


def cdf_table(df: DataFrame, marginals: dict[str, Marginal]) -> DataFrame:
    """Every fitted column replaced by its clamped CDF value."""
    return with_cdf(df, marginals).select(*[clamp_unit(F.col(f"__p_{c}")).alias(c) if c in marginals
                                            else F.col(c) for c in df.columns])


def normal_scores(df: DataFrame, marginals: dict[str, Marginal]) -> DataFrame:
    """Every fitted column replaced by its normal score."""
    scored = special.with_norm_ppf(with_cdf(df, marginals), {f"__s_{c}": F.col(f"__p_{c}") for c in marginals}, clamp=True)
    return scored.select(*[F.col(f"__s_{c}").alias(c) if c in marginals else F.col(c) for c in df.columns])


def cluster_cdf(df: DataFrame, columns: Sequence[str], fitted: dict, cluster: str) -> DataFrame:
    """CDF of each row under its cluster's marginals; a constant column gives 0.5.

    Parameters travel as one broadcast row per cluster; each column evaluates only
    the families it uses.
    """
    labels = sorted({g for g, _ in fitted})
    rows = [(g, *[v for c in columns for v in (fitted[g, c].family,
             *[float(getattr(fitted[g, c], p)) or (1.0 if p.startswith("sd") else 0.0) for p in PARAMETERS])]) for g in labels]
    label_type = df.schema[cluster].dataType.simpleString()
    schema = f"`{cluster}` {label_type}" + "".join(
        f", __family_{i} string" + "".join(f", __{p}_{i} double" for p in PARAMETERS)
        for i in range(len(columns)))
    joined = df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), cluster)

    families = {c: sorted({fitted[g, c].family for g in labels}) for c in columns}
    terms = {(c, f): standard_term(f, F.col(c).cast("double"), lambda name, i=i: F.col(f"__{name}_{i}"))
             for i, c in enumerate(columns) for f in families[c]}
    bound = joined.select("*", *[z.alias(f"__z_{f}_{c}") for (c, f), z in terms.items() if z is not None])

    def cdf(i: int, c: str) -> Column:
        value = F.lit(None).cast("double")
        for f in families[c]:
            z = F.col(f"__z_{f}_{c}") if terms[c, f] is not None else None
            at = family_cdf(f, F.col(c).cast("double"), lambda name: F.col(f"__{name}_{i}"), z)
            value = F.when(F.col(f"__family_{i}") == f, at).otherwise(value)
        return value.alias(c)

    made = {c: cdf(i, c) for i, c in enumerate(columns)}
    raw = bound.select(*[made.get(c, F.col(c)) for c in df.columns])
    return raw.select(*[clamp_unit(F.col(c)).alias(c) if c in made else F.col(c) for c in df.columns])


def cluster_scores(df: DataFrame, columns: Sequence[str], fitted: dict, cluster: str) -> DataFrame:
    """C3 then C4: normal scores under each row's cluster."""
    cdf = cluster_cdf(df, columns, fitted, cluster)
    scored = special.with_norm_ppf(cdf, {f"__s_{c}": F.col(c) for c in columns})
    return scored.select(*[F.col(f"__s_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ quantiles

def mixture_bounds(m: Marginal, deviations: float = 3.0) -> tuple[float, float]:
    """Interval that holds the mixture's bulk."""
    return (min(mu - deviations * s for mu, s in zip(m.means, m.sds)),
            max(mu + deviations * s for mu, s in zip(m.means, m.sds)))


def bound_check(spark: SparkSession, marginals: dict[str, Marginal], probabilities: Sequence[float]) -> DataFrame:
    """Sign of CDF(bound) - p at both bounds for each column and probability."""
    rows = []
    for c, m in marginals.items():
        bounds = mixture_bounds(m)
        low, high = np_mixture_cdf(np.array(bounds), m)
        rows += [(c, float(p), *bounds, int(np.sign(low - p)), int(np.sign(high - p))) for p in probabilities]
    return spark.createDataFrame(rows, "column string, p double, lower double, upper double, sign_lower int, sign_upper int")


def np_mixture_cdf(x: np.ndarray, m: Marginal) -> np.ndarray:
    return sum(w * special.np_norm_cdf((x - mu) / s) for w, mu, s in zip(m.weights, m.means, m.sds))


def np_quantile(m: Marginal, p: np.ndarray) -> np.ndarray:
    """Vectorised quantile of any fitted family, for Arrow batches."""
    p = np.clip(p, CLAMP, 1 - CLAMP)
    if m.family == CONSTANT:
        return np.full(len(p), m.lo)
    if m.family == "norm":
        return m.mean + m.sd * special.np_norm_ppf(p)
    if m.family == "uniform":
        return m.lo + (m.hi - m.lo) * p
    if m.family == "expon":
        return m.lo - (m.mean - m.lo) * np.log1p(-p)
    if m.family == "truncnorm":
        inside = m.cdf_lo + p * (m.cdf_hi - m.cdf_lo)
        return np.clip(m.mean + m.sd_sample * special.np_norm_ppf(inside), m.lo, m.hi)
    if m.family == "beta":
        return (m.lo - BETA_EPSILON
                + (m.hi - m.lo + 2 * BETA_EPSILON) * special.np_beta_ppf(p, m.a, m.b))
    return _mixture_quantile(m, p)


def _mixture_quantile(m: Marginal, p: np.ndarray) -> np.ndarray:
    """Lookup in a monotone (x, CDF) table, then safeguarded Newton steps."""
    lo, hi = mixture_bounds(m, 7.0)
    knots = np.unique(np.concatenate(
        [np.linspace(lo, hi, TABLE_POINTS // 2)]
        + [mu + s * np.linspace(-7, 7, TABLE_POINTS // (2 * len(m.means)) + 2) for mu, s in zip(m.means, m.sds)]))
    table = np.maximum.accumulate(np_mixture_cdf(knots, m))
    cell = np.clip(np.searchsorted(table, p), 1, len(knots) - 1)
    left, right = knots[cell - 1], knots[cell]
    fl, fr = table[cell - 1], table[cell]
    x = left + (right - left) * np.clip((p - fl) / np.maximum(fr - fl, 1e-300), 0, 1)
    for _ in range(3):
        slope = sum(w / (s * math.sqrt(2 * math.pi)) * np.exp(-0.5 * ((x - mu) / s) ** 2)
                    for w, mu, s in zip(m.weights, m.means, m.sds))
        step = (np_mixture_cdf(x, m) - p) / np.maximum(slope, 1e-300)
        x = np.clip(x - step, left, right)
    return x


def table_quantiles(columns: Sequence[str], fitted: dict, clustered: bool):
    """One Arrow function for all columns that need a table.

    Takes a struct of the cluster label (if any) and one probability per column.
    """
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])

    @F.pandas_udf(schema)
    def quantiles(cells: pd.DataFrame) -> pd.DataFrame:
        out = {c: np.empty(len(cells)) for c in columns}
        labels = cells["__label"].to_numpy() if clustered else np.zeros(len(cells))
        for label in np.unique(labels):
            rows = labels == label
            for c in columns:
                model = fitted[int(label), c] if clustered else fitted[c]
                out[c][rows] = np_quantile(model, cells[c].to_numpy()[rows])
        return pd.DataFrame(out)

    return quantiles


def quantile_table(df: DataFrame, marginals: dict[str, Marginal]) -> DataFrame:
    """Every fitted column of probabilities replaced by its quantile.

    Normal, uniform, exponential and truncated normal stay Column expressions;
    mixtures and beta share one Arrow pass.
    """
    native = {c: m for c, m in marginals.items() if m.family in NATIVE_QUANTILES}
    tables = [c for c in marginals if c not in native]
    p = {c: clamp_unit(F.col(c)) for c in marginals}
    inner = {}
    for c, m in native.items():
        if m.family == "norm":
            inner[f"__z_{c}"] = p[c]
        if m.family == "truncnorm":
            inner[f"__z_{c}"] = F.lit(m.cdf_lo) + p[c] * F.lit(m.cdf_hi - m.cdf_lo)
    out = special.with_norm_ppf(df, inner) if inner else df
    if tables:
        cells = F.struct(*[clamp_unit(F.col(c)).alias(c) for c in tables])
        out = out.withColumn("__q", table_quantiles(tables, {c: marginals[c] for c in tables}, False)(cells))

    def value(c: str) -> Column:
        m = native.get(c)
        if m is None:
            return F.col(f"__q.{c}") if c in tables else F.col(c)
        if m.family == CONSTANT:
            return F.lit(float(m.lo))
        if m.family == "uniform":
            return F.lit(m.lo) + F.lit(m.hi - m.lo) * p[c]
        if m.family == "expon":
            return F.lit(m.lo) - F.lit(m.mean - m.lo) * F.log1p(-p[c])
        if m.family == "norm":
            return F.lit(m.mean) + F.lit(m.sd) * F.col(f"__z_{c}")
        inside = F.least(F.greatest(F.lit(m.mean) + F.lit(m.sd_sample) * F.col(f"__z_{c}"), F.lit(m.lo)), F.lit(m.hi))
        return F.when(F.col(f"__z_{c}").isNotNull(), inside)

    return out.select(*[value(c).alias(c) for c in df.columns])


def cluster_quantiles(df: DataFrame, columns: Sequence[str], fitted: dict, cluster: str) -> DataFrame:
    """C9 under each row's cluster: one Arrow pass over all columns."""
    cells = F.struct(F.col(cluster).alias("__label"), *[clamp_unit(F.col(c)).alias(c) for c in columns])
    out = df.withColumn("__q", table_quantiles(list(columns), fitted, True)(cells))
    return out.select(*[F.col(f"__q.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def draw_normal(df: DataFrame, m: Marginal, row_id: str, seed: int = 0, uniform=hash_uniform) -> DataFrame:
    """Independent draws from one fitted normal, one per row id."""
    z = special.with_norm_ppf(df, {"__z": uniform(F.col(row_id), m.column, seed)})
    return z.withColumn(m.column, F.lit(m.mean) + F.lit(m.sd) * F.col("__z")).drop("__z")

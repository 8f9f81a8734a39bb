"""Parametric marginals: moments, family choice and goodness of fit."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from synthframe.functions import special
from synthframe.functions.frames import spread
from synthframe.functions.scan import ROWS_PER_BUCKET

# The candidate families, in the order that settles ties.
FAMILIES = ("norm", "uniform", "beta", "expon", "truncnorm")
CONSTANT, MIXTURE = "constant", "mixture"
TRUNCATION_SHARE = 0.05
TRUNCATION_SHARE_IN_CLUSTER = 0.07
BETA_EPSILON = 1e-10


@dataclass
class Marginal:
    """A fitted distribution of one column, or of one column within a cluster."""

    column: str
    family: str
    lo: float
    hi: float
    mean: float = 0.0
    sd: float = 0.0
    sd_sample: float = 0.0
    a: float = 1.0
    b: float = 1.0
    weights: list[float] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    sds: list[float] = field(default_factory=list)
    n: int = 0
    distances: dict[str, float] = field(default_factory=dict)

    @property
    def cdf_lo(self) -> float:
        """Normal probability of the lower end, for the truncated family."""
        return self._end(self.lo)

    @property
    def cdf_hi(self) -> float:
        return self._end(self.hi)

    def _end(self, x: float) -> float:
        return float(special.np_norm_cdf((x - self.mean) / self.sd_sample)) if self.sd_sample else 0.0

    def p_value(self) -> float:
        """Asymptotic Kolmogorov p-value of the chosen family."""
        return special.kolmogorov_sf(self.distances.get(self.family, 0.0), max(self.n, 1))


def corrected_skewness(c: Column) -> Column:
    """Bias-corrected skewness; Spark's own is the population form."""
    n = F.count(c)
    g1 = F.skewness(c)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * g1)


def corrected_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(c)
    g2 = F.kurtosis(c)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6))


def moments(df: DataFrame, columns: Sequence[str], cluster: str | None = None) -> list[dict]:
    """N, mean, both deviations, range and skewness per (cluster, column).

    One wide aggregate; at most clusters x columns rows reach the driver.
    """
    parts = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                  F.stddev_pop(x).alias(f"sd{i}"), F.stddev_samp(x).alias(f"sds{i}"),
                  F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"),
                  corrected_skewness(x).alias(f"skew{i}")]
    rows = (df.groupBy(cluster) if cluster else df.groupBy()).agg(*parts).collect()
    return [{"cluster": r[cluster] if cluster else None, "column": c, "n": r[f"n{i}"],
             "mean": r[f"mean{i}"], "sd": r[f"sd{i}"], "sd_sample": r[f"sds{i}"],
             "lo": r[f"lo{i}"], "hi": r[f"hi{i}"], "skew": r[f"skew{i}"]}
            for r in rows for i, c in enumerate(columns)]


def _with_facts(df: DataFrame, facts: dict, columns: Sequence[str], names: Sequence[str],
                cluster: str | None) -> tuple[DataFrame, dict]:
    """Per-column constants as literals, or joined per cluster (one row per cluster)."""
    if cluster is None:
        return df, {(c, k): F.lit(facts[None, c][k]) for c in columns for k in names}
    labels = sorted({g for g, _ in facts})
    rows = [(g, *[facts[g, c][k] for c in columns for k in names]) for g in labels]
    made = [f"__{k}_{i}" for i in range(len(columns)) for k in names]
    label_type = df.schema[cluster].dataType.simpleString()
    table = df.sparkSession.createDataFrame(
        rows, f"`{cluster}` {label_type}, " + ", ".join(f"{m} double" for m in made))
    joined = df.join(F.broadcast(table), cluster)
    return joined, {(c, k): F.col(f"__{k}_{i}") for i, c in enumerate(columns) for k in names}


def unit_scaled(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling kept off 0 and 1, as the beta family needs."""
    return (x - lo + BETA_EPSILON) / (hi - lo + 2 * BETA_EPSILON)


def tail_facts(df: DataFrame, facts: dict, columns: Sequence[str], cluster: str | None) -> None:
    """Share of rows at the range ends and mean logs for the beta fit (second pass)."""
    joined, k = _with_facts(df, facts, columns, ("lo", "hi"), cluster)
    parts = []
    for i, c in enumerate(columns):
        x, lo, hi = F.col(c).cast("double"), k[c, "lo"], k[c, "hi"]
        u = unit_scaled(x, lo, hi)
        parts += [F.avg((x == lo).cast("double") + (x == hi).cast("double")).alias(f"tail{i}"),
                  F.avg(F.log(u)).alias(f"ln{i}"), F.avg(F.log(1 - u)).alias(f"l1{i}"),
                  F.avg(u).alias(f"um{i}"), F.var_pop(u).alias(f"uv{i}")]
    for r in (joined.groupBy(cluster) if cluster else joined.groupBy()).agg(*parts).collect():
        for i, c in enumerate(columns):
            facts[r[cluster] if cluster else None, c].update(
                tail=r[f"tail{i}"], log_u=r[f"ln{i}"], log_1u=r[f"l1{i}"],
                u_mean=r[f"um{i}"], u_var=r[f"uv{i}"])


def fit_beta(log_u: float, log_1u: float, mean: float, var: float) -> tuple[float, float]:
    """Maximum likelihood from the sufficient statistics, by Newton steps."""
    common = max(mean * (1 - mean) / max(var, 1e-12) - 1, 1e-3)
    a, b = max(mean * common, 1e-3), max((1 - mean) * common, 1e-3)
    for _ in range(200):
        both = special.digamma(a + b)
        g1, g2 = special.digamma(a) - both - log_u, special.digamma(b) - both - log_1u
        t = special.trigamma(a + b)
        h11, h22, h12 = special.trigamma(a) - t, special.trigamma(b) - t, -t
        det = h11 * h22 - h12 * h12
        if det <= 0:
            break
        da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
        size = max(1.0, 2 * da / a, 2 * db / b)  # keep both parameters positive
        a, b = a - da / size, b - db / size
        if abs(da) < 1e-10 * a and abs(db) < 1e-10 * b:
            break
    return a, b


def standard_term(family: str, x: Column, p) -> Column | None:
    """Standardised value a normal family reads many times; bind it in an earlier projection."""
    if family in ("norm", "truncnorm"):
        return (x - p("mean")) / p("sd" if family == "norm" else "sd_sample")
    return None


def family_cdf(family: str, x: Column, p, z: Column | None = None) -> Column:
    """Distribution function of one family; `p(name)` gives a parameter Column, `z` the bound term."""
    z = standard_term(family, x, p) if z is None else z
    if family == "norm":
        return special.norm_cdf(z)
    if family == "uniform":
        return special.uniform_cdf(x, p("lo"), p("hi"))
    if family == "expon":
        return special.expon_cdf(x, p("lo"), p("mean") - p("lo"))
    if family == "truncnorm":
        return special.truncnorm_cdf(x, z, p("lo"), p("hi"), p("cdf_lo"), p("cdf_hi"))
    if family == "beta":
        return special.beta_cdf(unit_scaled(x, p("lo"), p("hi")), p("a"), p("b"))
    if family == CONSTANT:
        return F.when(x.isNotNull(), F.lit(0.5))
    raise ValueError(f"unknown family {family}")


PARAMETERS = ("mean", "sd", "sd_sample", "lo", "hi", "cdf_lo", "cdf_hi", "a", "b")


def _normal(column: str, f: dict) -> Marginal:
    """Parameters of one column; a zero deviation becomes 1, as its distance is never used."""
    return Marginal(column, "norm", f["lo"] or 0.0, f["hi"] or 0.0, f["mean"] or 0.0, f["sd"] or 1.0,
                    f["sd_sample"] or 1.0, f.get("a") or 1.0, f.get("b") or 1.0, n=f["n"])


#: Bins of `ks_distances`: at most so many a column and in all, of about so many rows; shorter tables are one bin.
KS_BINS, MOST_BINS, ROWS_PER_BIN, ONE_BIN = 16_384, 400_000, 512, 250_000
#: Computed distribution functions may fall by rounding; so much is left between bounds.
KS_SLACK = 1e-9


def _binned(narrow: DataFrame, columns: Sequence[str], n: int, bins: int) -> DataFrame:
    """(cluster, column, bin, value) of all values; bins ascend with the values, NaN is in the last.

    Cuts come from the rows whose hash is small.  They decide how rows are grouped, not
    what is found.
    """
    spans, made = [F.lit(0)] * len(columns), narrow
    if bins > 1:
        few = F.pmod(F.xxhash64(*columns), F.lit(2 ** 40)) < F.lit(min(1.0, 4 * bins / n) * 2 ** 40)
        sample = narrow.select(*columns).filter(few).distinct().limit(16 * bins).toPandas()
        for i, c in enumerate(columns):
            values = sample[c].dropna().to_numpy(dtype=float)
            values = np.unique(values[np.isfinite(values)])
            cuts = values[::max(1, -(-len(values) // bins))].tolist()
            if cuts:
                cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=c, outputCol=f"__bin{i}", handleInvalid="keep")
                made, spans[i] = cut.transform(made), F.col(f"__bin{i}").cast("int")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), s.alias("bin"), F.col(c).alias("value")) for c, s in zip(columns, spans)]))
    return made.select("cluster", cells.alias("cell")).select("cluster", "cell.*").filter("value IS NOT NULL")


def _with_families(df: DataFrame, value: str, families: Sequence[str], suffix: str = "") -> DataFrame:
    """Add `<family><suffix>`, the distribution functions at a column under the parameters of the row."""
    x = F.col(value)
    terms = {f: standard_term(f, x, F.col) for f in families}
    bound = df.select("*", *[z.alias(f"__z_{f}{suffix}") for f, z in terms.items() if z is not None])
    return bound.select("*", *[family_cdf(f, x, F.col, F.col(f"__z_{f}{suffix}") if terms[f] is not None else None).alias(f"{f}{suffix}")
                               for f in families])


def ks_distances(df: DataFrame, facts: dict, columns: Sequence[str], families: Sequence[str],
                 cluster: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(cluster, column, family...) one-sample KS statistics, exact.

    Values are grouped into bins whose rows are counted.  As every distribution function
    rises, its values at the ends of a bin bound the distances inside it, and the distances
    at the ends are among those sought.  Only bins that may hold the largest distance of
    some family are then ranked value by value; every family is evaluated in the same pass.
    """
    group = ["cluster", "column"]
    label = F.col(cluster) if cluster else F.lit(0)
    narrow = spread(df.select(label.cast("bigint").alias("cluster"), *[F.col(c).cast("double").alias(c) for c in columns]))
    sizes = [sum(f["n"] for (_, c), f in facts.items() if c == one) for one in columns]
    many = min(KS_BINS, max(64, MOST_BINS // max(len(facts), 1)))
    bins = 1 if sum(sizes) <= min(rows_per_bucket, ONE_BIN) else min(many, math.ceil(max(sizes) / min(rows_per_bucket, ROWS_PER_BIN)))
    cells = _binned(narrow, columns, max(sizes), bins)
    rows = [(g or 0, c, f["n"], *[float(getattr(_normal(c, f), k)) for k in PARAMETERS])
            for (g, c), f in facts.items() if c in columns and f["n"]]
    table = F.broadcast(df.sparkSession.createDataFrame(  # one row per cluster and column
        rows, "cluster bigint, column string, n bigint, " + ", ".join(f"{k} double" for k in PARAMETERS)))
    before = F.lit(0).cast("bigint")
    if bins > 1:
        everything = W.partitionBy(*group)
        tall = (cells.groupBy(*group, "bin").agg(F.count("*").alias("k"), F.min("value").alias("low"), F.max("value").alias("high"))
                .withColumn("upto", F.sum("k").over(everything.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))))
        ends = _with_families(_with_families(tall.join(table, group), "low", families, "_low"), "high", families, "_high")
        first, last = (F.col("upto") - F.col("k")) / F.col("n"), F.col("upto") / F.col("n")
        reached = [F.max(F.greatest(F.col(f"{f}_low") - first, last - F.col(f"{f}_high"))).over(everything) for f in families]
        most = [F.greatest(F.col(f"{f}_high") - first, last - F.col(f"{f}_low")) for f in families]
        open_ = [F.coalesce(m + KS_SLACK >= r, F.lit(True)) for m, r in zip(most, reached, strict=True)]
        found = ends.select(*group, "bin", (F.col("upto") - F.col("k")).alias("before"), reduce(Column.__or__, open_).alias("open"))
        cells = cells.join(F.broadcast(found.filter("open").groupBy(*group, "bin").agg(F.max("before").alias("before"))), [*group, "bin"])
        before = F.col("before")
    counts = cells.withColumn("before", before).groupBy(*group, "bin", "before", "value").agg(F.count("*").alias("k"))
    inside = W.partitionBy(*group, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.withColumn("k_cum", F.col("before") + F.sum("k").over(inside))
    fitted = _with_families(ranked.join(table, group), "value", families)
    below, upto = (F.col("k_cum") - F.col("k")) / F.col("n"), F.col("k_cum") / F.col("n")
    return fitted.groupBy(*group).agg(*[F.max(F.greatest(F.col(f) - below, upto - F.col(f))).alias(f) for f in families])


def fit_marginals(df: DataFrame, columns: Sequence[str], cluster: str | None = None,
                  gates: bool = True, truncation_share: float | None = None,
                  allowed: Sequence[str] = FAMILIES, rows_per_bucket: int = ROWS_PER_BUCKET) -> dict:
    """Best family per column, or per (cluster, column).

    Three passes: moments, tail facts, KS distances.  With `gates` the beta family
    needs a non-negative column with skewness up to 1, and a column with enough rows
    at its ends is a truncated normal outright.  The smallest distance wins, which
    for one sample size is the largest p-value but cannot underflow.
    Keys are (cluster or None, column).
    """
    if truncation_share is None:
        truncation_share = TRUNCATION_SHARE_IN_CLUSTER if cluster else TRUNCATION_SHARE
    facts = {(m["cluster"], m["column"]): m for m in moments(df, columns, cluster)}
    for f in facts.values():  # an all-null column has no range
        f.update({k: f[k] if f[k] is not None else 0.0 for k in ("mean", "sd", "sd_sample", "lo", "hi")})
    tail_facts(df, facts, columns, cluster)
    candidates = {}
    for key, f in facts.items():
        if f["n"] == 0 or f["lo"] == f["hi"]:
            candidates[key] = [CONSTANT]
            continue
        families = [name for name in FAMILIES if name in allowed]
        if gates and "beta" in families and (f["lo"] < 0 or (f["skew"] or 0) > 1):
            families.remove("beta")
        if gates and f["tail"] >= truncation_share:
            families = ["truncnorm"]
        if "beta" in families:
            f["a"], f["b"] = fit_beta(f["log_u"], f["log_1u"], f["u_mean"], f["u_var"])
        candidates[key] = families
    open_columns = [c for c in columns if any(candidates[k] != [CONSTANT] for k in candidates if k[1] == c)]
    needed = [f for f in FAMILIES if any(f in c for c in candidates.values())]
    distances = {}
    if open_columns and needed:
        for r in ks_distances(df, facts, open_columns, needed, cluster, rows_per_bucket).collect():
            distances[r["cluster"] if cluster else None, r["column"]] = {f: r[f] for f in needed}
    fitted = {}
    for key, f in facts.items():
        found = {name: d for name, d in distances.get(key, {}).items()
                 if name in candidates[key] and d is not None and not math.isnan(d)}
        best = CONSTANT if candidates[key] == [CONSTANT] else \
            min(found, key=lambda name: (found[name], FAMILIES.index(name))) if found else "norm"
        fitted[key] = Marginal(key[1], best, f["lo"], f["hi"], f["mean"], f["sd"], f["sd_sample"],
                               f.get("a") or 1.0, f.get("b") or 1.0, n=f["n"], distances=found)
    return fitted


def scott_bandwidth(n: int, sd: float) -> float:
    return sd * n ** (-1 / 5)


def kernel_density(df: DataFrame, column: str, points: int = 101, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density on an even grid over the range, (i, x, density).

    Exact: each distinct value, weighted by its count, meets the fixed grid, and the
    terms are summed by grid point before they are shuffled.  Null and NaN are left
    out; a constant column takes bandwidth 1 unless one is given; without values the
    result is empty.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    values = df.select(x.alias("m")).filter("m IS NOT NULL")
    row = values.agg(F.count("m").alias("n"), F.stddev_samp("m").alias("sd"), F.min("m").alias("lo"), F.max("m").alias("hi")).first()
    lo, hi = (0.0, 0.0) if row["lo"] is None else (row["lo"], row["hi"])
    h = bandwidth or (scott_bandwidth(row["n"], row["sd"]) if row["sd"] else 1.0)
    counted = values.groupBy("m").agg(F.count("*").alias("w"))
    met = counted.select("m", "w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))
    z = (at - F.col("m")) / F.lit(h)
    norm = row["n"] * h * math.sqrt(2 * math.pi)
    summed = met.groupBy("i").agg(F.sum(F.col("w") * F.exp(-0.5 * z * z)).alias("total"))
    return summed.select("i", at.alias("x"), (F.col("total") / F.lit(norm or 1.0)).alias("density"))

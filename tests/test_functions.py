"""Special functions, hashing and the bucketed scans."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthframe.functions import special
from synthframe.functions.frames import lookup_join
from synthframe.functions.quantiles import exact_quantiles
from synthframe.functions.rng import hash_uniform, md5_number, md5_uniform
from synthframe.functions.sampling import smallest_by_hash
from synthframe.functions.scan import ordered_fill, running_sum
from synthframe.operators.marginals import fit_beta

N = NormalDist()


def test_normal_functions_match_the_standard_library(spark):
    xs = [-8.0, -3.3, -0.7, 0.0, 0.4, 2.5, 7.5]
    ps = [1e-10, 1e-4, 0.02, 0.3, 0.5, 0.77, 1 - 1e-6]
    df = spark.createDataFrame(list(zip(xs, ps)), "x double, p double")
    rows = df.select("x", "p", special.norm_cdf(F.col("x")).alias("c"), special.norm_ppf(F.col("p")).alias("q")).collect()
    for r in rows:
        assert r.c == pytest.approx(N.cdf(r.x), abs=1e-14, rel=1e-7)
        assert r.q == pytest.approx(N.inv_cdf(r.p), abs=1e-9)
    np.testing.assert_allclose(special.np_norm_cdf(xs), [N.cdf(x) for x in xs], atol=1e-14)
    np.testing.assert_allclose(special.np_norm_ppf(ps), [N.inv_cdf(p) for p in ps], atol=1e-9)


def test_bound_form_of_the_quantile_and_its_filter(spark):
    df = spark.range(200).select("id", ((F.col("id") + 0.5) / 200).alias("p"))
    made = special.with_norm_ppf(df, {"z": F.col("p")})
    got = made.filter(F.col("z") > 0).count()
    assert got == 100
    plan = made.filter(F.col("z") > 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ln(") + plan.count("LOG") <= 4  # the filter did not copy the polynomial


def test_beta_functions_invert_and_match_integration():
    for a, b in ((2.0, 5.0), (0.7, 0.9), (30.0, 4.0)):
        grid = np.linspace(1e-6, 1 - 1e-6, 200_001)
        log_b = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        pdf = np.exp(log_b + (a - 1) * np.log(grid) + (b - 1) * np.log1p(-grid))
        mass = np.concatenate([[0], np.cumsum((pdf[1:] + pdf[:-1]) / 2) * (grid[1] - grid[0])])
        at = np.array([0.2, 0.5, 0.8])
        np.testing.assert_allclose(special.np_beta_cdf(at, a, b) - special.np_beta_cdf(0.1, a, b),
                                   np.interp(at, grid, mass) - np.interp(0.1, grid, mass), atol=1e-6)
        p = np.array([0.001, 0.2, 0.5, 0.9, 0.999])
        np.testing.assert_allclose(special.np_beta_cdf(special.np_beta_ppf(p, a, b), a, b), p, atol=1e-9)


def test_beta_fit_recovers_parameters():
    rng = np.random.default_rng(3)
    x = rng.beta(2.0, 5.0, 50_000)
    a, b = fit_beta(np.log(x).mean(), np.log1p(-x).mean(), x.mean(), x.var())
    assert a == pytest.approx(2.0, rel=0.05) and b == pytest.approx(5.0, rel=0.05)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_hash_uniforms_do_not_depend_on_partitions(spark, parts):
    def draw(n):
        return sorted(tuple(r) for r in spark.range(0, 500, 1, n).select(
            hash_uniform(F.col("id"), "a", 1), md5_uniform(F.col("id"), "a", 1)).collect())
    assert draw(parts) == draw(3)
    values = np.array(draw(parts))
    assert ((values > 0) & (values < 1)).all() and abs(values.mean() - 0.5) < 0.05


def _values(spark, n=400):
    return spark.range(n).select(((F.col("id") * 37) % 101 + F.col("id") / 1000).alias("x"),
                                 (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 7 + 1).alias("k"))


@pytest.mark.parametrize("rows_per_bucket", [10, 10_000])
def test_running_sum_equals_pandas(spark, rows_per_bucket):
    df = _values(spark)
    got = running_sum(df, ["x"], "k", groups=("g",), rows_per_bucket=rows_per_bucket).toPandas().sort_values(["g", "x"])
    want = df.toPandas().sort_values(["g", "x"])
    assert got["k_cum"].tolist() == want.groupby("g")["k"].cumsum().tolist()
    assert (got["k_cum"] - got["k"]).tolist() == got["k_before"].tolist()


@pytest.mark.parametrize("rows_per_bucket", [8, 10_000])
def test_fill_equals_pandas(spark, rows_per_bucket):
    df = spark.range(300).select("id", F.when(F.col("id") % 5 == 3, F.col("id") * 1.5).alias("v"),
                                 F.when((F.col("id") > 40) & (F.col("id") % 11 == 0), F.col("id").cast("string")).alias("s"))
    got = ordered_fill(df, ["id"], ["v", "s"], rows_per_bucket=rows_per_bucket).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id").ffill().bfill()
    assert got["v"].tolist() == want["v"].tolist() and got["s"].tolist() == want["s"].tolist()


@pytest.mark.parametrize("rows_per_bucket", [16, 10_000])
def test_quantiles_equal_pandas_on_a_hot_value(spark, rows_per_bucket):
    df = _values(spark).withColumn("x", F.when(F.col("k") < 4, F.lit(5.0)).otherwise(F.col("x")))
    got = exact_quantiles(df, ["g"], {"a": 0.1, "b": 0.5, "c": 0.93}, "x", rows_per_bucket).toPandas().set_index("g").sort_index()
    want = df.toPandas().groupby("g")["x"].quantile([0.1, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_lookup_join_gives_the_same_rows_both_ways(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                                 .otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("c"), "id")
    table = df.filter("c is not null and c <> 'k7'").groupBy("c").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    small = lookup_join(df, table, "c", "n").toPandas().sort_values("id").reset_index(drop=True)
    large = lookup_join(df, table, "c", "n", broadcast_rows=5, hot_keys=2).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(small[["id", "c", "top"]], large[["id", "c", "top"]])
    assert len(small) == 600


@pytest.mark.parametrize("n", [0, 1, 777, 2000, 5000])
def test_large_samples_take_the_rows_of_the_sorted_limit(spark, n):
    df = spark.range(2000)
    rank = md5_number(F.col("id"), "s", 1)
    want = {r.id for r in df.orderBy(rank, "id").limit(n).collect()}
    assert {r.id for r in smallest_by_hash(df, n, rank, "id", direct_rows=0 if n else 1).collect()} == want


def test_beta_quantile_needs_few_evaluations(monkeypatch):
    """Newton steps inside the cell, not forty halvings of every value."""
    seen, plain = [], special.np_beta_cdf
    monkeypatch.setattr(special, "np_beta_cdf", lambda x, a, b: seen.append(np.size(x)) or plain(x, a, b))
    p = np.linspace(0.001, 0.999, 5000)
    for a, b in ((1.1, 0.9), (2.5, 7.0), (0.7, 0.8), (50.0, 80.0)):
        seen.clear()
        found = special.np_beta_ppf(p, a, b)
        np.testing.assert_allclose(plain(found, a, b), p, rtol=1e-11)
        assert sum(seen) <= 4096 + 8 * len(p)

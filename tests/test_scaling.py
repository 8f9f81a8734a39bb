"""Steps that are repeated over long tables: what they read, and that their results stay exact."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from synthframe.functions import blocks, special
from synthframe.functions.rng import hash_uniform
from synthframe.operators import clustering, marginals, mixture


def normal_table(spark, n, **columns):
    """Independent normals; each keyword gives (mean, sd)."""
    z = special.with_norm_ppf(spark.range(n), {c: hash_uniform(F.col("id"), c, 5) for c in columns})
    return z.select("id", *[(F.col(c) * sd + mean).alias(c) for c, (mean, sd) in columns.items()])


def counted_rows(df, seen):
    """`df` again, adding its rows to an accumulator whenever they are made."""
    def run(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf
    return df.mapInPandas(run, df.schema)


def test_kmeans_gets_a_table_that_it_keeps_itself(spark, monkeypatch):
    found = []

    class Recorder(clustering.KMeans):
        def fit(self, dataset, params=None):
            found.append(dataset.storageLevel)
            return super().fit(dataset)

    monkeypatch.setattr(clustering, "KMeans", Recorder)
    df = spark.range(300).select((F.col("id") % 3 * 10.0 + F.col("id") % 7 * 0.1).alias("x"), (F.col("id") % 5 * 0.1).alias("y"))
    k, costs = clustering.elbow_k(df, ["x", "y"], range(2, 5))
    clustering.kmeans_labels(df, ["x", "y"], 3)
    assert len(found) == 4 and not any(level.useMemory or level.useDisk for level in found)
    assert k == 2 and costs[3] < 20 < costs[2]


def test_ks_ranks_only_bins_that_may_hold_the_largest_distance(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def watched(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(x))
        return pd.Series(special.np_beta_cdf(x.to_numpy(), a.to_numpy(), b.to_numpy()))

    n, families = 20_000, ["norm", "uniform", "beta", "expon", "truncnorm"]
    df = normal_table(spark, n, a=(5.0, 1.0)).select(F.exp(F.col("a") / 4).alias("a"), (F.col("id") % 2).alias("g")).cache()
    facts = {(m["cluster"], m["column"]): {**m, "a": 2.0, "b": 5.0} for m in marginals.moments(df, ["a"], "g")}
    want = marginals.ks_distances(df, facts, ["a"], families, "g").orderBy("cluster").collect()
    monkeypatch.setattr(special, "beta_cdf", watched)
    got = marginals.ks_distances(df, facts, ["a"], families, "g", rows_per_bucket=100).orderBy("cluster").collect()
    assert [r["cluster"] for r in got] == [0, 1] and 0 < seen.value < n / 2
    for a, b in zip(got, want, strict=True):
        assert [a[f] for f in families] == pytest.approx([b[f] for f in families], abs=1e-12)


def test_binned_ks_with_missing_values_ties_and_nan(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 10 != 0, F.sqrt(F.col("id") * 1.0)).alias("a"), F.least(F.col("id"), F.lit(4000)).cast("double").alias("t"),
                                  F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("id") * 1.0).alias("n")).cache()
    facts = {(None, m["column"]): m for m in marginals.moments(df.fillna(0.0, ["n"]), ["a", "t", "n"])}
    one, many = ({r["column"]: r for r in marginals.ks_distances(df, facts, ["a", "t", "n"], ["norm", "uniform"], rows_per_bucket=size).collect()}
                 for size in (10 ** 6, 50))
    for c in ("a", "t", "n"):
        for f in ("norm", "uniform"):
            assert many[c][f] == pytest.approx(one[c][f], abs=1e-12)


def test_joint_em_reads_its_rows_once(spark):
    df, seen = normal_table(spark, 3000, a=(0.0, 1.0), b=(4.0, 2.0)).select("a", "b"), spark.sparkContext.accumulator(0)
    start = mixture.JointMixture(["a", "b"], np.full(2, 0.5), np.array([[-1.0, 0.0], [1.0, 6.0]]), np.stack([np.eye(2)] * 2))
    model = mixture.joint_em(counted_rows(df, seen), {0: start}, max_iter=5, tol=0.0)[0]
    assert seen.value <= 2 * 3000 and model.n == 3000  # one pass for the counts of different rows, one that packs
    x = df.toPandas().to_numpy()
    np.testing.assert_allclose(model.weights @ model.means, x.mean(axis=0), atol=1e-9)


def test_exact_mixtures_read_their_values_once(spark):
    counts, seen = mixture.value_counts(normal_table(spark, 2000, a=(0.0, 1.0)), ["a"]), spark.sparkContext.accumulator(0)
    starts = {("a", 2): (np.full(2, 0.5), np.array([-1.0, 1.0]), np.ones(2))}
    done = mixture.exact_mixtures(counted_rows(counts, seen), starts, {"a": 2000}, tolerance=0.0, scans=4)
    assert seen.value == 2000 and done["a", 2][0].sum() == pytest.approx(1.0)


def test_blocks_hold_every_finite_row_of_their_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 != 3, F.col("id") * 1.0).alias("x"), F.when(F.col("id") % 10 == 4, float("inf")).otherwise(2.0).alias("y"),
                                  (F.col("id") % 3).alias("g"))
    rows = blocks.packed(df, ["x", "y"], "g", block_rows=50).collect()
    found = {(r["part"], v) for r in rows for v in np.frombuffer(r["body"]).reshape(2, r["size"])[0].tolist()}
    assert found == {(str(i % 3), float(i)) for i in range(1000) if i % 10 not in (3, 4)} and sum(r["size"] for r in rows) == 800

"""Operators against brute force, identities and constructed distributions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthframe.functions.rng import hash_uniform
from synthframe.functions.special import with_norm_ppf
from synthframe.operators import (clustering, copula, dependence, encode, generate, marginals, missing, mixture, profile,
                                  project, quality, utility)
from synthframe.operators.marginals import Marginal


def normal_table(spark, n, **columns):
    """Independent normals; each keyword gives (mean, sd)."""
    z = with_norm_ppf(spark.range(n), {c: hash_uniform(F.col("id"), c, 5) for c in columns})
    return z.select("id", *[(F.col(c) * sd + mean).alias(c) for c, (mean, sd) in columns.items()])


def test_roles(spark):
    df = spark.createDataFrame(
        [(i, f"AB{i:04d}", f"{i}-7-{i}", "x" if i % 2 else "y", f"2020-01-{i % 28 + 1:02d}", i * 0.5, i % 4, None if i % 3 else "a")
         for i in range(60)],
        "key bigint, code string, policy string, letter string, day string, real double, small int, gap string")
    found = {p.column: p for p in profile.profile_columns(df, order_by="key")}
    roles = {c: p.role for c, p in found.items()}
    assert roles == {"key": "surrogate_id", "code": "prefixed_id", "policy": "hyphen_id", "letter": "category", "day": "datetime",
                     "real": "numeric", "small": "numeric", "gap": "category"}
    assert found["code"].prefix == "AB" and found["code"].digits == [4] and found["policy"].digits == [1, 1, 1]
    assert found["gap"].n_null == 40
    with pytest.raises(ValueError):
        profile.profile_columns(df.select(F.array("key").alias("a")))


def test_unique_text_is_a_category_without_id_patterns(spark):
    df = spark.createDataFrame([(f"name {i}", i % 2) for i in range(20)], "name string, v int")
    assert profile.profile_columns(df)[0].role == "category"
    assert profile.dtype_groups(df).count() == 2


@pytest.mark.parametrize("limit", [50_000, 2])
def test_decoding_inverts_encoding_for_small_and_large_dictionaries(spark, limit):
    df = spark.range(300).select("id", F.concat(F.lit("c"), (F.col("id") % 17).cast("string")).alias("c"))
    intervals = encode.category_intervals(df, ["c"])
    numbers = encode.encode_categories(df, ["c"], intervals, "id")
    back = encode.decode_categories(numbers, ["c"], intervals, "id", broadcast_rows=limit)
    assert back.join(df.withColumnRenamed("c", "d"), "id").filter("c = d").count() == 300
    assert intervals.agg(F.sum("share")).first()[0] == pytest.approx(1.0)


@pytest.mark.parametrize("limit", [50_000, 1])
def test_decoding_edges(spark, limit):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "c string")
    intervals = encode.category_intervals(df, ["c"])
    x = spark.createDataFrame([(0, -3.0), (1, 0.0), (2, 0.59), (3, 0.6), (4, 0.9), (5, 1.0), (6, 7.0), (7, None)], "id int, c double")
    got = {r.id: r.c for r in encode.decode_categories(x, ["c"], intervals, "id", broadcast_rows=limit).collect()}
    assert got == {0: "a", 1: "a", 2: "a", 3: "b", 4: "c", 5: "c", 6: "c", 7: None}


def test_one_hot_unknown_is_all_zero_and_pipeline_form(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    levels = {"c": encode.category_levels(train, "c")}
    row = encode.one_hot(spark.createDataFrame([("z",)], "c string"), levels).first()
    assert tuple(row) == (0, 0)
    model = encode.one_hot_vectors(["c"]).fit(train)
    assert model.transform(spark.createDataFrame([("z",)], "c string")).first()["c_vector"].numNonzeros() == 0


def test_positional_and_random_missing(spark):
    real = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id")).alias("v"))
    full = spark.range(400).select("id", F.col("id").alias("v"))
    assert missing.reapply_missing_by_position(full, real, ["v"], "id").filter("v is null").count() == 100
    share = missing.reapply_missing(full, missing.missing_rates(real, ["v"]), "id").filter("v is null").count() / 400
    assert 0.15 < share < 0.35


@pytest.mark.parametrize("family", ["norm", "uniform", "beta", "expon"])
def test_known_families_are_recovered(spark, family):
    u = hash_uniform(F.col("id"), family, 1)
    model = {"norm": Marginal("x", "norm", 0, 0, mean=0.0, sd=1.0), "uniform": Marginal("x", "uniform", 0.0, 1.0),
             "beta": Marginal("x", "beta", 0.0, 1.0, a=2.0, b=5.0), "expon": Marginal("x", "expon", 0.0, 0.0, mean=1.0)}[family]
    x = copula.quantile_table(spark.range(1000).select(u.alias("x")), {"x": model}).cache()
    found = marginals.fit_marginals(x, ["x"], gates=False)[None, "x"]
    close = {"norm": {"norm", "truncnorm"}, "beta": {"beta"}, "uniform": {"uniform", "beta"}, "expon": {"expon"}}[family]
    assert found.family in close and found.distances[found.family] < 0.06 and found.p_value() > 0.001


def test_ks_distance_equals_brute_force_in_many_buckets(spark, orders):
    x = np.sort(orders.select("o_totalprice").toPandas()["o_totalprice"].to_numpy())
    n, lo, hi = len(x), x.min(), x.max()
    f = (x - lo) / (hi - lo)
    want = max((f - np.arange(n) / n).max(), (np.arange(1, n + 1) / n - f).max())
    facts = {(None, m["column"]): m for m in marginals.moments(orders, ["o_totalprice"])}
    got = marginals.ks_distances(orders, facts, ["o_totalprice"], ["uniform"], rows_per_bucket=100).first()
    assert got["uniform"] == pytest.approx(want, abs=1e-12)


def test_constant_and_truncated_columns(spark):
    df = spark.range(200).select(F.lit(4.0).alias("c"), F.greatest(F.least(F.col("id") * 1.0, F.lit(150.0)), F.lit(50.0)).alias("t"))
    found = marginals.fit_marginals(df, ["c", "t"])
    assert found[None, "c"].family == "constant" and found[None, "t"].family == "truncnorm"


def test_mixture_finds_two_humps_and_its_quantile_inverts(spark):
    df = normal_table(spark, 4000, a=(0.0, 1.0)).select(F.when(F.col("id") % 3 == 0, F.col("a") + 12).otherwise(F.col("a")).alias("x")).cache()
    m = mixture.fit_mixtures(df, ["x"], max_components=4)["x"]
    assert len(m.weights) >= 2 and sum(m.weights) == pytest.approx(1.0)
    assert min(abs(mu - 12) for mu in m.means) < 0.5 and min(abs(mu) for mu in m.means) < 0.5
    p = np.array([1e-6, 0.1, 0.5, 0.66, 0.9, 1 - 1e-6])
    np.testing.assert_allclose(copula.np_mixture_cdf(copula.np_quantile(m, p), m), p, atol=1e-9)


def test_scores_are_standard_and_null_stays_null(spark):
    df = normal_table(spark, 3000, a=(50.0, 7.0)).withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    models = {"a": marginals.fit_marginals(df, ["a"], gates=False, allowed=("norm",))[None, "a"]}
    z = copula.normal_scores(df, models)
    row = z.agg(F.avg("a"), F.stddev("a"), F.count("a")).first()
    assert abs(row[0]) < 1e-6 and row[1] == pytest.approx(1.0, abs=0.01) and row[2] == 2700
    mixed = mixture.fit_mixtures(df, ["a"], max_components=2)
    assert copula.normal_scores(df, mixed).filter("a is null").count() == 300


def test_wide_and_narrow_correlations_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    holes = df.withColumn("l_discount", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_discount")))
    narrow = {(r.col_i, r.col_j): r.value for r in dependence.correlation(holes, columns).collect()}
    wide = {(r.col_i, r.col_j): r.value for r in dependence._moments_from_gram(holes, columns, None, True).collect()}
    assert narrow.keys() == wide.keys()
    for key, value in narrow.items():
        assert wide[key] == pytest.approx(value, abs=1e-9)


def blobs(spark, n=600):
    z = normal_table(spark, n, a=(0.0, 0.3), b=(0.0, 0.3))
    k = F.col("id") % 3
    return z.select("id", (F.col("a") + F.when(k == 1, 6).otherwise(0)).alias("a"), (F.col("b") + F.when(k == 2, 6).otherwise(0)).alias("b")).cache()


def test_cluster_counts_and_joint_mixture_on_blobs(spark):
    df = blobs(spark)
    assert clustering.silhouette_k(df, ["a", "b"], range(2, 5))[0] == 3
    model = clustering.mixtures_from_kmeans(df, ["a", "b"], [1, 3])
    assert model[3].bic() < model[1].bic()
    np.testing.assert_allclose(np.sort(model[3].weights), [1 / 3] * 3, atol=0.02)
    mean, cov = model[3].moments()
    np.testing.assert_allclose(mean, [2, 2], atol=0.1)
    np.testing.assert_allclose(cov, dependence.covariance_matrix(df, ["a", "b"]), atol=0.1)
    labelled, _ = clustering.kmeans_labels(df, ["a", "b"], 3)
    inner = clustering.cluster_mixtures(labelled, ["a", "b"], max_components=2, by_bic=True, max_iter=5)
    assert len(inner) == 3 and all(m.k <= 2 for m in inner.values())


def test_native_and_arrow_generation_agree(spark):
    models = {"a": Marginal("a", "norm", 0, 0, mean=5.0, sd=2.0), "b": Marginal("b", "uniform", -1.0, 4.0),
              "c": Marginal("c", "expon", 1.0, 9.0, mean=3.0),
              "d": Marginal("d", "truncnorm", 0.0, 8.0, mean=3.0, sd=2.0, sd_sample=2.0)}
    corr = np.full((4, 4), 0.4) + 0.6 * np.eye(4)
    draws = generate.single_copula(list(models), corr, models)
    left = generate.draw_rows(spark, draws, 500, 3, arrow=False).orderBy("row_id").toPandas()
    right = generate.draw_rows(spark, draws, 500, 3, arrow=True).orderBy("row_id").toPandas()
    np.testing.assert_allclose(left[list(models)].to_numpy(), right[list(models)].to_numpy(), atol=1e-8)


def test_allocation_is_exact(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 3), (2, 3)], "cluster int, n bigint")
    for method in ("largest_remainder", "last"):
        assert generate.allocate_rows(sizes, 100, method=method).agg(F.sum("rows")).first()[0] == 100


def test_self_comparison_scores_one(orders):
    numeric, categories = ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
    for metric in (quality.range_coverage, quality.boundary_adherence):
        assert all(r.score == 1.0 for r in metric(orders, orders, numeric).collect())
    assert all(r.score == 1.0 for r in quality.category_coverage(orders, orders, categories).collect())
    assert all(r.score == pytest.approx(1.0) for r in quality.quality_score(orders, orders, numeric, categories).collect())


def test_two_sample_distance_in_many_buckets(spark, orders):
    other = orders.withColumn("o_totalprice", F.col("o_totalprice") * 0.8)
    one = quality.ks_complement(orders, other, ["o_totalprice"]).first()["score"]
    many = quality.ks_complement(orders, other, ["o_totalprice"], rows_per_bucket=64).first()["score"]
    assert one == pytest.approx(many, abs=1e-12) and one < 0.95


def test_split_and_sample_are_stable(spark):
    def held(parts):
        return {r.id for r in utility.train_test_split(spark.range(0, 300, 1, parts), "id", 0.3)[1].collect()}
    assert held(1) == held(17)
    assert utility.sample_rows(spark.range(50), 20, "id").distinct().count() == 20


def test_clip_keeps_null_and_restores_types(spark):
    df = spark.createDataFrame([(1, 0.4), (2, None), (3, 99.6)], "id int, v double")
    got = project.restore_types(project.clip(df, {"v": (1.0, 50.5)}), {"v": "int"}).orderBy("id")
    assert [r.v for r in got.collect()] == [1, None, 50] and dict(got.dtypes)["v"] == "int"


def test_a_cluster_with_a_constant_column(spark):
    df = spark.range(300).select("id", (F.col("id") % 2).cast("int").alias("cluster"),
                                 F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("v"))
    fitted = marginals.fit_marginals(df, ["v"], cluster="cluster")
    assert fitted[0, "v"].family == "constant" and fitted[1, "v"].family != "constant"
    scores = copula.cluster_scores(df, ["v"], fitted, "cluster")
    assert scores.filter("cluster = 0 and v = 0").count() == 150 and scores.filter("v is null").count() == 0
    back = copula.cluster_quantiles(copula.cluster_cdf(df, ["v"], fitted, "cluster"), ["v"], fitted, "cluster")
    assert back.filter("cluster = 0 and v = 7").count() == 150


def test_auc_of_a_missing_class_and_empty_scores(spark):
    df = spark.createDataFrame([("a", 0.2, 0.8), ("b", 0.6, 0.4)], "y string, s double, t double")
    rows = {r["class"]: r.auc for r in utility.class_auc(df, "y", {"a": "t", "z": "s"}).collect()}
    assert rows == {"a": 1.0, "z": None}
    gone = df.withColumn("s", F.lit(None).cast("double"))
    assert quality.ks_complement(df, gone, ["s"]).first()["score"] is None


def test_exact_mixture_fit_equals_plain_em_over_the_rows(spark):
    """Every scan is one EM step over all rows; copies count by their number."""
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(0, 1, 700), rng.normal(6, 2, 900), np.full(300, 2.5)]), 2)
    df = spark.createDataFrame([(float(v), float(v) * 3) for v in x] + [(None, float("nan"))], "a double, b double")
    start = (np.array([0.5, 0.3, 0.2]), np.array([-1.0, 2.0, 7.0]), np.array([1.0, 2.0, 3.0]))
    starts = {("a", 3): start, ("a", 1): tuple(v[:1] * 0 + 1 for v in start), ("b", 3): start}
    done = mixture.exact_mixtures(mixture.value_counts(df, ["a", "b"]), starts, {"a": len(x), "b": len(x)}, tolerance=0.0, scans=12)
    for (column, k), (w, mean, var, likelihood) in done.items():
        v = x if column == "a" else x * 3
        pw, pm, pv = starts[column, k]
        for step in range(12):
            density = pw * np.exp(-(v[:, None] - pm) ** 2 / (2 * pv)) / np.sqrt(2 * np.pi * pv)
            plain = np.log(density.sum(1)).sum()
            if step < 11:
                r = density / density.sum(1, keepdims=True)
                mass = r.sum(0)
                pw, pm = mass / len(v), (r * v[:, None]).sum(0) / mass
                pv = (r * (v[:, None] - pm) ** 2).sum(0) / mass + mixture.VARIANCE_FLOOR
        np.testing.assert_allclose(likelihood, plain, rtol=1e-9)
        np.testing.assert_allclose(np.concatenate([w, mean, var]), np.concatenate([pw, pm, pv]), rtol=1e-6)
    assert len(done) == 3


def test_mixture_candidates_report_the_likelihood_of_all_rows(spark):
    z = with_norm_ppf(spark.range(3000), {"z": hash_uniform(F.col("id"), "x")})
    df = z.select((F.when(F.col("id") % 3 == 0, 10.0).otherwise(0.0) + F.col("z")).alias("x"))
    best = [r for r in mixture.mixture_candidates(df, ["x"], 4).collect() if r["k"] == 2]
    v = df.toPandas()["x"].to_numpy()
    density = sum(r["weight"] * np.exp(-((v - r["mean"]) / r["sd"]) ** 2 / 2) / r["sd"] / np.sqrt(2 * np.pi) for r in best)
    np.testing.assert_allclose(best[0]["log_likelihood"], np.log(density).sum(), rtol=1e-9)
    assert best[0]["n"] == 3000 and abs(best[1]["mean"] - 10) < 0.2


def test_quality_report_scores_dates_and_booleans(spark):
    df = spark.range(400).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("day"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("local"),
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 70).cast("int"))).alias("instant"),
        (F.col("id") % 3 == 0).alias("flag"))
    assert {r.column: (r.metric, r.score) for r in quality.column_shapes(df, df).collect()} == {
        "day": ("ks_complement", 1.0), "local": ("ks_complement", 1.0), "instant": ("ks_complement", 1.0), "flag": ("tv_complement", 1.0)}
    assert quality.pair_trends(df, df).count() == 6
    moved = df.withColumn("day", F.date_add("day", 45)).withColumn("flag", F.lit(True))
    shapes = {r.column: r.score for r in quality.column_shapes(df, moved).collect()}
    assert shapes["day"] < 0.55 and shapes["flag"] == pytest.approx(134 / 400) and shapes["local"] == 1.0


def test_joint_mixture_equals_plain_em_however_its_sums_are_merged(spark):
    """Packed statistics merged in one or in five lanes against EM over the rows in numpy."""
    df = blobs(spark)
    x = np.array(df.select("a", "b").collect())
    start = mixture.JointMixture(["a", "b"], np.full(3, 1 / 3), np.array([[0.0, 0.5], [5.0, 0.0], [0.5, 5.0]]), np.stack([np.eye(2) * 2] * 3))
    plain = start
    for _ in range(4):
        lp = mixture.log_densities(x, plain)
        norm = np.log(np.exp(lp).sum(axis=1))
        r = np.exp(lp - norm[:, None])
        mass = r.sum(axis=0)
        means = (r.T @ x) / mass[:, None]
        cov = [np.cov(x.T, aweights=r[:, j], bias=True) + mixture.VARIANCE_FLOOR * np.eye(2) for j in range(3)]
        plain = mixture.JointMixture(["a", "b"], mass / mass.sum(), means, np.stack(cov), norm.sum(), len(x))
    for lanes in (1, 5):
        got = mixture.joint_em(df.repartition(9), {0: start}, max_iter=4, tol=0.0, lanes=lanes)[0]
        assert got.n == len(x)
        np.testing.assert_allclose(got.log_likelihood, plain.log_likelihood, rtol=1e-10)
        np.testing.assert_allclose(got.weights, plain.weights, atol=1e-9)
        np.testing.assert_allclose(got.means, plain.means, atol=1e-8)
        np.testing.assert_allclose(got.covariances, plain.covariances, atol=1e-8)


def test_merged_statistics_reach_the_driver_as_one_row_a_model(spark):
    rows = spark.range(4000, numPartitions=40).selectExpr("int(id % 2) AS model", "int(id % 7) AS lane", "array(1D, double(id)) AS sums")
    got = mixture.summed_statistics(rows, 7, 2)
    assert {k: v.tolist() for k, v in got.items()} == {0: [2000.0, 2000.0 * 1999], 1: [2000.0, 2000.0 * 2000]}


def test_davies_bouldin_of_vectors_equals_that_of_columns(spark):
    df = blobs(spark)
    labelled, _ = clustering.kmeans_labels(df, ["a", "b"], 3)
    path = clustering.davies_bouldin_path(df, ["a", "b"], [3])
    np.testing.assert_allclose(path[3], clustering.davies_bouldin(labelled, ["a", "b"], "cluster"), rtol=1e-9)


def test_joint_mixture_scans_equal_rows_once(spark, monkeypatch):
    """columns with few values are scanned as their different rows and counts, with the sums of all rows."""
    df = blobs(spark).select(F.round("a").alias("a"), F.round("b").alias("b")).withColumn("g", (F.col("a") > 3).cast("int"))
    df = df.unionByName(df.limit(5).withColumn("a", F.lit(None).cast("double"))).persist()
    starts = {i: mixture.JointMixture(["a", "b"], np.full(2, 0.5), np.array([[0.0, 0.5], [4.0, 3.0]]), np.stack([np.eye(2) * 2] * 2)) for i in range(2)}
    seen = []
    monkeypatch.setattr(mixture, "written", lambda rows, label: seen.append(rows.count()) or rows)
    merged = mixture.joint_em(df, starts, max_iter=3, tol=0.0, owner={0: 0, 1: 1}, cluster="g")
    assert seen == [df.select("g", "a", "b").distinct().count()] and seen[0] < df.count() / mixture.SAVING
    monkeypatch.setattr(mixture, "SAVING", 10 ** 9)
    plain = mixture.joint_em(df, starts, max_iter=3, tol=0.0, owner={0: 0, 1: 1}, cluster="g")
    assert len(seen) == 1
    for key, model in merged.items():
        assert model.n == plain[key].n and model.log_likelihood == pytest.approx(plain[key].log_likelihood, rel=1e-10)
        np.testing.assert_allclose(model.covariances, plain[key].covariances, atol=1e-9)


def test_mixture_starts_from_counts_equal_those_from_rows(spark, monkeypatch):
    """KMeans starts from different rows and their counts; a cluster's moments are those of all its rows."""
    df = blobs(spark).select(F.round("a").alias("a"), F.round("b").alias("b"))
    counted = df.groupBy("a", "b").agg(F.count("*").alias(mixture.ROWS))
    whole = clustering.start_from_labels(df.withColumn("cluster", F.lit(0)), ["a", "b"], 1)
    one = clustering.start_from_counts(counted, ["a", "b"], 1)
    np.testing.assert_allclose(one.means, whole.means, rtol=1e-12)
    np.testing.assert_allclose(one.covariances, whole.covariances, rtol=1e-10)
    plain = clustering.mixtures_from_kmeans(df, ["a", "b"], (1, 3))
    monkeypatch.setattr(clustering, "MERGE_FROM", 1)
    monkeypatch.setattr(clustering, "kmeans_labels", lambda *args: pytest.fail("a KMeans fit on all rows"))
    merged = clustering.mixtures_from_kmeans(df, ["a", "b"], (1, 3))
    for k in (1, 3):
        assert merged[k].n == plain[k].n and merged[k].log_likelihood == pytest.approx(plain[k].log_likelihood, rel=1e-2)

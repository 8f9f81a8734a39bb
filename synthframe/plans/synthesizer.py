"""Fit a table once, draw any number of rows like it.

Presets:
  mixture_copula     mixture per column + one Gaussian copula
  joint_mixture      one mixture over all encoded columns, no copula
  parametric_copula  best family per column; copula covariance from a KMeans-started mixture
  elbow_copula       best family per column; covariance per KMeans cluster, k by elbow
  silhouette_copula  the same, k by silhouette
  local_copula       cluster first, families fitted inside each cluster, k by eigen gap
  spectral_copula    as silhouette_copula with spectral clusters
  spectral_mixture   spectral clusters, a small mixture of scores in each
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthframe.functions.frames import BROADCAST_ROWS, spread
from synthframe.operators import clustering, copula, dependence, encode, generate, missing, project
from synthframe.operators import profile as prof
from synthframe.operators.marginals import Marginal, fit_marginals
from synthframe.operators.mixture import JointMixture, fit_mixtures
from synthframe.operators.spectral import VERTICES, spectral_labels
from synthframe.operators.timing import FITTING, StageTimer
from synthframe.session import checkpoint, tune

PRESETS = ("mixture_copula", "joint_mixture", "parametric_copula", "elbow_copula", "silhouette_copula",
           "local_copula", "spectral_copula", "spectral_mixture")
ROW = "__row"
INTERVAL_SCHEMA = "column string, category string, n bigint, share double, lo double, hi double"


@dataclass
class FittedModel:
    """Everything needed to draw rows; small except for a large category dictionary."""

    preset: str
    seed: int
    columns: list[str]                       # output columns, in table order
    dtypes: dict[str, str]
    profiles: list[prof.ColumnProfile]
    draws: generate.Draws
    ranges: dict[str, tuple[float, float]]
    missing: dict[str, float]
    intervals: DataFrame
    date_formats: dict[str, str] = field(default_factory=dict)
    timer: StageTimer = field(default_factory=StageTimer)
    absent: list[str] = field(default_factory=list)  # columns without any value; null in every drawn row
    given: list[str] = field(default_factory=list)   # the table's own names, where they are not plain ones

    def _role(self, *roles: str) -> list[prof.ColumnProfile]:
        return [p for p in self.profiles if p.role in roles]

    def sample(self, spark: SparkSession, num_rows: int, seed: int | None = None, keep_row_id: bool = False) -> DataFrame:
        """`num_rows` rows with the columns and types of the real table.

        Drawing is lazy; only category dictionaries are read here.  Row i is the same on every run and cluster.
        """
        tune(spark)
        seed = self.seed if seed is None else seed
        raw = generate.draw_rows(spark, self.draws, num_rows, seed, exact=self.draws.marginals is not None)
        raw = project.clip(raw, self.ranges)
        out = self._finish(raw, num_rows, seed, keep_row_id)
        return out.toDF(*(["row_id"] if keep_row_id else []), *self.given) if self.given else out

    def _finish(self, raw: DataFrame, num_rows: int, seed: int, keep_row_id: bool) -> DataFrame:
        """Decode categories and dates, make ids, re-apply missing values, restore types."""
        categories = [p.column for p in self._role(prof.CATEGORY)]
        out = encode.decode_categories(raw, categories, self.intervals, "row_id")
        row = F.col("row_id")
        made = {}
        for p in self._role(prof.DATETIME):
            made[p.column] = self._date(p)
        for p in self._role(prof.PREFIXED_ID):
            made[p.column] = encode.prefixed_id(row, p.prefix, p.digits[0], p.column, seed)
        for p in self._role(prof.HYPHEN_ID):
            made[p.column] = encode.hyphenated_id(row, p.digits, p.column, seed)
        for p in self._role(prof.SURROGATE_ID):
            made[p.column] = (F.lit(int(p.min or 0)) + row).cast(p.dtype)
        for p in self._role(prof.TEXT_ID):
            made[p.column] = F.sha2(F.concat_ws(":", F.lit(p.column), row.cast("string"), F.lit(str(seed))), 224)
        numbers = {p.column: p.dtype for p in self._role(prof.NUMERIC)}
        out = out.select("row_id", *[F.lit(None).alias(c) if c in self.absent else made.get(c, F.col(c)).alias(c) for c in self.columns])
        out = project.restore_types(out, numbers)
        typed = {p.column: p.dtype for p in self._role(prof.CATEGORY) if p.dtype != "string"}
        absent = {c: self.dtypes[c] for c in self.absent}
        out = out.select("row_id", *[F.lit(None).cast(absent[c]).alias(c) if c in absent else F.col(c).cast(typed[c]).alias(c) if c in typed else F.col(c)
                                     for c in self.columns])
        out = missing.reapply_missing(out, self.missing, "row_id", seed)
        return out if keep_row_id else out.drop("row_id")

    def _date(self, p: prof.ColumnProfile):
        day = encode.day_to_date(F.col(p.column))
        if p.dtype == "string":
            return F.date_format(day, self.date_formats.get(p.column, "yyyy-MM-dd"))
        return day.cast(p.dtype)

    # ------------------------------------------------------------------ storage

    def save(self, path: str) -> None:
        """Write the model as two Parquet tables under `path`."""
        d = self.draws
        marginals = None if d.marginals is None else [
            [list(k) if isinstance(k, tuple) else k, asdict(m)] for k, m in d.marginals.items()]
        body = {"preset": self.preset, "seed": self.seed, "columns": self.columns, "dtypes": self.dtypes,
                "profiles": [asdict(p) for p in self.profiles], "ranges": self.ranges, "missing": self.missing, "absent": self.absent, "given": self.given,
                "draws": {"columns": d.columns, "labels": [int(g) for g in d.labels],
                          "counts": [float(c) for c in d.counts], "means": np.asarray(d.means).tolist(),
                          "factors": np.asarray(d.factors).tolist(), "marginals": marginals, "local": d.local}}
        spark = self.intervals.sparkSession
        spark.createDataFrame([(json.dumps(body),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        self.intervals.write.mode("overwrite").parquet(f"{path}/intervals")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        body = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        d = body["draws"]
        marginals = None if d["marginals"] is None else {
            tuple(k) if isinstance(k, list) else k: Marginal(**m) for k, m in d["marginals"]}
        draws = generate.Draws(d["columns"], d["labels"], d["counts"], np.array(d["means"]), np.array(d["factors"]),
                               marginals, d["local"])
        return FittedModel(body["preset"], body["seed"], body["columns"], body["dtypes"],
                           [prof.ColumnProfile(**p) for p in body["profiles"]], draws,
                           {c: tuple(r) for c, r in body["ranges"].items()}, body["missing"],
                           spark.read.parquet(f"{path}/intervals"), absent=body.get("absent", []), given=body.get("given", []))


def plain_names(names: list[str]) -> list[str]:
    """The names with dots and backticks, which Spark reads as syntax, replaced; all different."""
    out: list[str] = []
    for name in names:
        new = name.replace(".", "_").replace("`", "_")
        while new != name and (new in names or new in out):
            new += "_"
        out.append(new)
    return out


@dataclass
class Synthesizer:
    """Builds a FittedModel from any flat DataFrame.

    `row_id` names a unique column; it seeds the category draws and orders the fill of
    missing values.  Without it a hash of the whole row stands in and missing numbers
    take the column mean.  `k` fixes the cluster count; otherwise the preset chooses.
    """

    preset: str = "mixture_copula"
    seed: int = 0
    row_id: str | None = None
    k: int | None = None
    max_k: int = 10
    max_components: int = 19
    joint_components: int = 8
    vertices: int = VERTICES
    use_covariance: bool = False

    def __post_init__(self) -> None:
        if self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset}; one of {', '.join(PRESETS)}")

    # ----------------------------------------------------------------- encoding

    def encode(self, df: DataFrame, profiles: list[prof.ColumnProfile]) -> tuple[DataFrame, DataFrame, dict[str, float]]:
        """P to M: numeric table (ROW + modelled columns), category intervals, missing rates."""
        role = {p.column: p.role for p in profiles}
        modelled = [p.column for p in profiles if p.role in (prof.NUMERIC, prof.CATEGORY, prof.DATETIME)]
        dates = [c for c in modelled if role[c] == prof.DATETIME]
        categories = [c for c in modelled if role[c] == prof.CATEGORY]
        ident = F.col(self.row_id) if self.row_id else F.xxhash64(*df.columns)
        order = [ROW]
        out = df.select(ident.alias(ROW), *modelled)
        out = encode.dates_to_days(out, dates)
        out = out.select(*order, *[F.col(c).cast("string").alias(c) if c in categories else F.col(c).cast("double").alias(c)
                                   for c in modelled])
        rates = missing.missing_rates(out, modelled) if modelled else {}
        gaps = [c for c in modelled if rates[c] > 0]
        intervals = self._freeze(encode.category_intervals(out, categories)) if categories else \
            df.sparkSession.createDataFrame([], INTERVAL_SCHEMA)
        if gaps and self.row_id:
            out = missing.fill_forward_backward(out, gaps, ROW)
        out = encode.encode_categories(out, categories, intervals, ROW, self.seed) if categories else out
        if gaps and not self.row_id:
            out = missing.fill_mean(out, gaps)
        return out, intervals, {c: rates[c] for c in gaps}

    @staticmethod
    def _freeze(table: DataFrame) -> DataFrame:
        """Small dictionaries become a local table; a large one is checkpointed."""
        rows = table.limit(BROADCAST_ROWS + 1).collect()
        if len(rows) <= BROADCAST_ROWS:
            return table.sparkSession.createDataFrame(rows, INTERVAL_SCHEMA)
        return checkpoint(table)

    # ------------------------------------------------------------------ fitting

    def fit(self, df: DataFrame) -> FittedModel:
        tune(df.sparkSession)
        plain = plain_names(df.columns)
        if plain != df.columns:
            same = dict(zip(df.columns, plain, strict=True))
            model = replace(self, row_id=same.get(self.row_id)).fit(df.toDF(*plain))
            return replace(model, given=list(df.columns))
        timer = StageTimer()
        names, types = list(df.columns), dict(df.dtypes)
        with timer.stage("profile", FITTING):
            df = df.select(*[F.nanvl(c, F.lit(None).cast(types[c])).alias(c) if types[c] in ("double", "float") else F.col(c) for c in names])  # NaN is missing
            valued = df.agg(*[F.count(c).alias(c) for c in names]).first()
            absent = [c for c in names if not valued[c]]
            df = df.drop(*absent)
            profiles = prof.profile_columns(df, order_by=self.row_id)
        with timer.stage("encode", FITTING):
            table, intervals, rates = self.encode(df, profiles)
            columns = [c for c in table.columns if c != ROW]
            if not columns:
                raise ValueError("no numeric, category or date column to model")
            table = spread(table).persist(StorageLevel.MEMORY_AND_DISK)
            ranges = prof.column_ranges(table, columns)
        try:
            with timer.stage("structure", FITTING):
                draws = getattr(self, f"_fit_{self.preset}")(table, columns)
        finally:
            table.unpersist()
        return FittedModel(self.preset, self.seed, names, types, profiles, draws,
                           {c: r for c, r in ranges.items() if r[0] is not None}, rates, intervals, timer=timer, absent=absent)

    def _dependence(self, scores: DataFrame, columns: list[str]) -> np.ndarray:
        if self.use_covariance:
            return dependence.covariance_matrix(scores, columns)
        return dependence.correlation_matrix(scores, columns)

    def _fit_mixture_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        marginals = fit_mixtures(table, columns, self.max_components)
        scores = copula.normal_scores(table, marginals)
        return generate.single_copula(columns, self._dependence(scores, columns), marginals)

    def _fit_joint_mixture(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        """Columns are standardised for the fit and scaled back: the variance floor is absolute."""
        moments = {c: (m, s if s > 0 else 1.0) for c, (m, s) in encode.standard_moments(table, columns).items()}
        scaled = encode.standardize(table, moments)
        if self.k:
            model = clustering.mixtures_from_kmeans(scaled, columns, [self.k], self.seed)[self.k]
        else:
            model = clustering.best_joint_mixture(scaled, columns, self.joint_components, self.seed)
        centre = np.array([moments[c][0] for c in columns])
        scale = np.array([moments[c][1] for c in columns])
        return generate.from_mixture(JointMixture(columns, model.weights, centre + model.means * scale,
                                                  model.covariances * np.outer(scale, scale)))

    def _parametric_scores(self, table: DataFrame, columns: list[str]) -> tuple[dict, DataFrame]:
        marginals = {c: m for (_, c), m in fit_marginals(table, columns).items()}
        scores = copula.normal_scores(table, marginals).persist(StorageLevel.MEMORY_AND_DISK)
        return marginals, scores

    def _fit_parametric_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        marginals, scores = self._parametric_scores(table, columns)
        try:
            k = self.k or clustering.eigen_gap_k(scores, columns)[0]
            model = clustering.mixtures_from_kmeans(scores, columns, [k], self.seed)[k]
        finally:
            scores.unpersist()
        mean, cov = model.moments()
        if not self.use_covariance:  # unit variances keep every marginal as fitted
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            mean, cov = np.zeros(len(columns)), cov / np.outer(sd, sd)
        return generate.Draws(columns, [0], [1.0], mean[None], generate.cholesky_factor(cov)[None], marginals)

    def _clustered(self, labelled: DataFrame, columns: list[str], marginals: dict, local: bool = False) -> generate.Draws:
        model = clustering.start_from_labels(labelled, columns, 10 ** 6)
        sizes = {r["cluster"]: r["n"] for r in clustering.cluster_sizes(labelled).collect()}
        labels = [int(g) for g in sorted(sizes)]
        return generate.Draws(columns, labels, [float(sizes[g]) for g in labels], model.means,
                              np.stack([generate.cholesky_factor(c) for c in model.covariances]), marginals, local)

    def _fit_by_k(self, table: DataFrame, columns: list[str], choose) -> generate.Draws:
        marginals, scores = self._parametric_scores(table, columns)
        try:
            k = self.k or choose(scores, columns, range(2, self.max_k + 1), self.seed)[0]
            labelled, _ = clustering.kmeans_labels(scores, columns, k, self.seed)
            return self._clustered(labelled, columns, marginals)
        finally:
            scores.unpersist()

    def _fit_elbow_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        return self._fit_by_k(table, columns, clustering.elbow_k)

    def _fit_silhouette_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        return self._fit_by_k(table, columns, clustering.silhouette_k)

    def _fit_local_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        k = self.k or clustering.eigen_gap_k(table, columns)[0]
        labelled, _ = clustering.kmeans_labels(table, columns, k, self.seed)
        labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = fit_marginals(labelled, columns, cluster="cluster")
            scores = copula.cluster_scores(labelled, columns, fitted, "cluster")
            scores = missing.fill_cluster_mean(scores, columns, "cluster")
            return self._clustered(scores, columns, {(int(g), c): m for (g, c), m in fitted.items()}, local=True)
        finally:
            labelled.unpersist()

    def _fit_spectral_copula(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        marginals, scores = self._parametric_scores(table, columns)
        try:
            labelled, _ = spectral_labels(scores, columns, self.k, most=self.vertices, seed=self.seed)
            return self._clustered(labelled, columns, marginals)
        finally:
            scores.unpersist()

    def _fit_spectral_mixture(self, table: DataFrame, columns: list[str]) -> generate.Draws:
        """Up to three components inside each spectral cluster, weighted by its size."""
        marginals, scores = self._parametric_scores(table, columns)
        try:
            labelled, _ = spectral_labels(scores, columns, self.k, most=self.vertices, seed=self.seed)
            labelled = labelled.persist(StorageLevel.MEMORY_AND_DISK)
            sizes = {r["cluster"]: r["n"] for r in clustering.cluster_sizes(labelled).collect()}
            fitted = clustering.cluster_mixtures(labelled, columns)
        finally:
            scores.unpersist()
        weights = [float(sizes[g] * w) for g in sorted(fitted) for w in fitted[g].weights]
        means = np.concatenate([fitted[g].means for g in sorted(fitted)])
        covs = np.concatenate([fitted[g].covariances for g in sorted(fitted)])
        return generate.Draws(columns, list(range(len(weights))), weights, means,
                              np.stack([generate.cholesky_factor(c) for c in covs]), marginals)

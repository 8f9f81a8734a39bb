"""How useful synthetic rows are for learning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.feature import MinMaxScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.functions.quantiles import exact_quantiles
from synthframe.functions.rng import md5_number
from synthframe.functions.sampling import smallest_by_hash
from synthframe.functions.scan import ROWS_PER_BUCKET, running_sum
from synthframe.operators import trees
from synthframe.operators.quality import holdout_split

train_test_split = holdout_split  # U1: (train, test)


def sample_rows(df: DataFrame, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement, those with the smallest hashes."""
    return smallest_by_hash(df, n, md5_number(F.col(row_id), "sample", seed), row_id)


def augment(train: DataFrame, synthetic: DataFrame, n: int, row_id: str, seed: int = 0) -> DataFrame:
    """Training rows followed by n sampled synthetic rows, tagged by `origin`."""
    columns = [c for c in train.columns if c != "origin"]
    extra = sample_rows(synthetic, n, row_id, seed).select(*columns)
    return (train.select(*columns, F.lit("real").alias("origin"))
            .unionByName(extra.withColumn("origin", F.lit("synthetic"))))


# -------------------------------------------------------------------- metrics

def regression_metrics(df: DataFrame, label: str, prediction: str, predictors: int | None = None) -> DataFrame:
    """One row of mae, mse, rmse, r2, mape (and adjusted_r2 given the predictor count).

    Rows with a zero label stay out of the percentage error.
    """
    y, e = F.col(label).cast("double"), F.col(prediction).cast("double") - F.col(label).cast("double")
    sums = df.agg(F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                  F.var_pop(y).alias("__var"), F.avg(F.when(y != 0, F.abs(e / y))).alias("__ape"))
    r2 = 1 - F.try_divide(F.col("mse"), F.col("__var"))
    out = ["n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), (F.col("__ape") * 100).alias("mape")]
    if predictors is not None:
        out.append((1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - predictors - 1)).alias("adjusted_r2"))
    return sums.select(*out)


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n): at most classes x classes rows."""
    return (df.groupBy(F.col(label).cast("string").alias("label"), F.col(prediction).cast("string").alias("prediction"))
            .agg(F.count("*").alias("n")))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row of accuracy and class-weighted precision, recall and F1."""
    cells = confusion(df, label, prediction)
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("label").alias("k")).agg(F.sum("n").alias("actual"), hit.alias("hit"))
    guessed = cells.groupBy(F.col("prediction").alias("k")).agg(F.sum("n").alias("guessed"))
    per = actual.join(guessed, "k", "left").select(
        "actual", "hit", F.coalesce(F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")), F.lit(0.0)).alias("p"),
        (F.col("hit") / F.col("actual")).alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    weight, total = F.col("actual"), F.sum("actual")
    return per.withColumn("f", f1).agg((F.sum("hit") / total).alias("accuracy"),
                                       (F.sum(weight * F.col("p")) / total).alias("precision"),
                                       (F.sum(weight * F.col("r")) / total).alias("recall"),
                                       (F.sum(weight * F.col("f")) / total).alias("f1"))


def class_auc(df: DataFrame, label: str, scores: dict, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(class, positives, auc) one-vs-rest; `scores` maps a class to its score column.

    Rank sums come from counts per distinct score and a bucketed running sum; ties
    count half.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("class"), F.col(c).cast("double").alias("score"),
                                         (F.col(label).cast("string") == str(k)).cast("int").alias("pos"))
                                for k, c in scores.items()]))
    counts = (df.select(cells.alias("cell")).groupBy("cell.class", "cell.score")
              .agg(F.sum("cell.pos").alias("pos"), F.sum(1 - F.col("cell.pos")).alias("neg")))
    ranked = running_sum(counts, ["score"], "neg", groups=("class",), rows_per_bucket=rows_per_bucket)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.groupBy("class").agg(F.sum("pos").alias("positives"),
                                       F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def gini_score(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """(auc, gini = 2 auc - 1); classes weighted by their share, one class for a binary label."""
    if len(scores) == 2:
        scores = dict([max(scores.items(), key=lambda item: str(item[0]))])
    known = class_auc(df, label, scores).filter(F.col("auc").isNotNull())  # a class needs both sides
    weighted = known.agg(F.try_divide(F.sum(F.col("auc") * F.col("positives")), F.sum("positives")).alias("auc"))
    return weighted.select("auc", (2 * F.col("auc") - 1).alias("gini"))


# --------------------------------------------------------------- preprocessing

def features_pipeline(numeric: Sequence[str], categories: Sequence[str]) -> list:
    """Scaler and one-hot stages; fitted on training rows only, unknown categories -> all zeros."""
    stages = [VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="skip"),
              MinMaxScaler(inputCol="numbers", outputCol="scaled")]
    made = ["scaled"]
    if categories:
        index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories],
                              handleInvalid="keep", stringOrderType="alphabetAsc")
        hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_hot" for c in categories])
        stages += [index, hot]
        made += hot.getOutputCols()
    return [*stages, VectorAssembler(inputCols=made, outputCol="features")]


# ----------------------------------------------------------------- experiments

def fit_model(train: DataFrame, label: str, task: str = "regression", drop: Sequence[str] = (), **search):
    """The best model of the forest grid ("regression") or of the boosting draws ("classification")."""
    numeric, categories = trees.inputs(train, label, drop)
    build = trees.forest_search if task == "regression" else trees.boosting_search
    return build(train, numeric, categories, label, **search)


def model_metrics(model, test: DataFrame, label: str) -> DataFrame:
    """One metric row of a fitted model on `test`; rows without a label are left out."""
    predicted = model.transform(test.filter(F.col(f"`{label}`").isNotNull()))
    if isinstance(model, trees.Forest):
        return regression_metrics(predicted, label, "prediction", len(model.encoder.numeric) + len(model.encoder.categories))
    named = [F.get("probability", F.lit(i)).alias(f"score_{i}") for i in range(len(model.classes))]
    scored = predicted.select(F.col(f"`{label}`").cast("string").alias("label"), "prediction", *named)
    metrics = classification_metrics(scored, "label", "prediction")
    gini = gini_score(scored, "label", {k: f"score_{i}" for i, k in enumerate(model.classes)}).first()
    return metrics.withColumn("auc", F.lit(gini["auc"])).withColumn("gini", F.lit(gini["gini"]))


def evaluate_model(train: DataFrame, test: DataFrame, label: str, task: str = "regression", drop: Sequence[str] = (),
                   **search) -> DataFrame:
    """Fit on `train`, score on `test`: one metric row."""
    return model_metrics(fit_model(train, label, task, drop, **search), test, label)


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def augmentation_experiment(real: DataFrame, synthetic: DataFrame, label: str, row_id: str, iterations: int = 5,
                            test_share: float = 0.2, task: str = "regression", seed: int = 0, **search) -> DataFrame:
    """U4: per iteration train on real + half as many synthetic rows, test on held-out real rows."""
    train, test = holdout_split(real, row_id, test_share, seed)
    extra = round(real.count() / 2)
    synthetic = synthetic.persist(StorageLevel.MEMORY_AND_DISK)
    results = []
    try:
        for i in range(iterations):
            rows = augment(train, synthetic, extra, row_id, seed + i).drop("origin")
            results.append(evaluate_model(rows, test, label, task, (row_id,), **search).withColumn("iteration", F.lit(i + 1)))
    finally:
        synthetic.unpersist()
    return _stack(results)


def learning_curve(synthetic: dict[int, DataFrame], real: DataFrame, label: str, drop: Sequence[str] = (),
                   task: str = "regression", **search) -> DataFrame:
    """For each synthetic table train on it, test on the real table."""
    return _stack([evaluate_model(df, real, label, task, drop, **search).withColumn("size", F.lit(size))
                   for size, df in synthetic.items()])


def synthetic_and_real_test(synthetic: DataFrame, real: DataFrame, label: str, row_id: str, test_share: float = 0.2,
                            task: str = "regression", seed: int = 0, **search) -> DataFrame:
    """One fit on synthetic rows, scored on a synthetic holdout and on the real table."""
    train, test = holdout_split(synthetic, row_id, test_share, seed)
    model = fit_model(train, label, task, (row_id,), **search)

    def scores(df: DataFrame, name: str) -> DataFrame:
        return model_metrics(model, df, label).withColumn("test_set", F.lit(name))

    return scores(test, "synthetic_holdout").unionByName(scores(real, "real"))


def baseline_comparison(real: DataFrame, synthetic: DataFrame, label: str, row_id: str, test_share: float = 0.2,
                        task: str = "regression", seed: int = 0, **search) -> DataFrame:
    """Real-only model beside the augmented one, on the same validation rows."""
    train, test = holdout_split(real, row_id, test_share, seed)
    alone = evaluate_model(train, test, label, task, (row_id,), **search)
    rows = augment(train, synthetic, round(real.count() / 2), row_id, seed).drop("origin")
    both = evaluate_model(rows, test, label, task, (row_id,), **search)
    return alone.withColumn("model", F.lit("real_only")).unionByName(both.withColumn("model", F.lit("augmented")))


def melt_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], model: str | None = None) -> DataFrame:
    """(keys..., metric, value), tagged with a model name."""
    long = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value")
    return long.withColumn("model", F.lit(model)) if model else long


def boxplot_summary(df: DataFrame, keys: Sequence[str] = ("metric", "model"), value: str = "value") -> DataFrame:
    """Five-number summary per group."""
    return exact_quantiles(df, keys, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, value)

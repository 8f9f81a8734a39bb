"""End-to-end fits, storage, determinism and streaming."""

import pytest
from pyspark.sql import functions as F

from synthframe.operators import quality
from synthframe.plans.synthesizer import PRESETS, FittedModel, Synthesizer


@pytest.fixture(scope="module")
def table(spark, orders):
    return orders.drop("o_custkey").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 10 > 0, F.col("o_totalprice"))).cache()


@pytest.mark.parametrize("preset", [p for p in PRESETS if p not in ("silhouette_copula", "spectral_copula")])
def test_preset_makes_a_table_of_the_same_shape(spark, table, preset):
    model = Synthesizer(preset, row_id="o_orderkey", k=2, max_components=4, vertices=400).fit(table)
    made = model.sample(spark, 1500).cache()
    assert made.dtypes == table.dtypes and made.count() == 1500
    assert made.filter(F.col("o_totalprice") > 0).count() > 1000  # a filter on a generated column
    low, high = table.agg(F.min("o_totalprice"), F.max("o_totalprice")).first()
    inside = made.agg(F.min("o_totalprice"), F.max("o_totalprice"), F.avg(F.col("o_totalprice").isNull().cast("int"))).first()
    assert low <= inside[0] and inside[1] <= high and 0.05 < inside[2] < 0.15
    assert made.filter(F.col("o_orderstatus").isNull() | F.col("o_orderdate").isNull()).count() == 0
    columns = ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    overall = {r.property: r.score for r in quality.quality_score(table, made, *columns).collect()}["Overall"]
    assert overall > 0.8


def test_rows_do_not_depend_on_partitions_and_survive_storage(spark, table, tmp_path):
    model = Synthesizer("elbow_copula", row_id="o_orderkey", k=2, seed=4).fit(table)
    rows = sorted(map(str, model.sample(spark, 300).collect()))
    model.save(str(tmp_path / "model"))
    again = FittedModel.load(spark, str(tmp_path / "model"))
    assert rows == sorted(map(str, again.sample(spark, 300).repartition(7).collect()))
    assert rows != sorted(map(str, model.sample(spark, 300, seed=9).collect()))
    assert {r.phase for r in model.timer.summary(spark).collect()} == {"fitting"}


def test_fit_without_row_id(spark, table):
    made = Synthesizer("elbow_copula", k=2).fit(table.drop("o_orderkey")).sample(spark, 200)
    assert made.count() == 200 and "o_orderkey" not in made.columns


def test_unknown_preset():
    with pytest.raises(ValueError):
        Synthesizer("nothing")


def test_scores_and_adherence_on_a_stream(spark, tmp_path):
    from synthframe.operators.marginals import fit_marginals
    from synthframe.streaming.scoring import adherence_per_window, score_stream
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    models = {c: m for (_, c), m in fit_marginals(events, ["value"], gates=False, allowed=("expon",)).items()}
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name)

    assert drain(score_stream(stream, models), "scored", "append").filter("value is not null").count() == events.count()
    counted = drain(adherence_per_window(stream, {"value": (0.0, 20.0)}, "ts", "1 hour"), "adhering", "complete")
    assert counted.agg(F.sum("n")).first()[0] == events.count()
    assert counted.agg(F.sum("inside")).first()[0] == events.filter("value between 0 and 20").count()


@pytest.mark.parametrize("preset", ["mixture_copula", "elbow_copula", "joint_mixture"])
def test_nan_empty_and_boolean_columns_survive_a_fit(spark, orders, preset):
    from pyspark.sql import functions as F
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    dirty = orders.drop("o_custkey").withColumn("o_totalprice", price).withColumn("none", F.lit(None).cast("double"))
    dirty = dirty.withColumn("flag", F.col("o_orderkey") % 3 == 0)
    model = Synthesizer(preset, row_id="o_orderkey", k=None if preset == "mixture_copula" else 2, max_components=2).fit(dirty)
    made = model.sample(spark, 400)
    assert made.dtypes == dirty.dtypes
    row = made.agg(F.count("none").alias("none"), F.count("o_totalprice").alias("price"), F.countDistinct("flag").alias("flags"),
                   F.sum(F.isnan("o_totalprice").cast("int")).alias("nan")).first()
    assert row["none"] == 0 and 300 <= row["price"] < 400 and row["flags"] == 2 and not row["nan"]


def test_density_of_a_constant_or_empty_column(spark):
    from pyspark.sql import functions as F
    from synthframe.operators.marginals import kernel_density
    flat = kernel_density(spark.range(50).select(F.lit(2.0).alias("v")), "v", points=11).collect()
    assert len(flat) == 11 and abs(flat[0]["density"] - 0.3989422804) < 1e-9
    assert kernel_density(spark.createDataFrame([(None,), (float("nan"),)], "v double"), "v").count() == 0


def test_names_with_dots_and_backticks(spark, orders, tmp_path):
    from pyspark.sql import functions as F
    names = ["key.id", "price.usd", "price_usd", "st`at.us"]
    df = orders.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 2).alias("half"), "o_orderstatus").toDF(*names)
    model = Synthesizer("elbow_copula", row_id="key.id", k=2).fit(df)
    made = model.sample(spark, 200)
    assert made.columns == names and [t for _, t in made.dtypes] == [t for _, t in df.dtypes]
    model.save(str(tmp_path / "model"))
    again = FittedModel.load(spark, str(tmp_path / "model")).sample(spark, 200, keep_row_id=True)
    assert again.columns == ["row_id", *names]
    assert sorted(map(str, again.drop("row_id").collect())) == sorted(map(str, made.collect()))

"""Tree ensembles against plain versions over the rows."""

import datetime

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from synthframe.operators import trees, utility


def plain_gain(criterion, rows, a, b):
    if criterion == "poisson":
        return b * np.log(b / a) if a > 0 and b > 1e-12 else -np.inf
    weight = rows if criterion == "gradient" else a
    return b * b / weight if weight > 0 else 0.0


def plain_tree(x, a, b, equality, rules, depth):
    """Values of the rows in a tree grown by trying every cut of every column."""
    out = np.full(len(x), rules.factor * b.sum() / a.sum() if a.sum() > 1e-150 else 0.0)
    if depth == 0 or len(x) < rules.split:
        return out, []
    base, best = plain_gain(rules.criterion, len(x), a.sum(), b.sum()), None
    for j in range(x.shape[1]):
        for cell in np.unique(x[:, j]):
            left = x[:, j] == cell if equality[j] else x[:, j] <= cell
            if min(left.sum(), (~left).sum()) < rules.leaf:
                continue
            gain = sum(plain_gain(rules.criterion, m.sum(), a[m].sum(), b[m].sum()) for m in (left, ~left)) - base
            if np.isfinite(gain) and gain > 1e-10 * abs(base) + 1e-14 and (best is None or gain > best[0] + 1e-12):
                best = (gain, j, cell, left)
    if best is None:
        return out, []
    _, j, cell, left = best
    cuts = [(j, cell)]
    for side in (left, ~left):
        out[side], more = plain_tree(x[side], a[side], b[side], equality, rules, depth - 1)
        cuts += more
    return out, cuts


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 400
    u, v = rng.normal(size=n), rng.integers(0, 20, n).astype(float)
    c = rng.choice(list("abcd"), n)
    y = np.round(np.exp(0.5 * u) * (1 + (c == "b") * 3) + 0.2 * v + rng.uniform(0, 1, n), 3)
    k = np.where(u + 0.1 * v > 1.5, "high", np.where(c == "a", "odd", "low"))
    return spark.createDataFrame([(float(p), float(q), str(r), float(s), str(t)) for p, q, r, s, t in zip(u, v, c, y, k, strict=True)],
                                 "u double, v double, c string, y double, k string").repartition(3)


def unpacked(df, encoder, label, classes=None):
    blocks = list(trees._blocks(trees.pack(df, encoder, label, classes).toArrow().to_batches(), len(encoder.starts) - 1))
    return trees.Block(*(np.concatenate([getattr(b, f) for b in blocks]) for f in ("key", "y", "x", "scores")))


@pytest.mark.parametrize("criterion", trees.CRITERIA)
def test_forest_equals_plain_trees(spark, rows, criterion):
    model = trees.forest_search(rows, ["u", "v"], ["c"], "y", trees=(3,), depths=(3,), criteria=(criterion,), folds=2, seed=9)
    block = unpacked(rows, model.encoder, "y")
    for i, tree in enumerate(model.trees):
        w = np.searchsorted(trees._POISSON, trees.hashed(block.key, 9 * 1_000_003 + 1 + i), side="right").astype(float)
        some = w > 0
        plain, _ = plain_tree(block.x[some], w[some], (w * block.y)[some], model.encoder.equality, trees.Rules(criterion), 3)
        assert np.allclose(tree.predict(block.x[some], model.encoder.equality), plain, atol=1e-9)
    mean = np.mean([t.predict(block.x, model.encoder.equality) for t in model.trees], axis=0)
    assert np.allclose(sorted(r.prediction for r in model.transform(rows).collect()), sorted(mean))


def test_small_forests_are_parts_of_the_large_one(rows):
    search = {"folds": 2, "seed": 5, "criteria": ("squared_error",)}
    whole = trees.forest_search(rows, ["u", "v"], ["c"], "y", trees=(2, 5), depths=(1, 4), **search).scores
    assert len(whole) == 4
    for r in whole.itertuples():
        alone = trees.forest_search(rows, ["u", "v"], ["c"], "y", trees=(r.trees,), depths=(r.depth,), **search).scores
        assert alone["mae"][0] == pytest.approx(r.mae, rel=1e-12)


@pytest.mark.parametrize("label", ["k", "two"])
def test_boosting_equals_plain_rounds(rows, label):
    """Five rounds, so the scores are written anew once; three classes and two."""
    df = rows.withColumn("two", (F.col("y") > 2).cast("int"))
    model = trees.boosting_search(df, ["u", "v"], ["c"], label, draws=1, folds=2, trees=(5,), rates=(0.3,), depths=(3,), split=(4,), leaf=(3,))
    block = unpacked(df, model.encoder, label, trees.pd.Index(model.classes))
    wide = len(model.prior)
    raw = np.tile(np.log(np.bincount(block.y.astype(int)) / len(block.y)), (len(block.y), 1))
    raw = raw if wide > 1 else raw[:, 1:] - raw[:, :1]
    for _ in range(5):
        p = trees.probabilities(raw)[:, -wide:]
        for k in range(wide):
            g, h = (block.y == k + (wide == 1)) - p[:, k], p[:, k] * (1 - p[:, k])
            rules = trees.Rules("gradient", 4, 3, 1.0 if wide == 1 else (wide - 1) / wide)
            raw[:, k] += 0.3 * plain_tree(block.x, h, g, model.encoder.equality, rules, 3)[0]
    ours = np.array([r.probability for r in model.transform(df).collect()])
    plain = trees.probabilities(raw)
    assert np.allclose(np.sort(ours, axis=0), np.sort(plain, axis=0), atol=1e-8)


def test_boosting_is_no_worse_than_one_against_the_rest(rows):
    train, test = rows.filter("xxhash64(u) % 3 <> 0"), rows.filter("xxhash64(u) % 3 = 0")
    metrics = utility.evaluate_model(train, test, "k", "classification", ("y",), draws=2, folds=3, trees=(20,), rates=(0.2,), depths=(3,)).first()
    number = F.when(F.col("k") == "high", 0.0).when(F.col("k") == "low", 1.0).otherwise(2.0)

    def shaped(df):
        held = df.select("u", "v", (F.col("c") == "a").cast("int").alias("a"), (F.col("c") == "b").cast("int").alias("b"), number.alias("label"))
        return VectorAssembler(inputCols=["u", "v", "a", "b"], outputCol="features").transform(held)

    rest = OneVsRest(classifier=GBTClassifier(maxIter=20, stepSize=0.2, maxDepth=3, seed=1)).fit(shaped(train)).transform(shaped(test))
    accuracy = rest.filter("prediction = label").count() / rest.count()
    assert metrics.accuracy >= accuracy - 0.01 and metrics.gini > 0.9


def test_odd_columns_and_rows(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(float(i), day + datetime.timedelta(i), i % 2 == 0, "x" if i % 3 else None, float(i > 20)) for i in range(40)]
    rows += [(None, None, None, "y", 1.0), (float("nan"), day, True, "x", None), (5.0, day, True, "x", float("nan"))] + [rows[0]] * 5
    df = spark.createDataFrame(rows, "`a.b` double, d date, f boolean, c string, `the label` double")
    numeric, categories = trees.inputs(df, "the label")
    assert (numeric, categories) == (["a.b", "d", "f"], ["c"])
    model = trees.forest_search(df, numeric, categories, "the label", trees=(4,), depths=(2,), folds=2)
    unknown = spark.createDataFrame([(30.0, day, None, "never seen", 0.0)], df.schema)
    out = [r.prediction for r in model.transform(df.unionByName(unknown)).collect()]
    assert len(out) == len(rows) + 1 and all(0 <= p <= 1 for p in out)
    flags = trees.boosting_search(df, numeric, categories, "the label", draws=1, folds=2, trees=(3,), depths=(2,), leaf=(1,))
    assert flags.classes == ["0.0", "1.0"] and {r.prediction for r in flags.transform(df).collect()} <= {"0.0", "1.0"}
    with pytest.raises(ValueError):
        trees.forest_search(df.limit(0), numeric, categories, "the label", trees=(2,), depths=(1,))
    with pytest.raises(ValueError):
        trees.boosting_search(df.filter("`the label` = 1"), numeric, categories, "the label")


def test_cell_vectors_give_the_trees_of_the_scans(rows, monkeypatch):
    """no scan per level and round where cell vectors are few; the same trees either way."""
    def searches():
        forest = trees.forest_search(rows, ["u", "v"], ["c"], "y", trees=(2, 6), depths=(1, 4), folds=3, seed=5)
        boosting = trees.boosting_search(rows, ["u", "v"], ["c"], "k", draws=2, folds=2, trees=(5, 6), rates=(0.3,), depths=(3,))
        return forest, boosting

    scan = trees._scan
    monkeypatch.setattr(trees, "_scan", lambda *args: pytest.fail("a scan of the rows"))
    forest, boosting = searches()
    monkeypatch.setattr(trees, "_scan", scan)
    monkeypatch.setattr(trees, "PROFILES", 0)
    plain_forest, plain_boosting = searches()
    trees.pd.testing.assert_frame_equal(forest.scores, plain_forest.scores, rtol=1e-12)
    trees.pd.testing.assert_frame_equal(boosting.scores, plain_boosting.scores)
    pairs = list(zip(forest.trees, plain_forest.trees, strict=True))
    pairs += [p for a, b in zip(boosting.rounds, plain_boosting.rounds, strict=True) for p in zip(a, b, strict=True)]
    for a, b in pairs:
        assert np.array_equal(a.column, b.column) and np.array_equal(a.cut[a.column >= 0], b.cut[a.column >= 0])
        assert np.allclose(a.value, b.value)

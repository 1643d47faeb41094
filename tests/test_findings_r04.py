"""What the fourth round of findings was about."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, trees, zoo
from cohortlens.plans import load

load()

from cohortlens.plans import modelling  # noqa: E402
from cohortlens.sources import models as stored  # noqa: E402

SMALL = zoo.ZooSizes(logistic_iterations=20, forest_trees=3, forest_depth=4, boosted_rounds=4, regularised_rounds=3)
SPEC = features.FeatureSpec(["x", "k"], ["g"])


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers, few values and levels; the label follows two of them."""
    rng = np.random.default_rng(11)
    x, k, g = rng.normal(size=1200), rng.integers(0, 5, 1200), rng.integers(0, 3, 1200)
    y = (rng.random(1200) < 0.15 + 0.5 * (x > 0.4) * (g == 1) + 0.2 * (k == 2)).astype(int)
    made = [(i, float(a), int(b), "abc"[c], int(d), i % 3) for i, (a, b, c, d) in enumerate(zip(x, k, g, y))]
    return spark.createDataFrame(made, "id bigint, x double, k int, g string, y int, fold int").repartition(3).cache()


def trained(rows, monkeypatch, shared_bytes):
    monkeypatch.setattr(trees, "SHARED_BYTES", shared_bytes)
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 2)
    return zoo.fit_zoo(rows, SPEC, SMALL, [zoo.FOREST, zoo.BOOSTED, zoo.REGULARISED])[0]


def test_trees_of_a_task_and_of_all_tasks_are_the_same(rows, monkeypatch):
    """F1, F3, F6, F11 to F14: small tables train in a task, large ones by counts of all tasks; models keep their sizes."""
    alone, spread = trained(rows, monkeypatch, 1 << 30), trained(rows, monkeypatch, -1)
    for name, trees_ in ((zoo.FOREST, 3), (zoo.BOOSTED, 4), (zoo.REGULARISED, 3)):
        assert alone[name].stages[-1].getNumTrees == trees_
        scores = [zoo.predictions({name: m[name]}, rows, ["id"]).toPandas().sort_values("id").score.to_numpy() for m in (alone, spread)]
        assert np.allclose(*scores, atol=1e-9) and scores[0].std() > 0.01


def test_boosting_follows_its_definition(rows, monkeypatch):
    """the trees are those of plain boosting with all splits tried by brute force."""
    model = trained(rows, monkeypatch, 1 << 30)[zoo.BOOSTED]
    encoded = model.transform(rows).select("y", "features", F.col("raw2").alias("raw")).toPandas()
    x, sign = np.stack([v.toArray() for v in encoded.features]), 2.0 * encoded.y.to_numpy() - 1
    frame = rows.toPandas()
    quantiles = np.unique(np.quantile(frame.x, [i / 32 for i in range(1, 32)], method="inverted_cdf"))

    def gain(pull, side):
        return pull[side].sum() ** 2 / side.sum() + pull[~side].sum() ** 2 / (~side).sum() if 0 < side.sum() < len(side) else -np.inf

    margin = np.zeros(len(x))
    for at, tree in enumerate(model.stages[-1].trees):
        pull = sign if at == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        best = max(gain(pull, x[:, j] <= cut) for j in range(x.shape[1]) for cut in (quantiles if j == 0 else np.arange(5) + 0.5))
        root = tree._call_java("rootNode")
        taken = gain(pull, x[:, root.split().featureIndex()] <= root.split().threshold())
        assert taken == pytest.approx(best, rel=1e-3)  # quantiles are approximate
        margin += (1.0 if at == 0 else SMALL.rate) * np.array([tree.predict(v) for v in encoded.features])
    assert np.allclose(margin, [v[1] for v in encoded.raw], atol=1e-9)


def test_folds_are_not_seen(rows):
    """the labels of a fold do not change the models that score it."""
    other = rows.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    fitted = []
    for table in (rows, other):
        prepared, spec = features.fit_encoder(table, SPEC)
        balance = zoo.Balance(100, 700)
        fits = [zoo.tree_fit(n, balance, SMALL, fold) for n in (zoo.FOREST, zoo.BOOSTED) for fold in (0, 1)]
        fitted.append(trees.fit_trees(prepared.transform(table), ["x__num", "k__num"], zoo.indexed(prepared, spec), fits))
    texts = [[m.toDebugString.split("\n", 1)[1] for m in found] for found in fitted]
    assert texts[0][1] == texts[1][1] and texts[0][3] == texts[1][3]
    assert texts[0][0] != texts[1][0] and texts[0][2] != texts[1][2]


def test_a_missing_number_is_refused(rows):
    with pytest.raises(Exception, match="null|number in every row"):
        zoo.fit_zoo(rows.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), SPEC, SMALL, [zoo.FOREST])


def test_rows_of_a_forest_stay_small():
    """F7 to F10: a row keeps two bytes for a tree that grows, and no tree's sample; few trees of a large table grow at a time."""
    block = (0, np.zeros((3, 1000), np.uint8), np.zeros(1000, np.uint8), np.full(1000, -1, np.int16))
    sprouts = [trees.Sprout(s, -1, 0, (1.0, 1.0)) for s in range(5)]
    _, nodes = trees.started(block, sprouts, "int16")
    assert nodes.nbytes == 2 * 5 * 1000 and nodes.min() == -1
    assert trees.bag(sprouts[1], block).mean() == pytest.approx(1.0, abs=0.15)


def test_training_cross_validates(spark, sf, monkeypatch, tmp_path):
    """all four models have five folds behind them, and their versions tell what came of them."""
    monkeypatch.setattr(modelling, "SIZES", SMALL)
    monkeypatch.setattr(modelling, "shared_root", lambda spark: str(tmp_path))
    asked, validate = [], zoo.fold_metrics
    monkeypatch.setattr(zoo, "fold_metrics", lambda df, spec, id_col, k=5, **more: asked.append((k, df.count())) or validate(df, spec, id_col, k, **more))
    told = load()[0]["train_classifiers"](spark, sf).collect()
    assert asked == [(5, modelling.risk(spark, sf).count())] and len(told) == 4
    for m in modelling.MODELS:
        found = stored.load_version(spark, modelling.store_of(spark, sf, m))
        assert [r["model"] for r in found.tables["cv"].collect()] == [m] and "cv_recall_std" in found.tables["cv"].columns

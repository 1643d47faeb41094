"""What the third round of findings was about."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import filters, quantiles, shap, zoo
from cohortlens.plans import load

load()

from cohortlens.plans import modelling  # noqa: E402

SMALL = zoo.ZooSizes(logistic_iterations=20, forest_trees=3, forest_depth=3, boosted_rounds=2, regularised_rounds=2)


def test_only_the_models_asked_for_are_trained(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr(modelling, "SIZES", SMALL)
    monkeypatch.setattr(modelling, "shared_root", lambda spark: str(tmp_path))
    asked, train = [], zoo.train_classifiers
    monkeypatch.setattr(zoo, "train_classifiers", lambda *a, **k: asked.append(k["only"]) or train(*a, **k))
    assert list(modelling.trained(spark, sf, zoo.LOGISTIC).models) == [zoo.LOGISTIC]
    both = modelling.trained(spark, sf, zoo.LOGISTIC, zoo.FOREST)
    assert list(both.models) == [zoo.LOGISTIC, zoo.FOREST]
    assert modelling.trained(spark, sf, zoo.FOREST).version == 1
    assert asked == [[zoo.LOGISTIC], [zoo.FOREST]]


@pytest.mark.parametrize("inside", [0, 100])
def test_wide_quantiles_read_their_table_once(spark, monkeypatch, inside):
    """Two measures with infinities and extremes, a narrow one, and a table whose every pass is counted."""
    rng = np.random.default_rng(4)
    wide = np.concatenate([rng.normal(0, 1, 3000), 10.0 ** rng.uniform(-300, 300, 1000), [-np.inf, np.inf, 0.0, 1.7e308, -1.7e308]])
    rows = [(float(x), float(i % 7)) for i, x in enumerate(wide)]
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        scans.add(1)
        yield from batches

    df = spark.createDataFrame(rows, "x double, k double").coalesce(1)
    df = df.mapInArrow(seen, df.schema)
    asked = []
    monkeypatch.setattr(quantiles, "_by_map", lambda df, measures, *more, plain=quantiles._by_map: asked.extend(measures) or plain(df, measures, *more))
    probs = [0.0, 0.003, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, {"x": F.col("x"), "k": F.col("k")}, probs, map_limit=100, inside_limit=inside, distinct={"x": 4005, "k": 7})
    made = scans.value
    rows = {r["measure"]: r["q"] for r in found.collect()}
    assert made == scans.value == 1 and asked == ["k"]
    ordered = np.sort(wide)
    for p, q in zip(probs, rows["x"], strict=True):
        low, high = ordered[int(np.floor(p * (len(wide) - 1)))], ordered[int(np.ceil(p * (len(wide) - 1)))]
        assert low <= q <= high
    assert rows["k"] == list(np.quantile([i % 7 for i in range(len(wide))], probs))


def test_customers_of_risk_do_not_pass_the_driver(spark, sf):
    plan = modelling.risk(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1  # nations


def test_short_page_ranges_make_no_more_tasks(spark, monkeypatch):
    """Many short ranges come from few parts; equal keys share a range."""
    dealt, deal = [], type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda df, n, *cols: dealt.append(n) or deal(df, n, *cols))
    df = spark.range(30_000).select(F.when(F.col("id") % 10 != 0, F.floor(F.col("id") / 3)).alias("k")).repartition(7)
    index = filters.page_index(df, "k", range_rows=50)
    assert dealt == [1] and index.nulls == 3000 and sum(n for n, _ in index.ranges) == 27_000
    ends = [last for _, last in index.ranges]
    assert len(ends) == 200 and ends == sorted(set(ends))
    keys = sorted((i // 3 for i in range(30_000) if i % 10), key=int)
    assert [r["k"] for r in filters.page(df, "k", 600, 25, index=index).collect()] == keys[12_000:12_025]


def deep_tree(depth: int, features: int, seed: int) -> shap.FlatTree:
    """A full tree of random splits."""
    g, inner, n = np.random.default_rng(seed), 2 ** depth - 1, 2 ** (depth + 1) - 1
    at = np.arange(n)
    low, high = (np.where(at < inner, 2 * at + k, -1) for k in (1, 2))
    share = np.ones(n)
    share[1::2] = g.uniform(0.2, 0.8, inner)
    share[2::2] = 1 - share[1::2]
    return shap.FlatTree(g.integers(0, features, n), g.uniform(0.2, 0.8, n), low, high, share, np.where(at >= inner, g.normal(size=n), 0.0))


def test_tables_of_a_tree_are_built_once_for_all_rows(monkeypatch):
    """F12, F16: the work on tables does not follow the rows, leaves of 12 features have one, and sums over subtrees are right."""
    tree, g = deep_tree(12, 40, 1), np.random.default_rng(2)
    x, built = g.uniform(size=(40, 20_000)), []
    monkeypatch.setattr(shap, "pattern_tables", lambda *a, plain=shap.pattern_tables: built.append(len(a[0])) or plain(*a))
    out = np.zeros_like(x)
    shap.tree_contributions(x, tree, out)
    assert sum(built) == 4096
    leaves = [(tree.value[n], np.array(f), lo, hi, z) for n, f, lo, hi, z in shap._leaves(tree)]
    assert np.allclose(out[:, 9990:10_010].T, shap.leaf_contributions(x[:, 9990:10_010].T, leaves), atol=1e-10)


def test_parts_follow_the_cores(spark):
    """F7, F8, F10: more parts than cores only multiply the node statistics that are sent."""
    cores = spark.sparkContext.defaultParallelism
    assert [modelling.parts(spark.range(n)) for n in (0, 10, 25_001, 50 * 25_000)] == [1, 1, 2, cores]
    assert modelling.parts(spark.range(250_000 * 3 * cores)) == 3 * cores


def test_new_models_are_not_loaded_back(spark, sf, monkeypatch, tmp_path):
    """F7, F8, F9: models just trained are used as they are; only their rows are read from the new version."""
    from cohortlens.operators import zoo
    from cohortlens.plans import modelling
    from cohortlens.sources import models as stored

    loaded = []
    monkeypatch.setattr(modelling, "store_of", lambda spark, sf_dir, model: f"{tmp_path}/store")
    monkeypatch.setattr(stored, "load_models", lambda *a, plain=stored.load_models: loaded.append(a) or plain(*a))
    found = modelling.trained(spark, sf, zoo.LOGISTIC)
    assert not loaded and found.version == 1
    assert found.tables["rows"].where("is_test").count() == modelling.halves(spark, sf)[1].count()
    again = modelling.trained(spark, sf, zoo.LOGISTIC)
    assert len(loaded) == 1 and again.models[zoo.LOGISTIC].stages[-1].coefficients == found.models[zoo.LOGISTIC].stages[-1].coefficients

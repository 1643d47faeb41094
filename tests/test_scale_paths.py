"""The paths that only large tables take, forced on small ones and checked by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import filters, metrics, quantiles, ranking, splits, statistics
from cohortlens.operators.profile import column_profile


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them, the rest is heavy-tailed."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random(6000) < 0.34, 7.0, np.exp(rng.normal(0, 4, 6000)))
    g = np.where(rng.random(6000) < 0.8, "hot", "cold")
    rows = [(i, str(a), None if i % 97 == 0 else float(b), float(i % 11)) for i, (a, b) in enumerate(zip(g, x))]
    return spark.createDataFrame(rows, "id bigint, g string, x double, k double").repartition(5)


@pytest.mark.parametrize("inside", [0, 50, 10_000])
def test_bracketed_quantiles_are_exact(skewed, inside):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    measures = {"x": F.col("x"), "k": F.col("k")}
    found = quantiles.exact_quantiles(skewed, measures, probs, by="g", map_limit=0, inside_limit=inside)
    frame = skewed.toPandas()
    rows = found.collect()
    assert len(rows) == 4
    for row in rows:
        values = frame[frame.g == row["grp"]][row["measure"]].dropna()
        assert row["n"] == len(values)
        assert np.allclose(row["q"], values.quantile(probs).to_numpy(), rtol=1e-12, atol=0)


def test_brackets_and_map_agree_without_groups(skewed):
    for limit in (0, 10**9):
        row = quantiles.exact_quantiles(skewed, {"x": F.col("x")}, [0.25, 0.75], map_limit=limit, inside_limit=20).first()
        assert row["grp"] is None
        assert row["q"] == pytest.approx(skewed.toPandas().x.dropna().quantile([0.25, 0.75]).tolist(), rel=1e-12)


def test_running_totals_over_ranges(skewed):
    cells = skewed.where("x IS NOT NULL").groupBy("g", "x").agg(F.count("*").alias("n"))
    for descending in (False, True):
        run = ranking.running_totals(cells, ["g"], "x", {"upto": "n"}, descending, ranges=16).toPandas()
        run = run.sort_values(["g", "x"], ascending=[True, not descending])
        assert (run.groupby("g").n.cumsum() == run.upto).all()
        assert len(run) == cells.count()


def test_auc_and_roc_against_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.01 + y * 0.001, 4)
    pred = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p in s[y == 1] for n in s[y == 0]]
    assert metrics.auc(pred).first()[0] == pytest.approx(np.mean(pairs), abs=1e-12)
    points = metrics.roc_points(pred).toPandas()
    for p in points.itertuples():
        assert p.tp == int(((s >= p.threshold) & (y == 1)).sum())
        assert p.fp == int(((s >= p.threshold) & (y == 0)).sum())


def test_deep_page_equals_top_k_page(skewed):
    early = [r["id"] for r in filters.page(skewed, "id", 40, 25).collect()]
    deep = [r["id"] for r in filters.page(skewed, "id", 40, 25, range_rows=100).collect()]
    assert early == deep == list(range(1000, 1025))


def test_split_and_folds_are_exact_and_complete(skewed):
    labelled = skewed.withColumn("y", (F.col("g") == "cold").cast("int"))
    sizes = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    split = splits.stratified_split(labelled, "y", "id", 0.2)
    for row in split.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect():
        assert row["n"] == sizes[row["y"]]
        assert row["t"] == round(0.2 * row["n"])
    folds = splits.stratified_folds(labelled, "y", "id", 7).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        parts = [r["count"] for r in folds if r["y"] == y]
        assert len(parts) == 7 and max(parts) - min(parts) <= 1 and sum(parts) == sizes[y]


def test_small_class_split(spark):
    tiny = spark.createDataFrame([(i, int(i < 2)) for i in range(12)], "id bigint, y int")
    counts = {r["y"]: r["t"] for r in splits.stratified_split(tiny, "y", "id").groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
    assert counts == {0: 2, 1: 0}
    folds = splits.stratified_folds(tiny, "y", "id", 5)
    assert folds.count() == 12 and folds.where("fold < 0 OR fold > 4").isEmpty()


def test_correlation_in_several_passes_with_nulls(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 1, 500)
    rows = [(float(x), None if i % 3 == 0 else float(-x + rng.normal()), 5.0, float(i)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    found = {(r["a"], r["b"]): (r["r"], r["n"]) for r in statistics.correlation_pairs(df, pairs_per_pass=2).collect()}
    frame = df.toPandas()
    assert found[("a", "b")][0] == pytest.approx(frame.a.corr(frame.b), abs=1e-9)
    assert found[("b", "d")][0] == pytest.approx(frame.b.corr(frame.d), abs=1e-9)
    assert found[("a", "b")][1] == frame.b.notna().sum()
    assert found[("a", "c")][0] is None and found[("c", "d")][0] is None


def test_profile_of_long_texts(spark):
    long_number, long_text = "1" * 80, "word " * 40
    rows = [(long_number, long_text), (long_number, long_text + "x"), ("12", long_text), (None, None)]
    found = {r["column"]: r for r in column_profile(spark.createDataFrame(rows, "n string, t string")).collect()}
    assert found["n"]["n_unique"] == 2 and found["n"]["numeric_share"] == 0.75
    assert found["t"]["n_unique"] == 2 and found["t"]["kind"] == "categorical"
    approx = {r["column"]: r["n_unique"] for r in column_profile(spark.createDataFrame(rows, "n string, t string"), approx=True).collect()}
    assert approx == {"n": 2, "t": 2}


def test_pages_with_null_and_text_keys(spark):
    rows = [(None if i % 4 == 0 else i, f"name{i:05d}") for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(5)
    for rows_per_range in (10_000, 150):
        seen = [filters.page(df, "k", n, 25, rows_per_range).collect() for n in range(81)]
        keys = [r["k"] for p in seen for r in p]
        assert keys[:500] == [None] * 500 and keys[500:] == [i for i in range(2000) if i % 4]
        assert [r["t"] for r in filters.page(df, "t", 50, 25, rows_per_range).collect()] == [f"name{i:05d}" for i in range(1250, 1275)]
    assert filters.page(df.where("k < 0"), "k", 0).count() == 0


def test_positions_keep_null_rows(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i,) for i in range(400)], "k bigint")
    placed = ranking.with_position(df, "k", [], ranges=8)
    assert placed.count() == 400 and sorted(r["position"] for r in placed.collect()) == list(range(1, 401))


def test_null_scores_are_left_out(spark):
    pred = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, 0.4), (1, 0.6)], "y int, score double")
    assert metrics.auc(pred).first()[0] == 1.0
    assert metrics.roc_points(pred).agg(F.max("fpr")).first()[0] == 1.0


def test_null_ids_stay_in_the_split(spark):
    df = spark.createDataFrame([(None if i < 10 else i, i % 2) for i in range(100)], "id bigint, y int")
    assert splits.stratified_split(df, "y", "id").where("is_test is null").count() == 0
    assert splits.stratified_folds(df, "y", "id").where("fold is null").count() == 0


def test_names_with_dots_and_wide_integers(spark):
    df = spark.createDataFrame([(9007199254740992, "x"), (9007199254740993, "y")], "`a.b` bigint, t string")
    assert [r["t"] for r in filters.apply_filters(df, {"a.b": "9007199254740993"}).collect()] == ["y"]
    assert filters.apply_filters(df, {"a.b": "1.5"}).count() == 0


def test_replacement_character_is_no_decoding_error(spark, tmp_path):
    from cohortlens.sources import csv

    sound, latin = tmp_path / "sound.csv", tmp_path / "latin.csv"
    sound.write_bytes("n\nPhòng �\n".encode())
    latin.write_bytes("n\ncafé\n".encode("latin-1"))
    assert csv.detect_encoding(spark, str(sound)) == "utf-8" and csv.detect_encoding(spark, str(latin)) == "latin-1"


def test_quality_of_awkward_columns(spark):
    from cohortlens.operators import cleaning, profile, quality

    df = spark.createDataFrame([(1, {"a": 1, "b": 2}, 0.5), (1, {"b": 2, "a": 1}, 0.5), (2, None, None)], "`a.b` int, m map<string,int>, `c d` double")
    assert quality.duplicate_summary(df).count() == 1 and cleaning.drop_duplicate_rows(df).count() == 2
    assert {r["column"]: r["missing_count"] for r in quality.missing_summary(df).collect()} == {"a.b": 0, "m": 1, "c d": 1}
    assert {r["column"]: r["n_unique"] for r in column_profile(df).collect()}["a.b"] == 2
    assert {r["column"]: r["kind"] for r in profile.infer_kind(df).collect()}["c d"] == "numeric"
    assert cleaning.trim_strings(df).columns == df.columns

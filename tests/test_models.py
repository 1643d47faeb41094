"""Training, scoring and explaining on the 100-row table, by invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, metrics, scoring, shap, zoo
from cohortlens.session import scratch_path
from cohortlens.sources import csv, models, reports
from cohortlens.streaming.scoring import score_stream

SIZES = zoo.ZooSizes(logistic_iterations=20, forest_trees=4, forest_depth=4, boosted_rounds=3, regularised_rounds=3)


@pytest.fixture(scope="module")
def trained(people):
    spec = features.choose_features(people, "Attrition", "EmployeeNumber")
    return zoo.train_classifiers(people, "Attrition", "EmployeeNumber", spec, sizes=SIZES, cv_folds=3)


def test_features(trained):
    assert trained.spec.numeric == ["Age", "MonthlyIncome", "YearsAtCompany", "JobSatisfaction"]
    assert trained.spec.categorical == ["Department", "OverTime"]


def test_models_and_folds(trained, people):
    assert list(trained.models) == [zoo.LOGISTIC, zoo.FOREST, zoo.BOOSTED, zoo.REGULARISED]
    assert trained.cv is not None, trained.extra
    assert trained.cv.count() == 4
    assert trained.train.count() + trained.test.count() == people.count()
    pred = zoo.predictions(trained.models, trained.test, ["y"])
    table = metrics.compare_models(pred)
    merged = metrics.merge_cv(table, trained.cv)
    assert "cv_recall" in merged.columns and "cv_recall_std" not in merged.columns
    best = table.where("is_best").collect()
    assert len(best) == 1 and best[0]["model"] in trained.models
    for row in table.collect():
        assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == trained.test.count()
        assert row["roc_auc"] > 0.6


def test_batch_and_summary(trained, people, spark):
    scorer = scoring.model_scorer(trained.models[zoo.FOREST], trained.spec)
    scored = scoring.batch_score(people, scorer, "EmployeeNumber", ["Department", "OverTime"])
    assert scored.columns[:3] == ["EmployeeNumber", "Department", "OverTime"]
    assert scored.count() == people.count()
    summary = scoring.risk_summary(scored).first()
    assert summary["total"] == 100 and summary["high"] + summary["medium"] + summary["low"] == 100
    path = scratch_path(spark, "export")
    reports.export_risk(scored, path)
    assert reports.read_risk(spark, path, "High").count() == summary["high"]
    with pytest.raises(ValueError, match="missing features"):
        scorer(people.drop("Age"))


def test_what_if(trained, people):
    scorer = scoring.model_scorer(trained.models[zoo.FOREST], trained.spec)
    found = scoring.what_if(people, scorer, {"no overtime": {"OverTime": "No"}, "nothing": {"OverTime": ""}},
                            "EmployeeNumber", trained.spec.columns)
    assert found.count() == 200
    assert found.where("scenario = 'nothing' AND delta_pp <> 0").isEmpty()
    assert found.first()["message"]
    assert people.join(found, "EmployeeNumber").where(
        "scenario = 'no overtime' AND OverTime = 'No' AND probability_before <> probability_after").isEmpty()


@pytest.mark.parametrize("name", [zoo.LOGISTIC, zoo.FOREST, zoo.BOOSTED, zoo.REGULARISED])
def test_explanations_add_up(trained, name):
    model = {name: trained.models[name]}
    explained = shap.explain_rows(trained.models[name], trained.test, trained.names, "EmployeeNumber")
    total = F.aggregate("contributions", F.col("base_value"), lambda a, c: a + c["shap"])
    rows = explained.select("EmployeeNumber", "unit", total.alias("total")).join(
        zoo.predictions(model, trained.test, ["EmployeeNumber"]), "EmployeeNumber").collect()
    assert len(rows) == trained.test.count()
    for row in rows:
        value = row["total"] if row["unit"] == "probability" else 1 / (1 + np.exp(-row["total"]))
        assert value == pytest.approx(row["score"], abs=1e-6)


def test_explanation_tables(trained):
    explained = shap.explain_rows(trained.models[zoo.FOREST], trained.test, trained.names, "EmployeeNumber")
    top = shap.shap_global(explained, "EmployeeNumber", 3)
    assert top.count() == 3
    assert "SHAP" in shap.global_narrative(top).first()["narrative"]
    local = shap.shap_local(explained, "EmployeeNumber", 4).toPandas()
    assert (local.groupby("EmployeeNumber").abs_shap.apply(lambda s: s.is_monotonic_decreasing)).all()
    report = shap.shap_report(explained, "EmployeeNumber").first()
    assert report["narrative"] and len(report["contributions"]) <= 10


def test_leaf_contributions_match_the_definition():
    """Shapley values over all orders of a two-tree game with a feature used twice on a path."""
    leaves = [
        (1.0, np.array([0, 1]), np.array([-np.inf, 0.5]), np.array([1.5, np.inf]), np.array([0.6, 0.25])),
        (2.0, np.array([0, 1, 2]), np.array([0.2, -np.inf, 0.0]), np.array([1.5, 0.5, np.inf]), np.array([0.3, 0.75, 0.5])),
        (-1.0, np.array([2]), np.array([-np.inf]), np.array([0.0]), np.array([0.5])),
    ]
    x = np.array([[1.0, 0.7, -1.0], [0.1, 0.2, 3.0], [1.0, 0.3, 0.5]])

    def value(row, known):
        total = 0.0
        for v, features_, low, high, share in leaves:
            part = v
            for f, lo, hi, z in zip(features_, low, high, share):
                part *= float(lo < row[f] <= hi) if f in known else z
            total += part
        return total

    want = np.zeros_like(x)
    for i, row in enumerate(x):
        for order in itertools.permutations(range(3)):
            known = set()
            for f in order:
                before = value(row, known)
                known.add(f)
                want[i, f] += (value(row, known) - before) / 6
    assert np.allclose(shap.leaf_contributions(x, leaves), want, atol=1e-12)


def test_store(trained, people, spark):
    path = scratch_path(spark, "models")
    models.save_models(spark, path, trained.models, trained.spec, trained.names)
    loaded, spec, names = models.load_models(spark, path, [zoo.FOREST])
    assert spec == trained.spec and names == trained.names
    before = zoo.predictions({zoo.FOREST: trained.models[zoo.FOREST]}, people, ["EmployeeNumber"])
    after = zoo.predictions(loaded, people, ["EmployeeNumber"])
    assert before.exceptAll(after).isEmpty()
    with pytest.raises(FileNotFoundError):
        models.load_models(spark, path, ["unknown"])


def test_one_class_is_refused(people):
    spec = features.FeatureSpec(["Age"], [])
    with pytest.raises(ValueError, match="both classes"):
        zoo.train_classifiers(people.where("Attrition = 'Yes'"), "Attrition", "EmployeeNumber", spec, sizes=SIZES)


def test_too_many_levels_are_refused(people):
    with pytest.raises(ValueError, match="too many levels"):
        features.choose_features(people, "Attrition", "EmployeeNumber", max_levels=1)


def test_importance(trained):
    table = zoo.forest_importance(trained.models[zoo.FOREST], trained.names, trained.test)
    assert 0 < table.count() <= 15
    assert table.agg(F.sum("importance")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_regression(people):
    spec = features.FeatureSpec(["Age", "YearsAtCompany"], ["Department"])
    model, test = zoo.train_regression(people, "MonthlyIncome", "EmployeeNumber", spec)
    row = metrics.regression_metrics(model.transform(test)).first()
    assert row["n"] == 20 and row["rmse"] == pytest.approx(row["mse"] ** 0.5)


def test_stream_equals_batch(trained, people, spark):
    scorer = scoring.model_scorer(trained.models[zoo.LOGISTIC], trained.spec)
    source, sink = scratch_path(spark, "rows"), scratch_path(spark, "scored")
    people.repartition(3).write.parquet(source)
    rows = spark.readStream.schema(people.schema).option("maxFilesPerTrigger", 1).parquet(source)
    score_stream(rows, scorer, sink, "EmployeeNumber", ["Department"]).awaitTermination(120)
    batch = scoring.batch_score(people, scorer, "EmployeeNumber", ["Department"])
    assert spark.read.parquet(sink).count() == 100
    assert batch.exceptAll(spark.read.parquet(sink).select(*batch.columns)).isEmpty()


def test_csv(spark, tmp_path):
    plain = tmp_path / "a.csv"
    plain.write_text('id,x,flag,name\n1,NA,true,"a ""b"", c"\n2,1.5,false,N/A\n3,,true,null\n')
    df = csv.read_csv(spark, str(plain))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, None, True, 'a "b", c'), (2, 1.5, False, None), (3, None, True, None)]
    assert csv.read_csv(spark, str(plain), nrows=2).count() == 2
    given = csv.read_csv(spark, str(plain), schema="id int, x float")
    assert given.schema["x"].dataType.simpleString() == "float" and given.schema["name"].dataType.simpleString() == "string"


def test_encodings(spark, tmp_path):
    latin = tmp_path / "latin.csv"
    latin.write_bytes("id,name\n1,café\n".encode("latin-1"))
    df, used = csv.read_csv_any(spark, str(latin))
    assert used == "latin-1" and df.first()["name"] == "café"
    marked = tmp_path / "marked.csv"
    marked.write_bytes("id,name\n1,Phòng\n".encode("utf-8-sig"))
    df, used = csv.read_csv_any(spark, str(marked))
    assert used == "utf-8" and df.columns == ["id", "name"] and df.first()["name"] == "Phòng"


def test_csv_round_trip_keeps_blanks(spark):
    path = scratch_path(spark, "round")
    df = spark.createDataFrame([(1, " a "), (2, 'q"uote, comma'), (3, None)], "id bigint, s string")
    csv.write_csv(df, path)
    assert sorted(map(tuple, csv.read_csv(spark, path).collect())) == sorted(map(tuple, df.collect()))

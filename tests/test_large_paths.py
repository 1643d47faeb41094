"""Encoding, storing, explaining and checking at sizes and in places where a simple way would fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import features, filters, metrics, profile, quality, scoring, shap, statistics, zoo
from cohortlens.session import scratch_path
from cohortlens.sources import csv, models, reports

SIZES = zoo.ZooSizes(logistic_iterations=30, forest_trees=5, forest_depth=5, boosted_rounds=3, regularised_rounds=3)


def counted(df):
    """The same rows in one partition, and the number of times that it is read."""
    scans = df.sparkSession.sparkContext.accumulator(0)

    def seen(batches):
        scans.add(1)
        yield from batches

    return df.coalesce(1).mapInArrow(seen, df.schema), scans


# --- features and models ---------------------------------------------------

@pytest.fixture(scope="module")
def visits(spark):
    """Half of the rows share three sites, the others have one each."""
    rows = [(i, f"s'{i % 3}" if i % 2 else f"site-{i}", float(i % 7), "yes" if i % 3 == 0 or i % 2 == 0 and i % 5 == 0 else "no") for i in range(4000)]
    return spark.createDataFrame(rows, "id bigint, site string, x double, left string")


def test_a_category_of_many_levels_is_bounded(visits):
    spec = features.FeatureSpec(["x"], ["site"])
    found = features.bounded(visits.withColumn("site", F.replace("site", F.lit("'"), F.lit(""))), spec, max_levels=100, frequent=3)
    assert set(found.wide["site"]) == {"s0", "s1", "s2"}
    assert features.bounded(visits, spec, max_levels=100, frequent=3).wide == {"site": []}  # a quote is hashed like a rare level
    assert features.bounded(visits, features.FeatureSpec(["x"], ["left"]), max_levels=2) == features.FeatureSpec(["x"], ["left"])
    result = zoo.train_classifiers(visits, "left", "id", spec, sizes=SIZES, cv_folds=2, max_levels=100, only=[zoo.LOGISTIC, zoo.FOREST])
    assert len(result.names) <= 1 + features.FREQUENT + features.BUCKETS and result.cv.count() == 2
    new = visits.withColumn("site", F.concat(F.lit("new"), "id"))
    scored = scoring.batch_score(new, scoring.model_scorer(result.models[zoo.FOREST], result.spec), "id")
    assert scored.where("probability BETWEEN 0 AND 1").count() == 4000


def test_folds_of_one_encoded_table_are_those_of_an_encoder_each(people):
    spec = features.choose_features(people, "Attrition", "EmployeeNumber")
    rows = zoo.model_input(people, spec, "Attrition", "EmployeeNumber").coalesce(1).cache()
    shared = {(r["model"], r["fold"]): r for r in zoo.fold_metrics(rows, spec, "EmployeeNumber", 3, sizes=SIZES, only=[zoo.LOGISTIC]).collect()}
    from cohortlens.operators.splits import stratified_folds
    folded = stratified_folds(rows, "y", "EmployeeNumber", 3)
    for fold in range(3):
        fitted, _, _, _ = zoo.fit_zoo(folded.where(F.col("fold") != fold), spec, SIZES, [zoo.LOGISTIC])
        own = metrics.class_metrics(zoo.predictions(fitted, folded.where(F.col("fold") == fold), ["y"]), ["model"]).first()
        for name in ("tn", "fp", "fn", "tp"):
            assert own[name] == shared[(zoo.LOGISTIC, fold)][name]
        assert own["roc_auc"] == pytest.approx(shared[(zoo.LOGISTIC, fold)]["roc_auc"], abs=1e-9)


def test_scaling_of_the_other_folds():
    g = np.random.default_rng(2)
    x, fold = g.normal(1e9, 3, 300), g.integers(0, 4, 300)
    facts = [{"fold": k, "n": int((fold == k).sum()), "m0": x[fold == k].mean(), "v0": x[fold == k].var()} for k in range(4)]
    for k in range(4):
        (mean, deviation), = zoo.others_scaling(facts, k, 1)
        assert mean == pytest.approx(x[fold != k].mean(), rel=1e-14) and deviation == pytest.approx(x[fold != k].std(ddof=1), rel=1e-7)


def test_versions_and_stale_models(spark, people):
    spec = features.FeatureSpec(["Age"], ["OverTime"])
    rows = people.select("EmployeeNumber", "Age", "OverTime", "Attrition")
    result = zoo.train_classifiers(rows, "Attrition", "EmployeeNumber", spec, sizes=SIZES, cv_folds=None, only=[zoo.LOGISTIC])
    root, inputs = scratch_path(spark, "store"), models.input_fingerprint(rows)
    with pytest.raises(FileNotFoundError):
        models.load_version(spark, root)
    assert models.publish(spark, root, result.models, result.spec, result.names, inputs, {"trees": 5}, {"test": result.test}) == 1
    assert models.publish(spark, root, result.models, result.spec, result.names, inputs, {"trees": 6}) == 2
    assert models.versions(spark, root) == [1, 2]
    again = models.load_version(spark, root, models.input_fingerprint(rows.repartition(7)), {"trees": 6})
    assert (again.version, again.spec, again.names) == (2, result.spec, result.names)
    first = models.load_version(spark, root, version=1)
    assert first.tables["test"].exceptAll(result.test).isEmpty() and first.tables["test"].count() == result.test.count()
    before = zoo.predictions(result.models, rows, ["EmployeeNumber"])
    assert before.exceptAll(zoo.predictions(again.models, rows, ["EmployeeNumber"])).isEmpty()
    with pytest.raises(models.StaleModel, match="rows"):
        models.load_version(spark, root, models.input_fingerprint(rows.withColumn("Age", F.col("Age") + (F.col("EmployeeNumber") == 7).cast("int"))))
    with pytest.raises(models.StaleModel, match="parameters"):
        models.load_version(spark, root, inputs, {"trees": 5})
    with pytest.raises(FileNotFoundError):
        models.load_version(spark, root, version=9)


# --- explanations ----------------------------------------------------------

def random_tree(g, depth, width):
    """A full tree with random splits, some leaves cut short; features repeat on a path."""
    feature, cut, low, high, share, value = [], [], [], [], [], []

    def grow(level, part):
        at = len(feature)
        for column, x in ((feature, int(g.integers(0, width))), (cut, float(g.normal())), (low, -1), (high, -1), (share, part), (value, float(g.normal()))):
            column.append(x)
        if level < depth and (level < 2 or g.random() < 0.8):
            p = float(g.uniform(0.05, 0.95))
            low[at], high[at] = grow(level + 1, p), grow(level + 1, 1 - p)
        return at

    grow(0, 1.0)
    return shap.FlatTree(*map(np.array, (feature, cut, low, high, share, value)))


@pytest.mark.parametrize(("depth", "width", "bits"), [(4, 3, 10), (7, 12, 10), (7, 12, 3), (12, 30, 10)])
def test_flat_trees_give_the_contributions_of_their_leaves(monkeypatch, depth, width, bits):
    monkeypatch.setattr(shap, "TABLE_BITS", bits)
    monkeypatch.setattr(shap, "TABLE_CELLS", 512)
    g = np.random.default_rng(depth + width)
    tree = random_tree(g, depth, width)
    x = g.normal(size=(40, width))
    out = np.zeros((width, 40))
    shap.tree_contributions(np.ascontiguousarray(x.T), tree, out)
    leaves = [(tree.value[n], np.array(f, int), lo, hi, z) for n, f, lo, hi, z in shap._leaves(tree)]
    assert np.allclose(out.T, shap.leaf_contributions(x, leaves), atol=1e-10)
    at = np.zeros(40, int)
    while (tree.low[at] >= 0).any():
        inner = tree.low[at] >= 0
        goes = np.where(x[np.arange(40), tree.feature[at]] <= tree.cut[at], tree.low[at], tree.high[at])
        at = np.where(inner, goes, at)
    assert np.allclose(out.sum(axis=0) + shap.base_of([tree]), tree.value[at], atol=1e-9)


def test_trees_beyond_one_broadcast_are_added_up(people):
    spec = features.FeatureSpec(["Age", "MonthlyIncome"], ["OverTime"])
    result = zoo.train_classifiers(people, "Attrition", "EmployeeNumber", spec, sizes=SIZES, cv_folds=None, only=[zoo.FOREST])
    last = result.models[zoo.FOREST].stages[-1]
    encoded = result.models[zoo.FOREST].transform(people).select("EmployeeNumber", "features")
    whole, sliced = (shap._shap_trees(encoded, last, result.names, "EmployeeNumber", limit).orderBy("EmployeeNumber").collect() for limit in (1 << 30, 1))
    assert len(shap.tree_slices(shap.flat_trees(*shap.tree_nodes(last, people.sparkSession)), 1)) == 5
    for a, b in zip(whole, sliced, strict=True):
        assert [c["shap"] for c in a["contributions"]] == pytest.approx([c["shap"] for c in b["contributions"]], abs=1e-12)


# --- statistics and quality ------------------------------------------------

def test_correlations_of_many_columns_take_one_scan(spark):
    g = np.random.default_rng(6)
    data = g.normal(size=(90, 300)) + g.normal(size=(90, 1)) + 1e7
    data[g.random(data.shape) < 0.1] = np.nan
    data[:, 5], data[3, 7] = 4.0, np.inf
    names = [f"c{i}" for i in range(300)]
    df, scans = counted(spark.createDataFrame(data.tolist(), ", ".join(f"{c} double" for c in names)))
    found = statistics.correlation_pairs(df).toPandas()
    assert scans.value == 1 and len(found) == 300 * 299 // 2
    for a, b in ((0, 1), (17, 250), (7, 9), (5, 6)):
        both = ~np.isnan(data[:, a]) & ~np.isnan(data[:, b])
        row = found[(found.a == f"c{a}") & (found.b == f"c{b}")].iloc[0]
        assert row.n == both.sum()
        if a == 5 or a == 7 and both[3]:
            assert np.isnan(row.r)
        else:
            assert row.r == pytest.approx(np.corrcoef(data[both, a], data[both, b])[0, 1], abs=1e-7)


def test_pair_sums_merge_in_any_order():
    g = np.random.default_rng(9)
    x = g.normal(1e6, 1, (200, 6))
    x[g.random(x.shape) < 0.3] = np.nan
    whole = statistics.PairSums.of(x).correlations()
    parts = [statistics.PairSums.of(x[i:i + 17]) for i in range(0, 200, 17)]
    for order in (range(len(parts)), reversed(range(len(parts)))):
        total = statistics.PairSums(6)
        for k in order:
            total.merge(statistics.PairSums.unpack(6, parts[k].pack()))
        assert np.allclose(total.correlations(), whole, atol=1e-9, equal_nan=True)


def test_boxes_of_many_labels_and_a_hot_one(spark):
    g = np.random.default_rng(4)
    rows = [("hot", float(x)) for x in g.normal(0, 1, 3000)] + [(f"l{i % 900}", float(i % 11)) for i in range(3600)] + [(None, 1.0), ("gap", None)]
    df = spark.createDataFrame(rows, "label string, x double").repartition(6)
    found = {r["label"]: r for r in statistics.box_stats(df, "label", "x").collect()}
    x = np.array([v for k, v in rows[:3000]])
    q1, q3 = np.quantile(x, [0.25, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert len(found) == 901 and found["hot"]["n_outliers"] == 3000 - len(inside) and found["hot"]["whisker_high"] == inside.max()


def test_quality_checks_share_their_scans(spark):
    rows = [(i, float(i % 5) if i % 7 else None, "a" if i % 2 else " ", str(i % 3) if i % 10 else "bad") for i in range(100)] + [(3, 3.0, "a", "0")]
    frame = spark.createDataFrame(rows, "id bigint, x double, t string, n string").cache()
    frame.count()
    for check, most in ((quality.wide_facts, 1), (quality.validate_dataset, 3), (quality.quality_check, 5), (quality.quality_issues, 4),
                        (lambda d: quality.quality_score(d, "id"), 3), (profile.categorical_uniques, 2)):
        df, scans = counted(frame)
        check(df).collect()
        assert 0 < scans.value <= most, check


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, "x", {"k": 1}, [1.0], "Yes"), (2, None, {"k": 1}, None, "No"), (2, "x", None, [1.0], "Maybe"), (2, "x", None, [1.0], "Maybe")]
    return spark.createDataFrame(rows, "`a.id` bigint, `b c` string, m map<string,int>, r array<double>, Attrition string")


@pytest.mark.parametrize("name", ["missing_summary", "duplicate_summary", "wide_facts", "invalid_numeric", "iqr_outliers", "validate_dataset", "quality_check",
                                  "quality_score", "quality_issues", "dataset_gate", "table_fingerprint", "profile_dataset", "schema_summary"])
def test_quality_takes_dotted_map_and_array_columns(awkward, name):
    assert getattr(quality, name)(awkward).collect()


def test_quality_of_dotted_ids(awkward):
    assert quality.duplicate_ids(awkward, "a.id").first()[0] == 2
    facts = {r["column"]: r for r in quality.wide_facts(awkward).collect()}
    assert facts["m"]["constant"] and not facts["a.id"]["constant"] and facts["a.id"]["missing"] == 0 and facts["b c"]["missing"] == 1


def test_fingerprints_tell_contents_not_orders(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, "a", "b"), (2, "a", "b")], "a int, b string, c string")
    same = quality.table_fingerprint(df).first()
    assert quality.table_fingerprint(df.orderBy(F.desc("a")).repartition(3)).first() == same and same["n_rows"] == 3
    others = [df.distinct(), df.withColumn("b", F.concat("b", F.lit(""))).withColumn("c", F.coalesce("c", F.lit("N"))), df.select("a", "c", "b")]
    assert len({quality.table_fingerprint(o).first() for o in [df, *others]}) == 4


def test_outcomes_by_name_need_no_two_values(awkward, people):
    found = quality.target_candidates(awkward).orderBy("ord").collect()
    assert [(r["column"], r["by_alias"], r["by_labels"]) for r in found] == [("Attrition", True, False), ("a.id", False, True)]
    schema = quality.describe_schema(people)
    assert schema["roles"]["target"] == "Attrition" and schema["roles"]["id"] == "EmployeeNumber" and schema["candidates"][0] == "Attrition"
    row = quality.schema_summary(people).first()
    assert row["target"] == "Attrition" and "EmployeeNumber" in row["junk_columns"] and row["n_numeric"] == 4


# --- pages, files ----------------------------------------------------------

def test_first_pages_shuffle_nothing_and_later_ones_share_an_index(spark):
    df = spark.createDataFrame([(None if i % 50 == 0 else i, "t") for i in range(3000)], "k bigint, t string").repartition(4)
    path = scratch_path(spark, "pages")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    first = filters.page(stored, "k", 0, 25)
    assert [r[0] for r in first.collect()] == [None] * 25
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    df, scans = counted(stored)
    index = filters.page_index(df, "k", range_rows=200)
    made = scans.value
    keys = [r[0] for n in range(2, 8) for r in filters.page(df, "k", n, 100, index=index).collect()]
    assert keys == [i for i in range(3000) if i % 50][140:740] and scans.value == made + 6


def test_all_encodings_are_tried_in_one_scan(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_bytes("id\ncafé\n".encode("latin-1") + b"\x81\x8d\n" + "ok Phòng\n".encode())
    found = {r["encoding"]: r["bad_rows"] for r in csv.encoding_report(spark, str(path)).collect()}
    assert found["latin-1"] == 0 and found["utf-8"] == 2 and found["cp1252"] == 1
    plan = csv.encoding_report(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1
    assert csv.detect_encoding(spark, str(path)) == "latin-1"
    with pytest.raises(ValueError, match="one-byte"):
        csv.encoding_report(spark, str(path), ["utf-16"])


def test_reports_and_exports_read_their_rows_once(spark):
    rows = spark.range(200).select("id", (F.col("id") / 200).alias("probability"))
    df, scans = counted(scoring.with_risk_fields(rows))
    path = scratch_path(spark, "export")
    reports.export_risk(df, path)
    assert scans.value == 1
    assert spark.read.parquet(f"{path}/summary").first() == scoring.risk_summary(scoring.with_risk_fields(rows)).first()
    assert reports.write_report({"all": df, "few": df.limit(3)}, f"{path}/report") == {"all": 200, "few": 3} and scans.value <= 3


def test_long_alias_lists_give_the_same_matches(spark):
    from cohortlens.operators.roles import alias_match

    g = np.random.default_rng(11)
    stems = ["".join(g.choice(list("abcdeiou"), 6)) for _ in range(300)]
    names = [stems[i % 300] + ("" if i % 3 else "x" * (i % 5)) for i in range(400)] + ["emp id", "", None, "abc", "depart"]
    aliases = {f"r{i % 90}": [] for i in range(90)}
    for i in range(900):
        aliases[f"r{i % 90}"].append(stems[(i * 7) % 300][: 4 + i % 3] + "zy" * (i % 2))
    aliases["r0"] += ["Emp_ID", "department"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    plain = sorted(map(tuple, alias_match(df, "name", aliases, inline=10_000).collect()))
    assert sorted(map(tuple, alias_match(df, "name", aliases, inline=0).collect())) == plain and len(plain) > 40
    many = {f"q{i}": [f"{stems[i % 300]}{i:06d}"] for i in range(100_000)} | {"hit": [stems[5] + "abc"]}
    found = {r["role"]: r["name"] for r in alias_match(df, "name", many).collect()}
    assert found["hit"].startswith(stems[5]) and len(found) > 1000


def test_the_most_frequent_long_text(spark):
    from cohortlens.operators.cleaning import column_defaults

    begin = "same beginning " * 8
    rows = [(begin + "b",)] * 3 + [(begin + "a",)] * 3 + [("short",)] * 2 + [(begin + "c",), (None,)]
    found = column_defaults(spark.createDataFrame([(*r, r[0] and r[0][:5]) for r in rows], "t string, s string")).collect()
    assert {r["column"]: r["text"] for r in found} == {"t": begin + "a", "s": "same "}


def test_kinds_take_one_scan(spark):
    rows = [(f"2024-01-{1 + i % 28:02d}", str(i), "x", i) for i in range(40)]
    df, scans = counted(spark.createDataFrame(rows, "d string, n string, c string, i int"))
    assert {r["column"]: r["kind"] for r in profile.infer_kind(df).collect()} == {"d": "datetime", "n": "numeric", "c": "categorical", "i": "numeric"}
    assert scans.value == 1
    assert {r["column"] for r in profile.datetime_columns(df).where("is_datetime").collect()} == {"d"} and scans.value == 2

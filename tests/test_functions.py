"""Edge rows with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import bands, numbers, text
from cohortlens.operators import cleaning, features, outcome, quality, roles, scoring, statistics, target
from cohortlens.operators.quantiles import exact_quantiles


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", expression(df).alias("r")).orderBy("i").collect()]


def test_number_text(spark):
    values = ["12", " 12 ", "1e3", "1,000", "inf", "nan", "", "1d", "12f", "abc", "+5", "5.", "1_000", None]
    found = column(spark, values, "string", lambda df: numbers.to_number(df, "v"))
    assert found == [12, 12, 1000, None, float("inf"), None, None, None, None, None, 5, 5, None, None]
    parsed = column(spark, values, "string", lambda df: numbers.parse_number_text(F.col("v")))
    assert parsed[3] == 1000


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (None,), (0.0,), (-0.0,)], "v double")
    assert numbers.nan_to_null(df).distinct().count() == 2
    row = {r["column"]: r for r in quality.missing_summary(df).collect()}["v"]
    assert row["missing_count"] == 3


def test_bands(spark):
    assert column(spark, [0.2999, 0.30, 0.5999, 0.60, None], "double", lambda df: bands.risk_band(F.col("v"))) == [
        "Low", "Medium", "Medium", "High", None]
    assert column(spark, [4.99, 5.0, 14.99, -15.0], "double", lambda df: bands.severity(F.col("v"))) == [
        "LOW", "MEDIUM", "MEDIUM", "HIGH"]
    assert column(spark, [0.49, 0.5], "double", lambda df: bands.decision_label(F.col("v"))) == ["Không", "Có"]
    assert column(spark, [-0.6, -0.5, 0.5, 0.6], "double", lambda df: bands.effect_label(F.col("v"))) == [
        "Giảm rủi ro", "Hầu như không đổi", "Hầu như không đổi", "Tăng rủi ro"]


def test_text(spark):
    assert column(spark, ["Phòng_ban", "Đánh giá-Hiệu.suất", "\t Mã (NV) "], "string",
                  lambda df: text.normalize_key(F.col("v"))) == ["phongban", "danhgiahieusuat", "manv"]
    assert column(spark, [1234567.0, 0.5, None], "double", lambda df: text.format_money(F.col("v"))) == [
        "1.234.567 USD", "0 USD", "N/A"]
    assert column(spark, [12.345, 0.125, None], "double", lambda df: text.format_pct(F.col("v"))) == ["12.34%", "0.12%", "N/A"]
    assert column(spark, [1.234, -2.0], "double", lambda df: text.signed_diff(F.col("v"))) == ["+1.23 pp", "-2.00 pp"]
    assert column(spark, [12345.6, 0.12345, 12.3, None], "double", lambda df: text.format_metric(F.col("v"))) == [
        "12,346", "0.1234", "12.30", "—"]
    assert column(spark, [500, 2048, 3 * 1024**2, 5 * 1024**3, None], "bigint", lambda df: text.file_size_text(F.col("v"))) == [
        "500 B", "2.0 KB", "3.0 MB", "5.0 GB", "—"]
    assert column(spark, ["a\r\nb\rc\td", None], "string", lambda df: text.sanitize_text(F.col("v"))) == ["a\nb\nc d", ""]
    assert column(spark, ["x" * 39, "x" * 40], "string", lambda df: text.ellipsize(F.col("v"))) == ["x" * 39, "x" * 37 + "..."]


def test_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.5,), (10.0,), (None,)], "v double")
    assert exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.75]).first()["q"] == [2.0, 3.5]


def test_null_target_and_labels(spark):
    df = spark.createDataFrame([("Yes",), (" YES ",), ("No",), (None,)], "v string")
    assert [r[0] for r in df.select(target.event_value(df, "v")).collect()] == [1, 1, 0, None]
    pair = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    assert [r[0] for r in pair.select(target.event_value(pair, "v")).collect()] == [0, 0, 1, None]
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    with pytest.raises(Exception, match="cannot be mapped"):
        three.select(target.event_value(three, "v")).collect()
    with pytest.raises(Exception, match="cannot be mapped"):
        pair.select(target.event_value(pair, "v", rule="vocabulary")).collect()
    assert sorted(r["label"] for r in target.unmappable_labels(three, "v").collect()) == ["a", "b", "c"]
    assert target.unmappable_labels(pair, "v").isEmpty()


def test_encoder_levels(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None)], "x double, c string")
    spec = features.FeatureSpec(["x"], ["c"])
    model = features.encoder(spec).fit(train)
    assert features.feature_names(model, spec) == ["x", "c_(missing)", "c_a", "c_b"]
    test = spark.createDataFrame([(1.0, "a"), (1.0, "z"), (1.0, None)], "x double, c string")
    rows = [r["features"].toArray().tolist() for r in model.transform(test).collect()]
    assert rows == [[1, 0, 1, 0], [1, 0, 0, 0], [1, 1, 0, 0]]
    assert [r["level"] for r in features.unseen_levels(train, test, ["c"]).collect()] == ["z"]


def test_gate(spark):
    empty = spark.createDataFrame([(None, 20), (None, 30)], "attrition string, age int")
    failed = {r["check"]: r["detail"] for r in quality.dataset_gate(empty, "attrition").where("NOT ok").collect()}
    assert failed == {"no_empty_column": "attrition"}
    assert not quality.dataset_gate(empty, "left").where("check = 'target_known'").first()["ok"]


def test_clean_is_idempotent_and_keeps_nulls(spark):
    df = spark.createDataFrame([(" a ", 1.0), ("a", 1.0), (None, float("inf")), (None, None)], "s string, x double")
    once = cleaning.clean_dataset(df)
    assert sorted(map(str, once.collect())) == ["Row(s='a', x=1.0)", "Row(s=None, x=None)", "Row(s=None, x=None)"]
    twice = cleaning.clean_dataset(once)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.distinct().collect()))
    assert sorted(map(str, cleaning.clean_dataset(twice).collect())) == sorted(map(str, twice.collect()))
    report = cleaning.clean_report(df).first()
    assert (report["rows_before"], report["rows_after"], report["duplicates_before"], report["duplicates_after"]) == (4, 3, 0, 1)
    kept = cleaning.clean_report(df, drop_duplicates=False).first()
    assert kept["rows_after"] == 4 and "kept 1 duplicate rows" in kept["actions"]


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert quality.duplicate_summary(df).first()["duplicate_count"] == 1


def test_fingerprint_ignores_order_and_sees_content(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert quality.table_fingerprint(df).first() == quality.table_fingerprint(df.orderBy(F.desc("id"))).first()
    assert quality.table_fingerprint(df).first() != quality.table_fingerprint(df.withColumn("v", F.col("v") + 1)).first()


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert statistics.correlation_pairs(df).first()["r"] is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "d string, event int")
    assert outcome.event_rate(df).first()["rate"] == 0.0
    assert outcome.rate_by_group(df, "d").isEmpty()


def test_top_variance_keeps_the_target(spark):
    df = spark.createDataFrame([(0, 1.0, 10.0, 100.0), (1, 2.0, 30.0, 500.0)], "event int, a double, b double, c double")
    kept = [r["column"] for r in statistics.top_variance_columns(df, limit=3, keep=2, always="event").collect()]
    assert sorted(kept) == ["b", "c", "event"]


def test_role_guess(people):
    found = roles.guess_roles(people)
    assert found["target"] == "Attrition" and found["id"] == "EmployeeNumber" and found["income"] == "MonthlyIncome"
    assert found["tenure"] == "YearsAtCompany" and found["overtime"] == "OverTime"


def test_vietnamese_header(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Nghi_viec` int, `Phòng_ban` int, `Số giờ tiêu chuẩn` int")
    found = roles.guess_roles(df)
    assert found["target"] == "Nghi_viec" and found["department"] == "Phòng_ban"
    assert roles.junk_columns(df) == ["Số giờ tiêu chuẩn"]


def test_changes_are_checked():
    assert scoring.clean_changes({"a": "1,200", "b": " ", "c": 3, "t": "x"}, ["a", "b"], ["a", "b", "t"]) == {"a": 1200.0, "t": "x"}
    with pytest.raises(ValueError):
        scoring.clean_changes({"a": "many"}, ["a"], ["a"])

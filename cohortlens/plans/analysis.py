"""Queries over targets, text, outcomes, statistics, insights and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import bands, numbers, text
from cohortlens.operators import features, filters, insights, outcome, profile, roles, splits, statistics, target
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import MEASURES, ROLES, risk, scored, sql, table


def events(spark, sf_dir) -> DataFrame:
    return target.with_event(risk(spark, sf_dir), "attrition")


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# --- target mapping --------------------------------------------------------

@query("binary_target", sql("risk", "SELECT emp_id, CASE WHEN lower(attrition) = 'yes' THEN 1 WHEN lower(attrition) = 'no' THEN 0 END AS y FROM risk"))
def _(spark, sf_dir):
    rows = risk(spark, sf_dir)
    return rows.select("emp_id", target.event_value(rows, "attrition").alias("y"))


@query("binary_target_numeric", sql(None, "SELECT doc_id, CAST(toxic AS INT) AS toxic_y, CAST(quality AS INT) AS quality_y FROM labels"))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.select("doc_id", target.event_value(rows, "toxic").alias("toxic_y"), target.event_value(rows, "quality").alias("quality_y"))


MINORITY_SQL = "rare AS (SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)"


@query("minority_target", sql(None, """SELECT l_linestatus AS label, CASE WHEN l_linestatus = (SELECT l_linestatus FROM rare) THEN 1 ELSE 0 END AS y,
    count(*) AS n FROM lineitem GROUP BY 1, 2""", MINORITY_SQL))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_linestatus").alias("label"), target.event_value(rows, "l_linestatus").alias("y")).groupBy(
        "label", "y").agg(F.count(F.lit(1)).alias("n"))


@query("unmappable_labels", sql(None, """SELECT o_orderstatus AS label, count(*) AS n FROM orders
    WHERE lower(o_orderstatus) NOT IN ('n', 'y', 'co', 'no', '0', '1') AND (SELECT count(DISTINCT o_orderstatus) FROM orders) <> 2 GROUP BY 1"""))
def _(spark, sf_dir):
    return target.unmappable_labels(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("unmappable_labels_lineitem", sql(None, """SELECT l_returnflag AS label, count(*) AS n FROM lineitem
    WHERE lower(l_returnflag) NOT IN ('n', 'y') GROUP BY 1"""))
def _(spark, sf_dir):
    return target.unmappable_labels(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("event_label", sql(None, "SELECT l_linestatus AS event_label FROM rare", MINORITY_SQL))
def _(spark, sf_dir):
    return target.event_label(table(spark, sf_dir, "lineitem"), "l_linestatus")


@query("event_mask", sql("risk", "SELECT emp_id, attrition = 'Yes' AS is_event FROM risk"))
def _(spark, sf_dir):
    rows = risk(spark, sf_dir)
    return rows.select("emp_id", target.event_mask(rows, "attrition").alias("is_event"))


@query("event_mask_minority", sql(None, """SELECT l_linestatus = (SELECT event_label FROM (SELECT l_linestatus AS event_label, count(*) AS n FROM lineitem
    GROUP BY 1 ORDER BY n, 1 LIMIT 1)) AS is_event, count(*) AS n FROM lineitem GROUP BY 1"""))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(target.event_mask(rows, "l_linestatus").alias("is_event")).groupBy("is_event").agg(F.count("*").alias("n"))


@query("class_weights", sql("events", """, c AS (SELECT event AS y, count(*) AS n FROM ev GROUP BY 1)
    SELECT y, n, round((SELECT sum(n) FROM c) / (2.0 * n), 4) AS balanced_weight,
    round(CASE WHEN y = 1 THEN greatest((SELECT max(n) FROM c WHERE y = 0) / CAST(n AS DOUBLE), 1) ELSE 1 END, 4) AS positive_weight FROM c"""))
def _(spark, sf_dir):
    return rounded(target.class_counts(events(spark, sf_dir).withColumnRenamed("event", "y")))


# --- scalar functions ------------------------------------------------------

@query("normalize_key", sql(None, r"""SELECT doc_id, md5(regexp_replace(replace(strip_accents(lower(regexp_replace(text, '^\s+|\s+$', '', 'g'))), 'đ', 'd'),
    '[ _\-./()\[\]{}]', '', 'g')) AS key_md5 FROM documents"""))
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("key_md5"))


@query("format_pct", sql(None, "SELECT l_orderkey, l_linenumber, printf('%.2f%%', l_discount * 100) AS pct FROM lineitem"))
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.format_pct(F.col("l_discount") * 100).alias("pct"))


@query("format_money", sql(None, """SELECT o_orderkey, concat(replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', '.'), ' USD') AS money FROM orders"""))
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.format_money(F.col("o_totalprice")).alias("money"))


@query("severity", sql("scored", """SELECT emp_id, CASE WHEN abs(score * 40 - 20) >= 15 THEN 'HIGH' WHEN abs(score * 40 - 20) >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM scored"""))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("emp_id", bands.severity(F.col("score") * 40 - 20).alias("severity"))


@query("risk_band", sql("scored", """SELECT emp_id, CASE WHEN score * 100 < 30 THEN 'Low' WHEN score * 100 < 60 THEN 'Medium' ELSE 'High' END AS risk_band FROM scored"""))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("emp_id", bands.risk_band(F.col("score")).alias("risk_band"))


@query("decision_label", sql("scored", "SELECT emp_id, CASE WHEN score >= 0.5 THEN 'Có' ELSE 'Không' END AS prediction FROM scored"))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("emp_id", bands.decision_label(F.col("score")).alias("prediction"))


@query("safe_div", sql(None, """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice / (l_linenumber - 1) END, 4) AS ratio FROM lineitem"""))
def _(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.safe_div(F.col("l_extendedprice"), F.col("l_linenumber") - 1).alias("ratio")))


@query("signed_diff", sql("scored", "SELECT emp_id, printf('%+.2f pp', (score - 0.5) * 100) AS diff FROM scored"))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("emp_id", text.signed_diff((F.col("score") - 0.5) * 100).alias("diff"))


@query("effect_label", sql("scored", """SELECT emp_id, CASE WHEN (score - 0.5) * 10 < -0.5 THEN 'Giảm rủi ro'
    WHEN (score - 0.5) * 10 > 0.5 THEN 'Tăng rủi ro' ELSE 'Hầu như không đổi' END AS effect FROM scored"""))
def _(spark, sf_dir):
    return scored(spark, sf_dir).select("emp_id", bands.effect_label((F.col("score") - 0.5) * 10).alias("effect"))


@query("sanitize_text", sql(None, r"""SELECT doc_id, md5(s) AS clean_md5, length(s) AS n FROM (SELECT doc_id, coalesce(
    regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0B-\x1F]', ' ', 'g'), '') AS s FROM documents)"""))
def _(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").select("doc_id", text.sanitize_text(F.col("text")).alias("s"))
    return clean.select("doc_id", F.md5("s").alias("clean_md5"), F.length("s").cast("bigint").alias("n"))


@query("format_metric", sql(None, """SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) >= 1000 THEN format('{:,.0f}', x) WHEN x < 1 THEN format('{:,.4f}', x)
    ELSE format('{:,.2f}', x) END AS shown FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 3 THEN l_extendedprice
    WHEN l_linenumber < 5 THEN l_quantity ELSE l_tax END AS x FROM lineitem)"""))
def _(spark, sf_dir):
    line = F.col("l_linenumber")
    value = F.when(line < 3, F.col("l_extendedprice")).when(line < 5, F.col("l_quantity")).otherwise(F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_metric(value).alias("shown"))


@query("file_size_text", sql(None, """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0)
    WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576.0) ELSE printf('%.1f GB', b / 1073741824.0) END AS size
    FROM (SELECT doc_id, strlen(text) AS b FROM documents)"""))
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.file_size_text(F.octet_length("text")).alias("size"))


@query("ellipsize", sql(None, """SELECT doc_id, CASE WHEN length(text) >= 40 THEN concat(substr(text, 1, 37), '...') ELSE text END AS short FROM documents"""))
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ellipsize(F.col("text")).alias("short"))


@query("parse_number_text", sql(None, "SELECT o_orderkey, o_totalprice AS value FROM orders"))
def _(spark, sf_dir):
    shown = table(spark, sf_dir, "orders").select("o_orderkey", F.format_number("o_totalprice", 2).alias("shown"))
    return shown.select("o_orderkey", numbers.parse_number_text(F.col("shown")).alias("value"))


# --- outcome ---------------------------------------------------------------

def rates_sql(group: str, extra: str = "") -> str:
    return f"""SELECT {group}, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving,
    round(100.0 * sum(event) / count(*), 4) AS rate FROM ev GROUP BY {group} {extra}"""


def question_sql(group: str) -> str:
    return sql("events", f"""SELECT *, {group} = (SELECT {group} FROM g ORDER BY rate DESC, {group} LIMIT 1) AS is_top FROM (
    SELECT {group}, total, leaving, round(rate, 4) AS rate, round(o.overall, 4) AS overall_rate, round(rate - o.overall, 4) AS diff FROM g, o)""",
               f"g AS (SELECT {group}, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving, 100.0 * sum(event) / count(*) AS rate FROM ev GROUP BY {group})",
               "o AS (SELECT 100.0 * sum(event) / count(*) AS overall FROM ev)")


@query("event_rate", sql("events", "SELECT count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving, round(100.0 * sum(event) / count(*), 4) AS rate FROM ev"))
def _(spark, sf_dir):
    return rounded(outcome.event_rate(events(spark, sf_dir)))


@query("rate_by_group", sql("events", rates_sql("department")))
def rate_by_department(spark, sf_dir):
    return rounded(outcome.rate_by_group(events(spark, sf_dir), "department"))


@query("kpis", sql("events", """SELECT count(*) AS total_employees, CAST(count(*) - sum(event) AS BIGINT) AS employees_staying,
    CAST(sum(event) AS BIGINT) AS employees_leaving, round(100.0 * sum(event) / count(*), 4) AS event_rate, round(avg(age), 4) AS avg_age,
    round(avg(income), 4) AS avg_income, round(avg(tenure), 4) AS avg_years_company, round(avg(job_satisfaction), 4) AS avg_job_satisfaction FROM ev"""))
def _(spark, sf_dir):
    return rounded(outcome.kpis(events(spark, sf_dir), ROLES))


@query("kpis_filtered", sql("events", """SELECT count(*) AS total_employees, CAST(count(*) - sum(event) AS BIGINT) AS employees_staying,
    CAST(sum(event) AS BIGINT) AS employees_leaving, round(100.0 * sum(event) / count(*), 4) AS event_rate, round(avg(age), 4) AS avg_age,
    round(avg(income), 4) AS avg_income, round(avg(tenure), 4) AS avg_years_company, round(avg(job_satisfaction), 4) AS avg_job_satisfaction
    FROM ev WHERE department = 'BUILDING' AND overtime = 'Yes'"""))
def _(spark, sf_dir):
    kept = filters.apply_filters(risk(spark, sf_dir), {"department": "BUILDING", "overtime": "Yes"})
    return rounded(outcome.kpis(target.with_event(kept, "attrition"), ROLES))


@query("rq1_distribution", sql("risk", "SELECT attrition AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM risk GROUP BY 1"))
def _(spark, sf_dir):
    return rounded(outcome.label_distribution(risk(spark, sf_dir), "attrition"))


def question(name: str, group: str) -> None:
    @query(name, question_sql(group))
    def _(spark, sf_dir):
        return rounded(outcome.group_question(events(spark, sf_dir), group))


question("rq2_department", "department")
question("rq3_overtime", "overtime")
question("rq4_satisfaction", "job_satisfaction")


def label_sql(measure: str, std: bool = False) -> str:
    extra = f", round(stddev_samp({measure}), 4) AS std" if std else ""
    return sql("risk", f"""SELECT attrition AS label, count({measure}) AS n, round(avg({measure}), 4) AS mean,
    round(CAST(quantile_cont({measure}, 0.5) AS DOUBLE), 4) AS median{extra} FROM risk GROUP BY 1""")


def by_label(name: str, measure: str, std: bool = False) -> None:
    @query(name, label_sql(measure, std))
    def _(spark, sf_dir):
        return rounded(outcome.measure_by_label(risk(spark, sf_dir), "attrition", measure, std))


by_label("rq5_income", "income", std=True)
by_label("rq6_tenure", "tenure")
by_label("rq7_distance", "distance")


def level_question(name: str, level: str) -> None:
    @query(name, sql("events", f"""SELECT {level}, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving, round(100.0 * sum(event) / count(*), 4) AS rate,
    (SELECT round(avg({level}), 4) FROM ev WHERE event = 1) AS event_mean, (SELECT round(avg({level}), 4) FROM ev WHERE event = 0) AS other_mean
    FROM ev GROUP BY {level}"""))
    def _(spark, sf_dir):
        return rounded(outcome.level_rates(events(spark, sf_dir), level))


level_question("rq8_performance", "performance")
level_question("rq8_training", "training")


def _tidy(rq: str, group: str, metrics: dict[str, str]) -> str:
    return union_all([f"SELECT '{rq}' AS rq, CAST({group} AS VARCHAR) AS grp, '{m}' AS metric, round(CAST({e} AS DOUBLE), 4) AS value FROM ev GROUP BY {group}"
                      for m, e in metrics.items()])


RATE_METRICS = {"total": "count(*)", "leaving": "sum(event)", "rate": "100.0 * sum(event) / count(*)"}


def _label_metrics(m: str, std: bool = False) -> dict[str, str]:
    base = {"n": f"count({m})", "mean": f"avg({m})", "median": f"quantile_cont({m}, 0.5)"}
    return {**base, "std": f"stddev_samp({m})"} if std else base


@query("run_questions", sql("events", union_all([
    _tidy("rq1", "attrition", {"n": "count(*)", "pct": "100.0 * count(*) / (SELECT count(*) FROM ev)"}),
    _tidy("rq2", "department", RATE_METRICS), _tidy("rq3", "overtime", RATE_METRICS), _tidy("rq4", "job_satisfaction", RATE_METRICS),
    _tidy("rq5", "attrition", _label_metrics("income", True)), _tidy("rq6", "attrition", _label_metrics("tenure")),
    _tidy("rq7", "attrition", _label_metrics("distance")), _tidy("rq8_performance", "performance", RATE_METRICS),
    _tidy("rq8_training", "training", RATE_METRICS)])))
def _(spark, sf_dir):
    return rounded(outcome.run_questions(events(spark, sf_dir), ROLES, "attrition"))


@query("top_group", sql("events", rates_sql("job_role", "ORDER BY 100.0 * sum(event) / count(*) DESC, job_role LIMIT 1")))
def _(spark, sf_dir):
    return rounded(outcome.top_group(events(spark, sf_dir), "job_role"))


@query("first_last_level", sql("events", """, g AS (SELECT job_satisfaction AS level, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving,
    round(100.0 * sum(event) / count(*), 4) AS rate FROM ev GROUP BY 1)
    SELECT 'lowest' AS which, g.* FROM g WHERE level = (SELECT min(level) FROM g) UNION ALL SELECT 'highest', g.* FROM g WHERE level = (SELECT max(level) FROM g)"""))
def _(spark, sf_dir):
    return rounded(outcome.first_last_level(events(spark, sf_dir), "job_satisfaction"))


@query("event_vs_overall", sql("events", """, o AS (SELECT 100.0 * sum(event) / count(*) AS overall FROM ev)
    SELECT job_role, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving, round(100.0 * sum(event) / count(*), 4) AS rate,
    round(any_value(overall), 4) AS overall_rate, round(100.0 * sum(event) / count(*) - any_value(overall), 4) AS diff FROM ev, o GROUP BY 1"""))
def _(spark, sf_dir):
    return rounded(outcome.rate_vs_overall(events(spark, sf_dir), "job_role"))


COMPARED = ["income", "tenure", "distance", "performance", "training"]


@query("event_mean_compare", sql("events", union_all([f"""SELECT '{m}' AS measure, round(avg({m}) FILTER (event = 1), 4) AS event_mean,
    round(avg({m}) FILTER (event = 0), 4) AS other_mean, round(avg({m}) FILTER (event = 1) - avg({m}) FILTER (event = 0), 4) AS diff,
    round(CAST(quantile_cont({m}, 0.5) FILTER (event = 1) AS DOUBLE), 4) AS event_median,
    round(CAST(quantile_cont({m}, 0.5) FILTER (event = 0) AS DOUBLE), 4) AS other_median FROM ev""" for m in COMPARED])))
def _(spark, sf_dir):
    return rounded(outcome.event_mean_compare(events(spark, sf_dir), COMPARED, medians=True))


# --- statistics ------------------------------------------------------------

DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def describe_sql(view: str, columns: list[str]) -> str:
    return union_all([f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
    round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25,
    round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75,
    round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {view}""" for c in columns])


@query("describe_numeric", sql("risk", describe_sql("risk", MEASURES)))
def _(spark, sf_dir):
    return rounded(statistics.describe_numeric(risk(spark, sf_dir), MEASURES))


@query("describe_numeric_lineitem", sql(None, describe_sql("lineitem", DESCRIBED)))
def _(spark, sf_dir):
    return rounded(statistics.describe_numeric(table(spark, sf_dir, "lineitem"), DESCRIBED))


PAIRED = [*MEASURES, "event"]


def pair_sql() -> str:
    return union_all([f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM ev"
                      for i, a in enumerate(PAIRED) for b in PAIRED[i + 1:]])


PAIRS_CTE = f"pairs AS (SELECT a, b, CASE WHEN isnan(r) THEN NULL ELSE r END AS r, n FROM ({pair_sql()}))"


def pairs(spark, sf_dir) -> DataFrame:
    return statistics.correlation_pairs(events(spark, sf_dir), MEASURES, "event")


@query("corr_matrix", sql("events", """SELECT a, b, round(r, 4) AS r FROM pairs UNION ALL SELECT b, a, round(r, 4) FROM pairs UNION ALL """ +
                          union_all([f"SELECT '{c}', '{c}', CAST(1 AS DOUBLE)" for c in PAIRED]), PAIRS_CTE))
def _(spark, sf_dir):
    return rounded(statistics.correlation_matrix(events(spark, sf_dir), MEASURES, "event"))


@query("strong_pairs", sql("events", "SELECT a, b, round(r, 4) AS r, round(abs(r), 4) AS abs_r FROM pairs WHERE abs(r) >= 0.2", PAIRS_CTE))
def _(spark, sf_dir):
    return rounded(statistics.strong_pairs(pairs(spark, sf_dir), 0.2))


@query("corr_insights", sql("events", """SELECT a, b, round(r, 4) AS r, CASE WHEN r > 0 THEN 'thuận' ELSE 'nghịch' END AS direction,
    concat('`', a, '` liên hệ ', CASE WHEN r > 0 THEN 'thuận' ELSE 'nghịch' END, ' với `', b, '` (r = ', printf('%.3f', r), ')') AS text
    FROM pairs WHERE abs(r) >= 0.01 ORDER BY abs(r) DESC, a, b LIMIT 10""", PAIRS_CTE))
def _(spark, sf_dir):
    return rounded(statistics.correlation_insights(pairs(spark, sf_dir), 0.01))


@query("analyze_corr", sql("events", """SELECT a, b, round(r, 4) AS r, coalesce(abs(r) >= 0.2, false) AS is_strong,
    CASE WHEN r > 0 THEN 'thuận' WHEN r < 0 THEN 'nghịch' END AS direction FROM pairs""", PAIRS_CTE))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(*MEASURES, "event")
    return rounded(statistics.analyze_correlation(rows, "event", 0.2))


@query("topk_categories", sql("risk", "SELECT job_role AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM risk), 4) AS pct FROM risk GROUP BY 1 ORDER BY n DESC, value LIMIT 12"))
def _(spark, sf_dir):
    return rounded(statistics.topk_categories(risk(spark, sf_dir), "job_role", 12))


@query("topk_semi", sql("risk", "SELECT * FROM risk WHERE job_role IN (SELECT job_role FROM risk GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12)"))
def _(spark, sf_dir):
    return statistics.topk_rows(risk(spark, sf_dir), "job_role", 12)


@query("histogram", sql("risk", """, f AS (SELECT min(income) AS lo, max(income) AS hi, avg(income) AS mean FROM risk),
    b AS (SELECT CAST(least(floor((income - lo) / ((hi - lo) / 18)), 17) AS INT) AS bin, count(*) AS n FROM risk, f GROUP BY 1)
    SELECT bin, round(lo + bin * ((hi - lo) / 18), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 18), 4) AS high, n,
    round(mean, 4) AS mean, round(lo, 4) AS min, round(hi, 4) AS max FROM b, f"""))
def _(spark, sf_dir):
    return rounded(statistics.histogram(risk(spark, sf_dir), "income"))


@query("box_stats", sql("risk", """, q AS (SELECT attrition AS label, quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.5) AS median,
    quantile_cont(distance, 0.75) AS q3 FROM risk GROUP BY 1),
    x AS (SELECT label, q1, median, q3, distance AS v, distance BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM risk JOIN q ON attrition = label)
    SELECT label, count(*) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
    round(min(v) FILTER (inside), 4) AS whisker_low, round(max(v) FILTER (inside), 4) AS whisker_high, count_if(NOT inside) AS n_outliers FROM x GROUP BY 1"""))
def _(spark, sf_dir):
    return rounded(statistics.box_stats(risk(spark, sf_dir), "attrition", "distance"))


@query("top_variance_columns", sql("events", f"""SELECT * FROM ({union_all([f"SELECT '{c}' AS \"column\", round(var_samp({c}), 2) AS variance, var_samp({c}) AS v FROM ev" for c in PAIRED])})
    ORDER BY v DESC LIMIT 4""".replace("SELECT * FROM (", "SELECT \"column\", variance FROM (", 1)))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(*MEASURES, "event")
    return rounded(statistics.top_variance_columns(rows, limit=5, keep=4), 2)


@query("event_split", sql("events", "SELECT event, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ev GROUP BY 1"))
def _(spark, sf_dir):
    return rounded(statistics.event_split(events(spark, sf_dir)))


# --- joins and sets --------------------------------------------------------

PRODUCT_ALIASES = {
    "ring": ["Small-Ring", "Ring small", "Gold ring"], "widget": ["Red_Widget", "Blue Widget"], "bolt": ["Bolt", "Steel.Bolt"],
    "gear": ["large (gear)", "Gears"], "panel": ["GreenPanel", "Panel"], "valve": ["Valve"],
}


def _alias_sql() -> str:
    rows = ", ".join(
        f"('{role}', {i}, '{''.join(ch for ch in alias.lower() if ch not in ' _-./()[]{}')}')"
        for role, listed in PRODUCT_ALIASES.items() for i, alias in enumerate(listed)
    )
    return f"""SELECT role, name, score FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, name) AS rn FROM (
    SELECT role, name, CAST(CASE WHEN k = key THEN 1000000 - ord WHEN length(key) >= 5 AND length(k) >= 4 AND (contains(k, key) OR contains(key, k))
      AND abs(length(key) - length(k)) <= greatest(length(key), length(k)) * 0.6 THEN least(length(key), length(k)) END AS INT) AS score
    FROM (SELECT DISTINCT p_name AS name, replace(lower(p_name), ' ', '') AS k FROM part), (VALUES {rows}) t(role, ord, key))
    WHERE score IS NOT NULL) WHERE rn = 1"""


@query("alias_match", sql(None, _alias_sql()))
def _(spark, sf_dir):
    return roles.alias_match(table(spark, sf_dir, "part"), "p_name", PRODUCT_ALIASES)


@query("unseen_levels", sql(None, "WITH t AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', o_orderkey))) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM orders) "
       + union_all([f"""SELECT '{c}' AS "column", level FROM (
    SELECT CAST({c} AS VARCHAR) AS level FROM t WHERE is_test EXCEPT SELECT CAST({c} AS VARCHAR) FROM t WHERE NOT is_test)""" for c in ("o_orderdate", "o_custkey")])))
def _(spark, sf_dir):
    """Days and customers of the test part of all orders that the training part never had."""
    split = splits.random_split(table(spark, sf_dir, "orders"), "o_orderkey")
    return features.unseen_levels(split.where("NOT is_test"), split.where("is_test"), ["o_orderdate", "o_custkey"])


@query("vocab_overlap", sql(None, "SELECT lower(l_returnflag) AS label, lower(l_returnflag) IN ('y') AS positive FROM lineitem WHERE lower(l_returnflag) IN ('n', 'y') GROUP BY 1, 2"))
def _(spark, sf_dir):
    return profile.vocabulary_overlap(table(spark, sf_dir, "lineitem"), "l_returnflag")


# --- insights --------------------------------------------------------------

def _sev(e: str) -> str:
    return f"CASE WHEN abs({e}) >= 15 THEN 'HIGH' WHEN abs({e}) >= 5 THEN 'MEDIUM' ELSE 'LOW' END"


def _money(e: str) -> str:
    return f"concat(replace(format('{{:,}}', CAST(round_even({e}, 0) AS BIGINT)), ',', '.'), ' USD')"


def _group(column: str) -> str:
    return f"(SELECT {column} AS level, count(*) AS total, sum(event) AS leaving, 100.0 * sum(event) / count(*) AS rate FROM ev GROUP BY {column})"


def _means(column: str) -> str:
    return f"(SELECT avg({column}) FILTER (event = 1) AS e, avg({column}) FILTER (event = 0) AS o FROM ev)"


OVERALL = "(SELECT 100.0 * sum(event) / count(*) FROM ev)"
INSIGHT_SQL = {
    "Overview": """SELECT 0 AS ord, 'Overview' AS grp, printf('%.2f%%', r) AS evidence, concat('n=', n) AS difference,
      CASE WHEN r >= 25 THEN 'HIGH' WHEN r >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
      concat('Trên ', n, ' nhân viên, tỷ lệ nghỉ việc là ', printf('%.2f%%', r), ' (', l, ' người).') AS text
      FROM (SELECT count(*) AS n, CAST(sum(event) AS BIGINT) AS l, 100.0 * sum(event) / count(*) AS r FROM ev)""",
    "Overtime": f"""SELECT 1, 'Overtime', concat(printf('%.2f%%', y), ' vs ', printf('%.2f%%', n)), printf('%+.2f điểm %%', y - n), {_sev('y - n')},
      concat('Nhóm làm thêm giờ có tỷ lệ nghỉ việc ', printf('%.2f%%', y), ', nhóm không làm thêm là ', printf('%.2f%%', n), '. Chênh lệch ', printf('%+.2f', y - n), ' điểm phần trăm.')
      FROM (SELECT max(rate) FILTER (level = 'Yes') AS y, max(rate) FILTER (level = 'No') AS n FROM {_group('overtime')})""",
    "Job Satisfaction": f"""SELECT 2, 'Job Satisfaction', concat(printf('%.2f%%', a), ' vs ', printf('%.2f%%', b)), printf('%+.2f điểm %%', a - b), {_sev('a - b')},
      concat('Mức hài lòng ', la, ': ', printf('%.2f%%', a), '; mức ', lb, ': ', printf('%.2f%%', b), '.')
      FROM (SELECT arg_min(rate, level) AS a, arg_max(rate, level) AS b, min(level) AS la, max(level) AS lb FROM {_group('job_satisfaction')})""",
    "Monthly Income": f"""SELECT 3, 'Monthly Income', concat({_money('e')}, ' vs ', {_money('o')}), {_money('abs(o - e)')}, {_sev('(o - e) * 100 / o')},
      concat('Thu nhập TB nhóm nghỉ: ', {_money('e')}, '; nhóm ở lại: ', {_money('o')}, '.') FROM {_means('income')}""",
    "Years at Company": f"""SELECT 4, 'Years at Company', concat(printf('%.2fy', e), ' vs ', printf('%.2fy', o)), printf('%+.2f năm', e - o), {_sev('(o - e) * 5')},
      concat('Nhóm nghỉ: mean ', printf('%.2f', e), ' (median ', printf('%.2f', em), '); nhóm ở lại: mean ', printf('%.2f', o), ' (median ', printf('%.2f', om), ').')
      FROM (SELECT avg(tenure) FILTER (event = 1) AS e, avg(tenure) FILTER (event = 0) AS o, CAST(quantile_cont(tenure, 0.5) FILTER (event = 1) AS DOUBLE) AS em,
      CAST(quantile_cont(tenure, 0.5) FILTER (event = 0) AS DOUBLE) AS om FROM ev)""",
    "Department": f"""SELECT 5, 'Department', concat(level, ': ', printf('%.2f%%', rate)), printf('%+.2f điểm %% vs overall', rate - {OVERALL}), {_sev(f'rate - {OVERALL}')},
      concat('`', level, '` có tỷ lệ ', printf('%.2f%%', rate), ' (', CAST(leaving AS BIGINT), '/', total, '), so với overall ', printf('%.2f%%', {OVERALL}), '.')
      FROM (SELECT * FROM {_group('department')} ORDER BY rate DESC, level LIMIT 1)""",
    "Job Role": f"""SELECT 6, 'Job Role', printf('%.2f%%', rate), concat('n=', total), {_sev(f'rate - {OVERALL}')},
      concat('`', level, '` có tỷ lệ nghỉ việc ', printf('%.2f%%', rate), ' trên ', total, ' nhân viên.')
      FROM (SELECT * FROM {_group('job_role')} WHERE total >= 20 ORDER BY rate DESC, level LIMIT 1)""",
    "Distance": f"""SELECT 7, 'Distance', concat(printf('%.2f', e), ' vs ', printf('%.2f km', o)), printf('%+.2f km', e - o), {_sev('(e - o) * 3')},
      concat('Khoảng cách TB nhóm nghỉ ', printf('%.2f', e), '; nhóm ở lại ', printf('%.2f', o), '.') FROM {_means('distance')}""",
    "Performance": f"""SELECT 8, 'Performance', concat(printf('%.2f', e), ' vs ', printf('%.2f', o)), printf('%+.2f', e - o), {_sev('(o - e) * 10')},
      concat('Hiệu suất TB — nghỉ: ', printf('%.2f', e), '; ở lại: ', printf('%.2f', o), '.') FROM {_means('performance')}""",
}
INSIGHT_COLUMNS = ["ord", "grp", "evidence", "difference", "severity", "text"]
INSIGHTS_CTE = f"ins(ord, grp, evidence, difference, severity, text) AS ({union_all(list(INSIGHT_SQL.values()))})"
INSIGHT_QUERIES = {
    "ins_overview": "Overview", "ins_overtime": "Overtime", "ins_satisfaction": "Job Satisfaction", "ins_income": "Monthly Income",
    "ins_tenure": "Years at Company", "ins_department": "Department", "ins_job_role": "Job Role", "ins_distance": "Distance",
    "ins_performance": "Performance",
}


def insight(name: str, group: str) -> None:
    @query(name, sql("events", "SELECT * FROM one", f"one(ord, grp, evidence, difference, severity, text) AS ({INSIGHT_SQL[group]})"))
    def _(spark, sf_dir):
        return insights.insights(events(spark, sf_dir), ROLES, only=[group]).select(*INSIGHT_COLUMNS)


for _name, _grp in INSIGHT_QUERIES.items():
    insight(_name, _grp)


@query("insights", sql("events", "SELECT * FROM ins", INSIGHTS_CTE))
def _(spark, sf_dir):
    return insights.insights(events(spark, sf_dir), ROLES).select(*INSIGHT_COLUMNS)


RULE_ROWS = ", ".join("(" + ", ".join("'" + x + "'" for x in (g, *r)) + ")" for g, r in insights.RECOMMENDATIONS.items())
TITLE_ROWS = ", ".join(f"('{g}', '{t}')" for g, (_, t) in insights.INSIGHTS.items())
RECS_SQL = f"""SELECT ord, problem, evidence, recommended_action, severity AS priority, expected_goal, title AS based_on, text AS linked_insight
    FROM ins JOIN (VALUES {RULE_ROWS}) r(g, problem, recommended_action, expected_goal) ON grp = r.g
    JOIN (VALUES {TITLE_ROWS}) t(g, title) ON grp = t.g WHERE grp = 'Overview' OR severity <> 'LOW'"""


@query("recommendations", sql("events", RECS_SQL, INSIGHTS_CTE))
def _(spark, sf_dir):
    return insights.recommendations(insights.insights(events(spark, sf_dir), ROLES))


@query("risk_signals", sql("events", "SELECT * FROM ins WHERE grp <> 'Overview' AND severity IN ('HIGH', 'MEDIUM') ORDER BY ord LIMIT 4", INSIGHTS_CTE))
def _(spark, sf_dir):
    return insights.risk_signals(insights.insights(events(spark, sf_dir), ROLES)).select(*INSIGHT_COLUMNS)


@query("top_recommendations", sql("events", RECS_SQL + " ORDER BY ord LIMIT 3", INSIGHTS_CTE))
def _(spark, sf_dir):
    return insights.top_recommendations(insights.recommendations(insights.insights(events(spark, sf_dir), ROLES)))



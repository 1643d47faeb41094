"""Queries over scans, filters, cleaning, quality and profiles."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.bands import risk_band
from cohortlens.functions.numbers import to_number
from cohortlens.functions.vocabulary import ENCODINGS
from cohortlens.operators import cleaning, filters, outcome, profile, quality, target
from cohortlens.operators.scoring import batch_score
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.views import dirty, risk, scored, sql, table
from cohortlens.session import scratch_path
from cohortlens.sources import csv, reports

RISK_SCHEMA = (
    "emp_id bigint, department string, job_role string, overtime string, job_satisfaction int, income double, "
    "tenure int, distance double, performance int, training int, age int, attrition string"
)
DIRTY_SCHEMA = (
    "order_id bigint, line_no int, qty double, qty_text string, flag string, ship_text string, status string, "
    "const_col int, signed double"
)
RISK_TYPES = dict(c.strip().split(" ") for c in RISK_SCHEMA.split(","))
DIRTY_TYPES = dict(c.strip().split(" ") for c in DIRTY_SCHEMA.split(","))
NUMBER_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
DATE_SQL = r"'\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}'"


def events(spark, sf_dir) -> DataFrame:
    return target.with_event(risk(spark, sf_dir), "attrition")


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def per_column(types: dict[str, str], body) -> str:
    return union_all([body(c, t, i) for i, (c, t) in enumerate(types.items())])


def is_text(kind: str) -> bool:
    return kind == "string"


def profile_cte(view: str, types: dict[str, str]) -> str:
    """Column facts of a view as a named SQL part ``prof``."""
    def one(c: str, kind: str, i: int) -> str:
        text = is_text(kind)
        number = f"count_if(regexp_matches({c}, {NUMBER_SQL}))" if text else "0"
        date = f"count_if(regexp_matches({c}, {DATE_SQL}))" if text else "0"
        parsed = f"count_if(regexp_matches({c}, {DATE_SQL}) AND try_cast({c} AS TIMESTAMP) IS NOT NULL)" if text else "0"
        return (f"SELECT '{c}' AS \"column\", {i} AS position, '{kind}' AS dtype, {str(text).lower()} AS is_text, "
                f"count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, "
                f"{number} AS n_number, {date} AS n_date, {parsed} AS n_parsed FROM {view}")
    facts = per_column(types, one)
    return f"""facts AS ({facts}), shares AS (
SELECT *, CAST(n_number AS DOUBLE) / n_rows AS numeric_share,
  coalesce(CAST(n_date AS DOUBLE) / nullif(non_null, 0), 0) AS date_like,
  coalesce(CAST(n_parsed AS DOUBLE) / nullif(non_null, 0), 0) AS date_parsed FROM facts),
prof AS (SELECT *, CASE WHEN NOT is_text THEN 'numeric'
  WHEN non_null >= 3 AND date_like >= 0.6 AND date_parsed >= 0.8 THEN 'datetime'
  WHEN non_null > 0 AND numeric_share >= 0.9 THEN 'numeric' ELSE 'categorical' END AS kind FROM shares)"""


RISK_PROFILE, DIRTY_PROFILE = profile_cte("risk", RISK_TYPES), profile_cte("dirty", DIRTY_TYPES)


# --- scans and sinks -------------------------------------------------------

@query("csv_scan", sql("risk", "SELECT * FROM risk"))
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    csv.write_csv(risk(spark, sf_dir), path)
    return csv.read_csv(spark, path, schema=RISK_SCHEMA)


@query("csv_scan_inferred", sql("risk", """SELECT attrition, count(*) AS n, CAST(sum(emp_id) AS BIGINT) AS ids,
    CAST(sum(age) AS BIGINT) AS ages, round(avg(income), 4) AS income FROM risk GROUP BY attrition"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "csv")
    csv.write_csv(risk(spark, sf_dir), path)
    found = csv.read_csv(spark, path)
    return found.groupBy("attrition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("emp_id").alias("ids"), F.sum("age").alias("ages"),
        F.round(F.avg("income"), 4).alias("income"),
    )


def _encodings_sql() -> str:
    """Lines with a byte that an encoding lacks, from the hexadecimal digits of their UTF-8 bytes."""
    lines = "SELECT hex(encode(unnest(string_split(coalesce(text, ''), chr(10))))) AS h FROM documents"
    rows = []
    for i, name in enumerate(ENCODINGS):
        missing = [] if name.startswith("utf-8") else csv.undecodable_bytes(name)
        bad = f"count_if(regexp_matches(h, '^(..)*({'|'.join(f'{b:02X}' for b in missing)})'))" if missing else "count_if(false)"
        rows.append(f"SELECT CAST({i} AS INT) AS ord, '{name}' AS encoding, CAST({bad} AS BIGINT) AS bad_rows FROM ({lines})")
    return union_all(rows)


@query("csv_scan_encoding", sql(None, _encodings_sql()))
def _(spark, sf_dir):
    """A UTF-8 file of whole texts against all the usual encodings."""
    path = scratch_path(spark, "texts")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return csv.encoding_report(spark, path)


@query("dataset_gate", sql("dirty", """, g AS (SELECT count(*) AS n FROM dirty)
    SELECT 'not_empty' AS "check", n > 0 AS ok, CAST(n AS VARCHAR) AS detail FROM g UNION ALL
    SELECT 'two_columns', true, '9' UNION ALL SELECT 'target_known', true, 'status' UNION ALL
    SELECT 'any_value', true, '' UNION ALL SELECT 'no_empty_column', true, ''"""))
def _(spark, sf_dir):
    return quality.dataset_gate(dirty(spark, sf_dir), "status")


CLEAN_SQL = """cleaned AS (SELECT order_id, line_no, CASE WHEN abs(qty) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE qty END AS qty,
  qty_text, flag, ship_text, status, const_col, signed FROM (SELECT DISTINCT order_id, line_no, qty,
  trim(qty_text) AS qty_text, trim(flag) AS flag, trim(ship_text) AS ship_text, trim(status) AS status, const_col, signed FROM dirty))"""


@query("csv_sink_clean", sql("dirty", """SELECT nullif(flag, '') AS flag, status, count(*) AS n, count(qty) AS n_qty,
    round(avg(qty), 4) AS mean_qty, CAST(sum(order_id) AS BIGINT) AS ids FROM cleaned GROUP BY 1, 2""", CLEAN_SQL))
def _(spark, sf_dir):
    path = scratch_path(spark, "cleaned")
    csv.write_csv(cleaning.clean_dataset(dirty(spark, sf_dir)), path)
    back = csv.read_csv(spark, path, schema=DIRTY_SCHEMA)
    return back.groupBy("flag", "status").agg(
        F.count(F.lit(1)).alias("n"), F.count("qty").alias("n_qty"), F.round(F.avg("qty"), 4).alias("mean_qty"),
        F.sum("order_id").alias("ids"),
    )


@query("risk_export", sql("scored", """SELECT CASE WHEN score * 100 < 30 THEN 'Low' WHEN score * 100 < 60 THEN 'Medium'
    ELSE 'High' END AS risk_band, count(*) AS n, CAST(sum(emp_id) AS BIGINT) AS ids, round(avg(score), 4) AS mean_score
    FROM scored GROUP BY 1"""))
def _(spark, sf_dir):
    path = scratch_path(spark, "risk")
    fixed = lambda df: df.withColumn("probability", F.col("score"))
    reports.export_risk(batch_score(scored(spark, sf_dir), fixed, "emp_id", ["department"]), path)
    return reports.read_risk(spark, path).groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("emp_id").alias("ids"), F.round(F.avg("probability"), 4).alias("mean_score")
    )


@query("preview", sql("risk", "SELECT * FROM risk ORDER BY emp_id LIMIT 15"))
def _(spark, sf_dir):
    return filters.preview(risk(spark, sf_dir), "emp_id", 15)


# --- filters ---------------------------------------------------------------

@query("filter_eq", sql("risk", "SELECT * FROM risk WHERE department = 'BUILDING' AND training = 3"))
def _(spark, sf_dir):
    return filters.apply_filters(risk(spark, sf_dir), {
        "department": "BUILDING", "training": "3", "overtime": "Tất cả", "job_role": "  ", "unknown": "x"})


@query("filter_in", sql("risk", """SELECT * FROM risk WHERE department IN ('BUILDING', 'MACHINERY')
    AND job_satisfaction IN (1, 2)"""))
def _(spark, sf_dir):
    return filters.apply_filters(risk(spark, sf_dir), {
        "department": ["BUILDING", "MACHINERY"], "job_satisfaction": {"1", 2}, "overtime": []})


@query("filter_domain", sql("risk", union_all([
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM risk WHERE {c} IS NOT NULL"
    for c in ("department", "job_role", "overtime", "tenure")])))
def _(spark, sf_dir):
    return filters.filter_domain(risk(spark, sf_dir), ["department", "job_role", "overtime", "tenure"])


@query("filter_suggest", sql("dirty", """SELECT CAST(row_number() OVER (ORDER BY position) - 1 AS INT) AS ord, "column"
    FROM prof WHERE n_unique BETWEEN 2 AND 20 ORDER BY position LIMIT 6""", DIRTY_PROFILE))
def _(spark, sf_dir):
    return profile.suggest_filters(dirty(spark, sf_dir), {"id": "order_id"})


@query("search_any", sql(None, """SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
    OR contains(lower(p_type), 'ring') OR contains(CAST(p_partkey AS VARCHAR), 'ring')"""))
def _(spark, sf_dir):
    return filters.search_any(table(spark, sf_dir, "part"), "RING", literal=True)


@query("search_any_pattern", sql(None, """SELECT * FROM supplier WHERE regexp_matches(lower(s_name), '0[1-4]$')
    OR regexp_matches(CAST(s_acctbal AS VARCHAR), '0[1-4]$') OR regexp_matches(CAST(s_suppkey AS VARCHAR), '0[1-4]$') OR regexp_matches(CAST(s_nationkey AS VARCHAR), '0[1-4]$')"""))
def _(spark, sf_dir):
    return filters.search_any(table(spark, sf_dir, "supplier"), "0[1-4]$")


@query("page", sql("risk", "SELECT * FROM risk ORDER BY emp_id LIMIT 25 OFFSET 75"))
def _(spark, sf_dir):
    return filters.page(risk(spark, sf_dir), "emp_id", 3, 25)


@query("page_deep", sql(None, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 1000"))
def _(spark, sf_dir):
    return filters.page(table(spark, sf_dir, "orders"), "o_orderkey", 40, 25, range_rows=300)


@query("page_text_key", sql(None, "SELECT * FROM customer ORDER BY c_name LIMIT 25 OFFSET 75"))
def _(spark, sf_dir):
    return filters.page(table(spark, sf_dir, "customer"), "c_name", 3, 25, range_rows=60)


@query("page_date_key", sql(None, "SELECT DISTINCT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 25 OFFSET 100"))
def _(spark, sf_dir):
    return filters.page(table(spark, sf_dir, "orders").select("o_orderdate").distinct(), "o_orderdate", 4, 25, range_rows=70)


@query("page_null_key", sql(None, """SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS key FROM orders
    ORDER BY key NULLS FIRST LIMIT 25 OFFSET 1000"""))
def _(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey")).alias("key"))
    return filters.page(keys, "key", 40, 25, range_rows=300)


@query("filter_eq_bigint", sql(None, "SELECT CAST(9007199254740992 + o_orderkey AS BIGINT) AS big, o_custkey FROM orders WHERE o_orderkey IN (1, 3)"))
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.lit(9007199254740992) + F.col("o_orderkey")).alias("big"), "o_custkey")
    return filters.apply_filters(rows, {"big": ["9007199254740993", 9007199254740995]})


@query("band_filter", sql("scored", "SELECT emp_id, score, 'High' AS risk_band FROM scored WHERE score * 100 >= 60"))
def _(spark, sf_dir):
    banded = scored(spark, sf_dir).select("emp_id", "score", risk_band(F.col("score")).alias("risk_band"))
    return filters.band_filter(banded, "High")


@query("feature_projection", sql("risk", """SELECT "column", CASE WHEN is_text THEN 'categorical' ELSE 'numeric' END AS role
    FROM prof WHERE "column" NOT IN ('emp_id', 'attrition') AND n_unique > 1 AND NOT regexp_matches("column", '(id|code|number)$')
    AND NOT (is_text AND n_unique >= 0.98 * non_null)""", RISK_PROFILE))
def _(spark, sf_dir):
    return profile.feature_projection(risk(spark, sf_dir), "attrition", "emp_id")


@query("identifier_columns", sql(None, """SELECT 'c_name' AS "column", count(DISTINCT c_name) AS n_unique FROM customer"""))
def _(spark, sf_dir):
    return profile.identifier_columns(table(spark, sf_dir, "customer"))


@query("to_numeric", sql("dirty", f"""SELECT order_id, line_no, CASE WHEN regexp_matches(qty_text, {NUMBER_SQL})
    THEN try_cast(trim(qty_text) AS DOUBLE) END AS value FROM dirty"""))
def _(spark, sf_dir):
    rows = dirty(spark, sf_dir)
    return rows.select("order_id", "line_no", to_number(rows, "qty_text").alias("value"))


@query("valid_target_rows", sql("dirty", f"""SELECT status, count(*) AS n FROM dirty
    WHERE regexp_matches(qty_text, {NUMBER_SQL}) GROUP BY status"""))
def _(spark, sf_dir):
    rows = dirty(spark, sf_dir)
    return filters.valid_target_rows(rows, to_number(rows, "qty_text")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("support_filter", sql("events", """, g AS (SELECT job_role, count(*) AS total, CAST(sum(event) AS BIGINT) AS leaving FROM ev GROUP BY 1)
    SELECT job_role, total, leaving, round(100.0 * leaving / total, 4) AS rate FROM g
    WHERE total >= 600 OR (SELECT max(total) FROM g) < 600"""))
def _(spark, sf_dir):
    return rounded(filters.support_filter(outcome.rate_by_group(events(spark, sf_dir), "job_role"), 600))


@query("two_class_guard", sql("risk", """SELECT 'two_classes' AS "check", count(DISTINCT attrition) >= 2 AS ok,
    count(DISTINCT attrition) AS n_labels FROM risk"""))
def _(spark, sf_dir):
    return target.two_class_guard(risk(spark, sf_dir), "attrition")


# --- cleaning --------------------------------------------------------------

@query("trim_strings", sql("dirty", """SELECT * REPLACE (trim(qty_text) AS qty_text, trim(flag) AS flag, trim(ship_text) AS ship_text, trim(status) AS status) FROM dirty"""))
def _(spark, sf_dir):
    return cleaning.trim_strings(dirty(spark, sf_dir))


@query("inf_to_null", sql("dirty", """SELECT * REPLACE (CASE WHEN abs(qty) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE qty END AS qty) FROM dirty"""))
def _(spark, sf_dir):
    return cleaning.inf_to_null(dirty(spark, sf_dir))


@query("inf_counts", sql("dirty", """SELECT 'qty' AS "column", count_if(abs(qty) = CAST('Infinity' AS DOUBLE)) AS inf_count FROM dirty"""))
def _(spark, sf_dir):
    return cleaning.inf_counts(dirty(spark, sf_dir))


@query("drop_duplicates", sql("dirty", "SELECT DISTINCT * FROM dirty"))
def _(spark, sf_dir):
    return cleaning.drop_duplicate_rows(dirty(spark, sf_dir))


@query("clean_dataset", sql("dirty", "SELECT * FROM cleaned", CLEAN_SQL))
def _(spark, sf_dir):
    return cleaning.clean_dataset(dirty(spark, sf_dir))


MISSING_SUM = " + ".join(f"count(*) - count({c})" for c in DIRTY_TYPES)


def outliers_cte(view: str, columns: list[str]) -> str:
    quart = union_all([f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {view}" for c in columns])
    cells = union_all([f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM {view} WHERE {c} IS NOT NULL" for c in columns])
    return f"""quart AS ({quart}), fences AS (SELECT "column", CAST(q1 AS DOUBLE) AS q1, CAST(q3 AS DOUBLE) AS q3, q3 - q1 AS iqr,
  q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM quart), cells AS ({cells}),
outliers AS (SELECT f."column", q1, q3, iqr, lower_bound, upper_bound,
  count_if(x < lower_bound OR x > upper_bound) AS outlier_count,
  100.0 * count_if(x < lower_bound OR x > upper_bound) / count(*) AS outlier_pct
  FROM cells c JOIN fences f ON c."column" = f."column" GROUP BY ALL)"""


DIRTY_NUMBERS = [c for c, t in DIRTY_TYPES.items() if not is_text(t)]
RISK_NUMBERS = [c for c, t in RISK_TYPES.items() if not is_text(t)]


@query("clean_report", sql("dirty", f"""SELECT count(*) AS rows_before, 9 AS cols_before, {MISSING_SUM} AS missing_before,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates_before,
    (SELECT count(*) FROM cleaned) AS rows_after, 9 AS cols_after, (SELECT {MISSING_SUM} FROM cleaned) AS missing_after,
    (SELECT count(*) FROM cleaned) - (SELECT count(*) FROM (SELECT DISTINCT * FROM cleaned)) AS duplicates_after,
    (SELECT count_if(abs(qty) = CAST('Infinity' AS DOUBLE)) FROM (SELECT DISTINCT * FROM dirty)) AS inf_replaced,
    concat('trimmed 4 text columns; kept ', (SELECT {MISSING_SUM} FROM kept), ' missing values; removed ',
      count(*) - (SELECT count(*) FROM kept), ' duplicate rows; kept ', (SELECT CAST(sum(outlier_count) AS BIGINT) FROM outliers),
      ' IQR outliers; set ', (SELECT count_if(abs(qty) = CAST('Infinity' AS DOUBLE)) FROM kept), ' infinities to NULL') AS actions
    FROM dirty""", CLEAN_SQL, "kept AS (SELECT DISTINCT * FROM dirty)", outliers_cte("kept", DIRTY_NUMBERS)))
def _(spark, sf_dir):
    return cleaning.clean_report(dirty(spark, sf_dir))


@query("default_fill", sql("dirty", """, m AS (SELECT quantile_cont(qty, 0.5) AS med FROM dirty),
    f AS (SELECT flag FROM dirty WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)
    SELECT * REPLACE (coalesce(qty, (SELECT med FROM m)) AS qty, coalesce(flag, (SELECT flag FROM f)) AS flag) FROM dirty"""))
def _(spark, sf_dir):
    return cleaning.default_fill(dirty(spark, sf_dir), ["qty", "flag"])


@query("column_defaults", sql("risk", union_all(
    [f"SELECT '{c}' AS \"column\", CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS text FROM risk" for c in RISK_NUMBERS]
    + [f"(SELECT '{c}' AS \"column\", CAST(NULL AS DOUBLE) AS number, {c} AS text FROM risk GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
       for c, t in RISK_TYPES.items() if is_text(t)])))
def _(spark, sf_dir):
    return cleaning.column_defaults(risk(spark, sf_dir))


# --- quality and profile ---------------------------------------------------

MISSING_SQL = per_column(DIRTY_TYPES, lambda c, t, i: f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
    round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct FROM dirty""")
DUPLICATES_SQL = """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_count FROM dirty"""
LEVELS_SQL = per_column(DIRTY_TYPES, lambda c, t, i: f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_categories,
    array_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER ({c} IS NOT NULL)) AS categories FROM dirty
    HAVING count(DISTINCT {c}) BETWEEN 1 AND {50 if is_text(t) else 20}""")
INVALID_SQL = per_column(DIRTY_TYPES, lambda c, t, i: f"""SELECT '{c}' AS "column", CAST(0 AS BIGINT) AS inf_count, CAST(0 AS BIGINT) AS negative_count,
    count({c}) - count_if(regexp_matches({c}, {NUMBER_SQL})) AS invalid_count, count(*) AS n FROM dirty
    HAVING count({c}) > 0 AND count_if(regexp_matches({c}, {NUMBER_SQL})) >= 0.5 * count(*)""" if is_text(t) else
    f"""SELECT '{c}' AS "column", count_if(abs(CAST({c} AS DOUBLE)) = CAST('Infinity' AS DOUBLE)) AS inf_count, count_if({c} < 0) AS negative_count,
    count_if(abs(CAST({c} AS DOUBLE)) = CAST('Infinity' AS DOUBLE)) AS invalid_count, count(*) AS n FROM dirty""")


@query("missing_summary", sql("dirty", MISSING_SQL))
def _(spark, sf_dir):
    return rounded(quality.missing_summary(dirty(spark, sf_dir)))


@query("sort_missing", sql("dirty", f"SELECT * FROM ({MISSING_SQL}) ORDER BY missing_count DESC, \"column\" LIMIT 2"))
def _(spark, sf_dir):
    return rounded(quality.missing_summary(dirty(spark, sf_dir)).limit(2))


@query("duplicate_summary", sql("dirty", f"SELECT *, round(100.0 * duplicate_count / n_rows, 4) AS duplicate_pct FROM ({DUPLICATES_SQL})"))
def _(spark, sf_dir):
    return rounded(quality.duplicate_summary(dirty(spark, sf_dir)))


@query("categorical_uniques", sql("dirty", f"SELECT \"column\", n_categories, array_to_string(categories, '|') AS categories FROM ({LEVELS_SQL})"))
def _(spark, sf_dir):
    return profile.categorical_uniques(dirty(spark, sf_dir)).select(
        "column", "n_categories", F.array_join("categories", "|").alias("categories"))


@query("invalid_numeric", sql("dirty", f"""SELECT "column", inf_count, negative_count, invalid_count,
    round(100.0 * invalid_count / n, 4) AS invalid_pct FROM ({INVALID_SQL})"""))
def _(spark, sf_dir):
    return rounded(quality.invalid_numeric(dirty(spark, sf_dir)))


VALIDATE_SQL = f"""SELECT 'missing' AS "check", "column", 'missing_count' AS metric, CAST(missing_count AS DOUBLE) AS value FROM ({MISSING_SQL})
  UNION ALL SELECT 'missing', NULL, 'total_missing', CAST(sum(missing_count) AS DOUBLE) FROM ({MISSING_SQL})
  UNION ALL SELECT 'duplicates', NULL, 'duplicate_count', CAST(duplicate_count AS DOUBLE) FROM ({DUPLICATES_SQL})
  UNION ALL SELECT 'levels', "column", 'n_categories', CAST(n_categories AS DOUBLE) FROM ({LEVELS_SQL})
  UNION ALL SELECT 'invalid_numeric', "column", 'invalid_count', CAST(invalid_count AS DOUBLE) FROM ({INVALID_SQL})
  UNION ALL """ + union_all([f"SELECT 'numeric_columns', '{c}', 'non_null', CAST(count({c}) AS DOUBLE) FROM dirty" for c in DIRTY_NUMBERS])


@query("validate_dataset", sql("dirty", VALIDATE_SQL))
def _(spark, sf_dir):
    return quality.validate_dataset(dirty(spark, sf_dir))


@query("quality_check", sql("dirty", VALIDATE_SQL + """ UNION ALL SELECT 'outliers', "column", 'outlier_count',
    CAST(outlier_count AS DOUBLE) FROM outliers""", outliers_cte("dirty", DIRTY_NUMBERS)))
def _(spark, sf_dir):
    return quality.quality_check(dirty(spark, sf_dir))


OUTLIER_FIELDS = """"column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(iqr, 4) AS iqr, round(lower_bound, 4) AS lower_bound,
    round(upper_bound, 4) AS upper_bound, outlier_count, round(outlier_pct, 4) AS outlier_pct"""


@query("iqr_outliers", sql("dirty", f"SELECT {OUTLIER_FIELDS} FROM outliers", outliers_cte("dirty", DIRTY_NUMBERS)))
def _(spark, sf_dir):
    return rounded(quality.iqr_outliers(dirty(spark, sf_dir)))


@query("iqr_outliers_lineitem", sql(None, f"SELECT {OUTLIER_FIELDS} FROM outliers",
                                    outliers_cte("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])))
def _(spark, sf_dir):
    return rounded(quality.iqr_outliers(table(spark, sf_dir, "lineitem"),
                                        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


PROFILE_FIELDS = """"column", CAST(position AS INT) AS position, kind, CASE dtype WHEN 'string' THEN 'string' ELSE dtype END AS dtype, n_rows, non_null,
    n_rows - non_null AS missing, round(100.0 * (n_rows - non_null) / n_rows, 4) AS missing_pct, n_unique,
    round(numeric_share, 4) AS numeric_share, round(date_like, 4) AS date_like, round(date_parsed, 4) AS date_parsed"""


@query("column_profile", sql("dirty", f"SELECT {PROFILE_FIELDS} FROM prof", DIRTY_PROFILE))
def _(spark, sf_dir):
    return rounded(profile.column_profile(dirty(spark, sf_dir)))


@query("column_profile_documents", sql(None, """SELECT * FROM (
    SELECT 'doc_id' AS "column", count(*) AS n_rows, count(doc_id) AS non_null, count(DISTINCT doc_id) AS n_unique FROM documents UNION ALL
    SELECT 'text', count(*), count(text), count(DISTINCT text) FROM documents UNION ALL
    SELECT 'lang', count(*), count(lang), count(DISTINCT lang) FROM documents UNION ALL
    SELECT 'source', count(*), count(source), count(DISTINCT source) FROM documents UNION ALL
    SELECT 'n_chars', count(*), count(n_chars), count(DISTINCT n_chars) FROM documents)"""))
def _(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "documents")).select("column", "n_rows", "non_null", "n_unique")


@query("infer_kind", sql("dirty", 'SELECT "column", kind FROM prof', DIRTY_PROFILE))
def _(spark, sf_dir):
    return profile.infer_kind(dirty(spark, sf_dir))


@query("datetime_detect", sql("dirty", """SELECT "column", round(date_like, 4) AS date_like, round(date_parsed, 4) AS date_parsed,
    kind = 'datetime' AS is_datetime FROM prof WHERE is_text""", DIRTY_PROFILE))
def _(spark, sf_dir):
    return rounded(profile.datetime_columns(dirty(spark, sf_dir)))


@query("constant_columns", sql("dirty", 'SELECT "column", n_unique FROM prof WHERE n_unique <= 1', DIRTY_PROFILE))
def _(spark, sf_dir):
    return profile.constant_columns(profile.column_profile(dirty(spark, sf_dir)))


CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
CUSTOMER_PROFILE = profile_cte("customer", CUSTOMER_TYPES)


@query("high_cardinality", sql(None, """SELECT "column", n_unique FROM prof WHERE kind = 'categorical' AND n_unique >= 0.9 * n_rows""", CUSTOMER_PROFILE))
def _(spark, sf_dir):
    return profile.high_cardinality(profile.column_profile(table(spark, sf_dir, "customer")))


@query("id_like", sql("risk", """SELECT "column", n_unique FROM prof WHERE regexp_matches("column", 'id|employee|manhanvien|empid')
    AND n_unique >= 0.9 * n_rows""", RISK_PROFILE))
def _(spark, sf_dir):
    return profile.id_like(profile.column_profile(risk(spark, sf_dir)))


@query("profile_dataset", sql("dirty", """SELECT max(n_rows) AS row_count, count(*) AS column_count,
    count_if(kind = 'numeric') AS numeric_count, count_if(kind = 'categorical') AS categorical_count,
    count_if(kind = 'datetime') AS datetime_count, CAST(0 AS BIGINT) AS boolean_count,
    CAST(sum(n_rows - non_null) AS BIGINT) AS missing_cells,
    (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicate_rows,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (n_unique <= 1), '') AS constant_columns,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (kind = 'categorical' AND n_unique >= 0.9 * n_rows), '') AS high_cardinality_columns,
    coalesce(string_agg("column", ',' ORDER BY "column") FILTER (regexp_matches("column", 'id|employee') AND n_unique >= 0.9 * n_rows), '') AS id_columns,
    'signed,status' AS target_candidates FROM prof""", DIRTY_PROFILE))
def _(spark, sf_dir):
    return quality.profile_dataset(dirty(spark, sf_dir))


@query("target_candidates", sql("risk", """SELECT "column", ord, by_alias, by_labels FROM (
    SELECT 'overtime' AS "column", CAST(3 AS INT) AS ord, false AS by_alias, bool_or(lower(overtime) IN ('yes', 'no')) AS by_labels, count(DISTINCT overtime) AS n FROM risk UNION ALL
    SELECT 'attrition', -1, true, bool_or(lower(attrition) IN ('yes', 'no')), count(DISTINCT attrition) FROM risk) WHERE n = 2"""))
def _(spark, sf_dir):
    return profile.target_candidates(risk(spark, sf_dir))


QUALITY_FACTS = f"""q AS (SELECT count(*) AS n, {MISSING_SUM} AS missing,
  {' + '.join(f"count_if(trim({c}) = '')" for c, t in DIRTY_TYPES.items() if is_text(t))} AS empty_strings,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS duplicates,
  count(*) - count(DISTINCT order_id) AS id_duplicates,
  count_if(abs(qty) = CAST('Infinity' AS DOUBLE)) AS inf_count,
  count(qty_text) - count_if(regexp_matches(qty_text, {NUMBER_SQL})) AS invalid_numeric,
  1 AS constant_columns FROM dirty),
parts AS (SELECT 100.0 * (1 - (missing + empty_strings) / (n * 9.0)) AS completeness,
  least(100.0 * (1 - duplicates / CAST(n AS DOUBLE)), 100.0 * (1 - id_duplicates / CAST(n AS DOUBLE))) AS uniqueness,
  100.0 * (1 - least((inf_count + invalid_numeric) / CAST(n AS DOUBLE), 1)) AS validity,
  CAST(92 AS DOUBLE) AS consistency FROM q)"""


@query("quality_score", sql("dirty", """SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness,
    round(validity, 4) AS validity, consistency, score, CASE WHEN score >= 90 THEN 'Good' WHEN score >= 70 THEN 'Fair' ELSE 'Needs attention' END AS label
    FROM (SELECT *, round(CAST(0.35 * completeness + 0.25 * uniqueness + 0.25 * validity + 0.15 * consistency AS DOUBLE), 1) AS score FROM parts)""", QUALITY_FACTS))
def _(spark, sf_dir):
    return rounded(quality.quality_score(dirty(spark, sf_dir), "order_id"))


@query("quality_issues", sql("dirty", "SELECT * FROM (" + union_all(
    [f"SELECT '{k}' AS issue, CAST({k} AS BIGINT) AS n FROM q" for k in
     ("missing", "empty_strings", "duplicates", "id_duplicates", "inf_count", "invalid_numeric", "constant_columns")]
    + ["SELECT 'iqr_outliers', CAST(sum(outlier_count) AS BIGINT) FROM outliers"]) + ") WHERE n > 0",
    QUALITY_FACTS, outliers_cte("dirty", DIRTY_NUMBERS)))
def _(spark, sf_dir):
    return quality.quality_issues(dirty(spark, sf_dir), "order_id")


@query("schema_summary", sql("risk", """SELECT max(n_rows) AS n_rows, count(*) AS n_cols,
    count_if(NOT is_text AND "column" NOT IN ('emp_id')) AS n_numeric,
    count_if(is_text AND "column" NOT IN ('attrition') AND n_unique > 1 AND n_unique < 0.98 * non_null) AS n_categorical,
    CAST(sum(n_rows - non_null) AS BIGINT) AS missing_total,
    (SELECT count(*) FROM risk) - (SELECT count(*) FROM (SELECT DISTINCT * FROM risk)) AS duplicate_total,
    concat(coalesce(string_agg("column", ',') FILTER (n_unique <= 1), ''), 'emp_id') AS junk_columns,
    'attrition,overtime' AS target_candidates, 'attrition' AS target, 'department,overtime' AS filter_columns FROM prof""", RISK_PROFILE))
def _(spark, sf_dir):
    return quality.schema_summary(risk(spark, sf_dir))


@query("data_dictionary", sql("risk", """SELECT "column", CASE "column" WHEN 'attrition' THEN 'Target' WHEN 'emp_id' THEN 'ID' ELSE 'Feature' END AS usage,
    kind, dtype, non_null, n_rows - non_null AS missing, n_unique FROM prof""", RISK_PROFILE))
def _(spark, sf_dir):
    return profile.data_dictionary(risk(spark, sf_dir), "attrition", "emp_id")


def _fingerprint_sql() -> str:
    columns = ["order_id", "line_no", "qty", "qty_text", "flag", "ship_text", "status", "const_col", "signed"]
    text = {c: f"CAST({c} AS VARCHAR)" for c in columns} | {"qty": "CASE WHEN isinf(qty) THEN 'Infinity' ELSE CAST(qty AS VARCHAR) END"}
    cells = " || ".join(f"CASE WHEN {c} IS NULL THEN 'N' ELSE concat(length({t}), ':', {t}) END" for c, t in text.items())
    sums = [f"CAST(sum(CAST(CAST(concat('0x', substr(m, {start}, 15)) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for start in (1, 16)]
    return f"SELECT count(*) AS n_rows, CAST({len(columns)} AS INT) AS n_cols, {sums[0]} AS sum_a, {sums[1]} AS sum_b FROM (SELECT md5({cells}) AS m FROM dirty)"


@query("table_fingerprint", sql("dirty", _fingerprint_sql()))
def _(spark, sf_dir):
    return quality.table_fingerprint(dirty(spark, sf_dir))

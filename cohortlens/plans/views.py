"""Input views of the named queries, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = {
    "id": "emp_id", "target": "attrition", "department": "department", "job_role": "job_role", "overtime": "overtime",
    "job_satisfaction": "job_satisfaction", "income": "income", "tenure": "tenure", "distance": "distance",
    "performance": "performance", "training": "training", "age": "age",
}
MEASURES = ["income", "tenure", "distance", "performance", "training", "age", "job_satisfaction"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, read as one employee."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    # Customers grow with the tables: never through the driver, whatever their files seem to hold.
    joined = orders.join(customer.hint("merge"), orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.select(
        F.col("o_orderkey").alias("emp_id"), F.col("c_mktsegment").alias("department"), F.col("n_name").alias("job_role"),
        F.when(urgent, "Yes").otherwise("No").alias("overtime"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("job_satisfaction"),
        F.col("o_totalprice").alias("income"), (2003 - F.year("o_orderdate")).cast("int").alias("tenure"),
        F.col("c_acctbal").alias("distance"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("performance"),
        (F.col("o_custkey") % 6).cast("int").alias("training"), (22 + F.col("o_custkey") % 40).cast("int").alias("age"),
        F.when((urgent & (F.col("o_orderkey") % 3 == 0)) | (F.col("o_orderkey") % 11 == 0), "Yes").otherwise("No").alias("attrition"),
    )


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with missing, infinite, blank, mistyped and repeated values."""
    item, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    base = item.select(
        key.alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.when(key % 17 == 0, F.lit(None)).when(key % 97 == 1, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(key % 29 == 0, "bad").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("qty_text"),
        F.when(key % 13 == 0, "  ").when(key % 31 == 0, F.lit(None)).otherwise(
            F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))).alias("flag"),
        F.substring(F.col("l_shipdate").cast("date").cast("string"), 1, 10).alias("ship_text"),
        F.col("l_linestatus").alias("status"), F.lit(1).alias("const_col"), (F.col("l_discount") - 0.05).alias("signed"),
    )
    return base.unionByName(base.where("order_id % 19 = 0"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed scores with many ties."""
    return risk(spark, sf_dir).select(
        "emp_id", "department", "attrition", F.when(F.col("attrition") == "Yes", 1).otherwise(0).alias("y"),
        ((F.col("emp_id") * 7919) % 1000 / F.lit(1000.0)).alias("score"),
    )


RISK_SQL = """risk AS (
SELECT o.o_orderkey AS emp_id, c.c_mktsegment AS department, n.n_name AS job_role,
  CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Yes' ELSE 'No' END AS overtime,
  CAST(substr(o.o_orderpriority,1,1) AS INT) AS job_satisfaction,
  o.o_totalprice AS income, CAST(2003 - year(o.o_orderdate) AS INT) AS tenure,
  c.c_acctbal AS distance, CAST(o.o_orderkey % 4 + 1 AS INT) AS performance,
  CAST(o.o_custkey % 6 AS INT) AS training, CAST(22 + o.o_custkey % 40 AS INT) AS age,
  CASE WHEN (o.o_orderpriority IN ('1-URGENT','2-HIGH') AND o.o_orderkey % 3 = 0)
         OR o.o_orderkey % 11 = 0 THEN 'Yes' ELSE 'No' END AS attrition
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
              JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

EVENTS_SQL = RISK_SQL + """, ev AS (
SELECT *, CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS event FROM risk)"""

DIRTY_SQL = """dirty_base AS (
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL
       WHEN l_orderkey % 97 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS qty,
  CASE WHEN l_orderkey % 29 = 0 THEN 'bad' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty_text,
  CASE WHEN l_orderkey % 13 = 0 THEN '  ' WHEN l_orderkey % 31 = 0 THEN NULL
       ELSE concat(' ', l_returnflag, ' ') END AS flag,
  substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR),1,10) AS ship_text,
  l_linestatus AS status, 1 AS const_col, l_discount - 0.05 AS signed
FROM lineitem),
dirty AS (SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE order_id % 19 = 0)"""

SCORED_SQL = RISK_SQL + """, scored AS (
SELECT emp_id, department, attrition, CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS y,
  CAST(((emp_id * 7919) % 1000) / 1000.0 AS DOUBLE) AS score FROM risk)"""

VIEWS = {"risk": RISK_SQL, "events": EVENTS_SQL, "dirty": DIRTY_SQL, "scored": SCORED_SQL}


def plain_counts(text: str) -> str:
    """Give ``count_if`` the type of ``count``: DuckDB counts with it in 128 bits."""
    out, at = "", 0
    while (start := text.find("count_if(", at)) >= 0:
        end, depth = start + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out += text[at:start] + f"CAST({text[start:end]} AS BIGINT)"
        at = end
    return out + text[at:]


def sql(view: str | None, body: str, *ctes: str) -> str:
    """``body`` over one of the views, with more named parts if given."""
    parts = [*([VIEWS[view]] if view else []), *ctes]
    return plain_counts((f"WITH {', '.join(parts)} " if parts else "") + body)

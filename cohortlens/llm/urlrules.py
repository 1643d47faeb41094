"""URL rules by a sort-merge range join.

A rule names a host (with all its subdomains) and a path prefix.  Its canonical key is the reversed
host followed by the path, such as ``org.example/es/``; the keys that start with it form one interval
of the byte order, and the intervals of two rules are nested or disjoint.  A url has one key for each
suffix of its host.  Rules and keys are sorted together; a running depth is the height of the stack of
rules open at a key, and the rule on top is the last one that was opened at that depth.

Keys are dealt out over ``salts`` sweeps by a hash of the row, never by host, so a hot host is spread;
each sweep also sees all rules.  Everything is built-in column functions.

Defined cases: a url that is null or has no ``://`` has empty host and path and fits no rule; repeated
rows each get a row; rules with the same host and path count once, block before allow; rules with a null
host or path are ignored; an empty rule table leaves every url to the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", salts: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule (host, path, verdict) that fits each url, else ``default``."""
    spark = urls.sparkSession
    salts = salts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url_col))
    parts = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn(
        "row", F.monotonically_increasing_id())
    keyed = parts.select("*", F.posexplode(_reversed(F.col("host"))).alias("pos", "label")).select(
        F.pmod(F.xxhash64("row", "pos"), F.lit(salts)).cast("int").alias("salt"),
        F.concat(F.array_join(F.slice(_reversed(F.col("host")), 1, F.col("pos") + 1), "."), "path").cast("binary").alias("key"),
        F.lit(1).alias("kind"), F.lit(0).alias("step"), "id", "row", "host", "path",
        F.lit(None).cast("struct<chars:int,rule:string,verdict:string>").alias("opened"),
    )
    clean = rules.where("host is not null and path is not null").groupBy(
        F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    text = F.concat("host", "path")
    rule_key = F.concat(F.array_join(_reversed(F.col("host")), "."), "path").cast("binary")
    ends = F.array(
        F.struct(rule_key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"),
                 F.struct(F.length(text).alias("chars"), text.alias("rule"), F.col("verdict").alias("verdict")).alias("opened")),
        F.struct(F.concat(rule_key, F.lit(b"\xff")).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"),
                 F.lit(None).cast("struct<chars:int,rule:string,verdict:string>").alias("opened")),
    )
    events = clean.select(F.explode(ends).alias("e")).select("e.*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")).select(
        "salt", "key", "kind", "step",
        F.lit(None).cast(parts.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("row"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "opened")
    sweep = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy("salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = keyed.unionByName(events).withColumn("depth", F.sum("step").over(sweep)).withColumn(
        "top", F.last("opened", ignorenulls=True).over(level))
    fits = F.when(F.col("depth") > 0, F.col("top"))
    return swept.where("row is not null").groupBy("row").agg(
        F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(fits).alias("best"),
    ).select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Running totals and ranks over an order, without a one-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.session import broadcast_if_small

#: Rows of one range; the number of ranges follows the counted rows.
RANGE_ROWS = 1_000_000
LEAST_RANGES, MOST_RANGES = 8, 10_000


def range_count(rows: int) -> int:
    return min(max(LEAST_RANGES, -(-rows // RANGE_ROWS)), MOST_RANGES)


def range_buckets(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``bucket``: an ascending range number from evenly filled ranges of ``order``; NULL is the range -1.

    Only the cut points reach the driver.
    """
    ranges = ranges or range_count(df.count())
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5))
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), steps, F.lit(ranges * 20))).first()[0] or []
    cuts = sorted({float(c) for c in found if c == c and abs(c) != float("inf")})
    numbered = df.withColumn("_order", F.col(order).cast("double"))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return numbered.withColumn("bucket", F.when(F.col("_order").isNull(), -1.0).otherwise(0.0)).drop("_order")
    cut = Bucketizer(splits=splits, inputCol="_order", outputCol="bucket", handleInvalid="keep").transform(numbered)
    return cut.withColumn("bucket", F.when(F.col("_order").isNull(), -1.0).otherwise(F.col("bucket"))).drop("_order")


def running_totals(
    df: DataFrame,
    by: list[str],
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    ties: list[Column] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add a running total for every ``sums`` entry (new name -> column).

    Rows are cut into ranges of ``order``.  Totals per range are added up in a
    table of ``ranges`` rows per group, and each range is then summed on its own,
    so no task sees more than one range of one group.
    """
    cut = range_buckets(df, order, ranges)
    way = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    totals = cut.groupBy(*by, "bucket").agg(
        *[F.sum(column).alias(f"_t_{name}") for name, column in sums.items()]
    )
    before = Window.partitionBy(*by).orderBy(way(F.col("bucket"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "bucket",
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
    )
    within = Window.partitionBy(*by, "bucket").orderBy(way(F.col(order)), *(ties or [])).rowsBetween(
        Window.unboundedPreceding, 0
    )
    same = F.col("c.bucket") == F.col("o.bucket")
    for name in by:
        same = same & F.col(f"c.{name}").eqNullSafe(F.col(f"o.{name}"))
    kept = offsets.select(*[F.col(name) for name in by], "bucket", *[f"_o_{name}" for name in sums])
    joined = cut.alias("c").join(broadcast_if_small(kept).alias("o"), same).select("c.*", *[f"o._o_{name}" for name in sums])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{name}") + F.sum(column).over(within)).alias(name) for name, column in sums.items()],
    )


def with_position(df: DataFrame, order: str, ties: list[Column], descending: bool = False,
                  ranges: int | None = None) -> DataFrame:
    """Add the 1-based ``position`` of every row in a total order."""
    ones = df.withColumn("_one", F.lit(1))
    return running_totals(ones, [], order, {"position": "_one"}, descending, ties, ranges).drop("_one")

"""Exact quantiles that hold no unbounded group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one map.
That is right for ages or ratings, and wrong for a continuous measure over
billions of rows.  ``exact_quantiles`` looks at the number of distinct values
of each measure first.  Measures with few of them use ``percentile``.  The others
are kept as a table of numbers, counted in equal-width bins between their ends, and
again inside the bins that hold the wanted ranks, until few values are left there.
Every count is exact, so the result is.
"""

from __future__ import annotations

from functools import reduce
from itertools import cycle

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlens.session import broadcast_if_small, checkpointed

#: Distinct values that a map may hold, values of a bin that are sorted at once, and bins of a bracket.
MAP_LIMIT = 100_000
INSIDE_LIMIT = 100_000
BINS = 1 << 15


def _long(df: DataFrame, measures: dict[str, Column], by: str | None) -> DataFrame:
    """(grp, measure, x) with one row per non-null value."""
    group = F.col(by) if by else F.lit(None).cast("string")
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("double").alias("x"))
                      for n, c in measures.items()])
    return df.select(group.alias("grp"), F.inline(cells)).where(
        F.col("x").isNotNull() & ~F.isnan("x")
    ).withColumn("x", F.col("x") + F.lit(0.0))


def distinct_values(df: DataFrame, measures: dict[str, Column], by: str | None = None) -> dict[str, int]:
    """About how many distinct values each measure has in its widest group."""
    sketch = [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(measures.values())]
    grouped = df.groupBy(by).agg(*sketch) if by else df.agg(*sketch)
    widest = grouped.agg(*[F.max(f"d{i}") for i in range(len(measures))]).first()
    return {m: n or 0 for m, n in zip(measures, widest, strict=True)}


def exact_quantiles(
    df: DataFrame,
    measures: dict[str, Column],
    probs: list[float],
    by: str | None = None,
    map_limit: int = MAP_LIMIT,
    inside_limit: int = INSIDE_LIMIT,
    distinct: dict[str, int] | None = None,
) -> DataFrame:
    """(grp, measure, n, q) with ``q`` the linearly interpolated quantiles of ``probs``.

    ``grp`` is NULL without ``by``.  Measures without any value give no row.  ``distinct`` is
    ``distinct_values`` if known already.
    """
    found = distinct_values(df, measures, by) if distinct is None else distinct
    room, few = map_limit, {}
    for m in sorted(measures, key=lambda m: found[m]):  # together they share the room
        if found[m] > room or map_limit <= 0:
            break
        few[m], room = measures[m], room - found[m]
    if len(few) == len(measures):
        return _by_map(df, few, probs, by)
    # The measures alone are computed once and kept for the passes over them.
    own = {m: F.col(f"m{i}") for i, m in enumerate(measures)}
    numbers = df.select(*([F.col(by).alias("grp")] if by else []), *[c.cast("double").alias(f"m{i}") for i, c in enumerate(measures.values())])
    numbers, group = numbers.persist(StorageLevel.MEMORY_AND_DISK), "grp" if by else None
    try:
        rows = _by_bins(_long(numbers, {m: c for m, c in own.items() if m not in few}, group), probs, inside_limit)
        if few:
            rows = _by_map(numbers, {m: own[m] for m in few}, probs, group).unionByName(rows)
        return checkpointed(rows)
    finally:
        numbers.unpersist()


def _by_map(df: DataFrame, measures: dict[str, Column], probs: list[float], by: str | None) -> DataFrame:
    names = list(measures)
    values = [F.nullif(c.cast("double"), F.lit(float("nan"))) for c in measures.values()]
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    aggs = []
    for i, value in enumerate(values):
        aggs += [F.count(value).alias(f"n{i}"), F.percentile(value, wanted).alias(f"q{i}")]
    wide = df.groupBy(F.col(by).alias("grp")).agg(*aggs) if by else df.agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(f"n{i}").alias("n"), F.col(f"q{i}").alias("q"))
        for i, n in enumerate(names)
    ])
    group = F.col("grp") if by else F.lit(None).cast("string").alias("grp")
    return wide.select(group, F.inline(cells)).where("n > 0")


def _by_bins(long: DataFrame, probs: list[float], inside_limit: int) -> DataFrame:
    keys, bracket = ["grp", "measure"], ["grp", "measure", "lo", "hi"]

    def same(left: str, right: str) -> Column:
        return F.expr(f"{left}.grp <=> {right}.grp AND {left}.measure = {right}.measure")

    # A row for each of the two values that a quantile lies between; both ends of the first bracket are values.
    wanted = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(upper).alias("upper"), F.lit(float(p)).alias("p"))
                       for i, p in enumerate(probs) for upper in (False, True)])
    place = F.col("p") * (F.col("n") - 1)
    ends = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    state = checkpointed(ends.select("*", F.inline(wanted)).select(
        *keys, "slot", "upper", "n", place.alias("pos"), F.when(F.col("upper"), F.ceil(place)).otherwise(F.floor(place)).alias("k"),
        "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")))

    def inside(state: DataFrame) -> DataFrame:
        side = broadcast_if_small(state.select(*bracket).distinct()).alias("s")
        return long.alias("v").join(side, same("v", "s") & F.expr("x BETWEEN lo AND hi")).select("s.*", "v.x")

    def at_rank(counted: DataFrame, state: DataFrame, order: str) -> DataFrame:
        """For each wanted rank the row of ``counted`` that holds it, with the number of values ``before`` it in its bracket."""
        upto = Window.partitionBy(*bracket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        summed = counted.withColumn("cum", F.sum("c").over(upto)).alias("c")
        rank = F.expr("s.k - s.below >= c.cum - c.c AND s.k - s.below < c.cum")
        return broadcast_if_small(state).alias("s").join(
            summed, same("c", "s") & F.expr("c.lo <=> s.lo AND c.hi <=> s.hi") & rank
        ).withColumn("before", F.expr("s.below + c.cum - c.c"))

    def scale(c: str) -> Column:
        """Magnitudes with their sign: parts values of any size."""
        x = F.col(c)
        return F.signum(x) * F.coalesce(F.log2(F.nullif(F.abs(x), F.lit(0.0))) + 1100, F.lit(0.0))

    def step(x: Column, lo: Column, hi: Column) -> Column:
        """Never falls as ``x`` grows; halves keep the widest range finite."""
        share = F.try_divide(x / 2 - lo / 2, hi / 2 - lo / 2)
        return F.floor(F.coalesce(share, F.lit(0.0)) * (BINS - 1))

    # Infinite ends are bins of their own; the lowest and the highest finite value always part.
    infinite = F.lit(float("inf"))

    def number(inner: Column) -> Column:
        parted = F.when(F.col("x") < 0, 0).otherwise(BINS - 1)
        return F.when(F.col("x") == -infinite, -1).when(F.col("x") == infinite, BINS).when(F.col("x") == F.col("lo"), 0).when(
            F.col("x") == F.col("hi"), BINS - 1).when((F.col("lo") == -infinite) | (F.col("hi") == infinite), parted).otherwise(inner).cast("int")

    # Equal widths first; every other round bins magnitudes, so a few rounds do whatever the values are.
    ways = cycle([number(step(*map(F.col, ("x", "lo", "hi")))), number(step(*map(scale, ("x", "lo", "hi"))))])
    while (state.where("lo < hi").agg(F.max("inside")).first()[0] or 0) > inside_limit:
        open_ = state.where("lo < hi")
        counted = inside(open_).withColumn("bin", next(ways)).groupBy(*bracket, "bin").agg(
            F.count(F.lit(1)).alias("c"), F.min("x").alias("least"), F.max("x").alias("most"))
        narrowed = at_rank(counted, open_, "bin").select(
            *[f"s.{c}" for c in (*keys, "slot", "upper", "n", "pos", "k")], F.col("least").alias("lo"), F.col("most").alias("hi"),
            F.col("before").alias("below"), F.col("c.c").alias("inside"))
        state = checkpointed(state.where("lo = hi").unionByName(narrowed))

    # Few values are left: count each, add up in order, read off the rank.
    rest = state.where("lo < hi")
    cells = inside(rest).groupBy(*bracket, "x").agg(F.count(F.lit(1)).alias("c"))
    picked = at_rank(cells, rest, "x").select(*[f"s.{c}" for c in (*keys, "slot", "upper", "n", "pos", "k")], F.col("c.x").alias("x"))
    values = picked.unionByName(state.where("lo = hi").select(*picked.columns[:-1], F.col("lo").alias("x")))
    per_slot = values.groupBy(*keys, "slot", "n", "pos").agg(
        F.max(F.when(~F.col("upper"), F.col("x"))).alias("x1"), F.max(F.when(F.col("upper"), F.col("x"))).alias("x2"),
        F.min("k").alias("k1"))
    quantile = F.col("x1") + F.when(F.col("x1") == F.col("x2"), 0.0).otherwise(
        (F.col("x2") - F.col("x1")) * (F.col("pos") - F.col("k1"))
    )
    return per_slot.select(*keys, "n", "slot", quantile.alias("v")).groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"]).alias("q"))

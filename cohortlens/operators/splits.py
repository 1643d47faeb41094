"""Reproducible train/test splits and folds by hash order.

Rows of a class are ordered by ``md5(seed:id)``; a split or fold is a range of
that order.  The range ends are found exactly, from a histogram of hash prefixes
and a ranking inside the few prefixes that hold an end.  After that a table only
compares each row's hash with the ends of its class, which are literals by then:
no join, no shuffle, and no task ranks a whole class.

Rows with one id share a hash, and so a side: sizes are exact when ids are unique, and else go beyond by
the rows that share the last id.  NULL ids count as one id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PREFIX = 4


def row_hash(id_col: str, seed: int = 42) -> Column:
    """Hash that orders the rows; all NULL ids share the one of the empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def hash_cuts(df: DataFrame, stratum: Column, id_col: str, ranks: list[Column], seed: int = 42) -> dict[object, list[str]]:
    """Class -> the hash at each rank; ranks are expressions over the class size ``n``.

    A rank below 1 gives the empty text, which every hash lies beyond.  A class and
    a rank give one hash, so a handful of rows reach the driver.
    """
    hashed = df.select(stratum.alias("stratum"), row_hash(id_col, seed).alias("h")).where(
        F.col("stratum").isNotNull()
    ).withColumn("prefix", F.substring("h", 1, PREFIX))
    per_prefix = hashed.groupBy("stratum", "prefix").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("stratum")
    upto = whole.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    # At most 16 ** PREFIX rows per class, whatever the table size.
    cumulated = per_prefix.select(
        "stratum", "prefix", "c", F.sum("c").over(upto).alias("cum"), F.sum("c").over(whole).alias("n")
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("slot"), r.cast("bigint").alias("rank")) for i, r in enumerate(ranks)
    ])
    ends = cumulated.select("*", F.inline(wanted)).where(
        "(rank > cum - c AND rank <= cum) OR (rank < 1 AND cum = c)"
    ).select("stratum", "slot", "prefix", (F.col("rank") - (F.col("cum") - F.col("c"))).alias("need")).collect()
    cuts: dict[object, list[str]] = {e["stratum"]: [""] * len(ranks) for e in ends}
    needed = {(e["stratum"], e["prefix"]) for e in ends if e["need"] >= 1}
    if not needed:
        return cuts
    cell = F.struct(F.col("stratum"), F.col("prefix"))
    near = cell.isin([F.struct(F.lit(s), F.lit(p)) for s, p in sorted(needed)])
    inside = Window.partitionBy("stratum", "prefix").orderBy("h")
    ranked = hashed.where(near).select("stratum", "prefix", "h", F.row_number().over(inside).alias("rn"))
    at = F.struct("stratum", "prefix", "rn").isin([
        F.struct(F.lit(e["stratum"]), F.lit(e["prefix"]), F.lit(e["need"]).cast("int")) for e in ends if e["need"] >= 1
    ])
    hashes = {(r["stratum"], r["prefix"], r["rn"]): r["h"] for r in ranked.where(at).collect()}
    for e in ends:
        if e["need"] >= 1:
            cuts[e["stratum"]][e["slot"]] = hashes[(e["stratum"], e["prefix"], e["need"])]
    return cuts


def _part(stratum: Column, id_col: str, cuts: dict[object, list[str]], seed: int) -> Column:
    """How many of its class's ends a row's hash lies beyond; NULL without a class."""
    digest = row_hash(id_col, seed)
    if not cuts:
        return F.lit(None).cast("int")
    slots = range(max(len(ends) for ends in cuts.values()))

    def end(slot: int) -> Column:
        found = F.lit(None).cast("string")
        for value, ends in cuts.items():
            found = F.when(stratum == value, F.lit(ends[slot])).otherwise(found)
        return found

    # Every term has the digest in plain sight, so it is computed once per row.
    return reduce(lambda a, b: a + b, [(digest > end(slot)).cast("int") for slot in slots])


def stratified_split(df: DataFrame, y: str, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add boolean ``is_test``: exactly ``round(share * n)`` rows of each class; NULL without one."""
    cuts = hash_cuts(df, F.col(y), id_col, [F.round(F.col("n") * F.lit(test_share))], seed)
    return df.withColumn("is_test", _part(F.col(y), id_col, cuts, seed) == 0)


def random_split(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add boolean ``is_test``: exactly ``ceil(share * n)`` rows, no classes."""
    cuts = hash_cuts(df, F.lit(0), id_col, [F.ceil(F.col("n") * F.lit(test_share))], seed)
    return df.withColumn("is_test", _part(F.lit(0), id_col, cuts, seed) == 0)


def stratified_folds(df: DataFrame, y: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1: folds of each class differ by one row at most; NULL without one."""
    share, extra = F.floor(F.col("n") / k), F.col("n") % k
    ranks = [share * i + F.least(extra, F.lit(i)) for i in range(1, k)]
    cuts = hash_cuts(df, F.col(y), id_col, ranks, seed)
    return df.withColumn("fold", _part(F.col(y), id_col, cuts, seed))

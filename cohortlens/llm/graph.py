"""Connected components of a large link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import checkpointed


def _largest_to_smallest(links: DataFrame, both: bool) -> DataFrame:
    """Point neighbours at the smallest node seen from a node (``both``: only its larger neighbours, from either side)."""
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = seen.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = seen.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if both else (
        seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b"))))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component is named by its smallest node.

    ``links`` has long columns a, b in either order; null ends are left out.  Alternating star
    rounds (larger neighbours of a node move to its smallest one, then smaller ones do) need a
    number of rounds that grows with the logarithm of the longest chain.  Sums run on joins and
    partial aggregates, so a node with very many links is split like any skewed join key.  Every
    round is a checkpoint in the shared folder; no link reaches the driver.
    """
    current = checkpointed(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    state = None
    while True:
        found = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found[0] == 0 or found == state:
            break
        state = found
        current = checkpointed(_largest_to_smallest(_largest_to_smallest(current, True), False))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

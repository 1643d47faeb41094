"""Match names against alias lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.text import normalize_key
from cohortlens.functions.vocabulary import EXACT_ONLY_ALIASES, ROLE_ALIASES


#: Aliases up to which the list travels inside the expression; a longer one is joined.
INLINE = 1000
#: Letters that a name and an alias have to share before they are compared.
GRAM = 4


def _score() -> Column:
    """How well the name key ``k`` fits the alias ``key``; NULL if not."""
    size, other = F.length("key"), F.length("k")
    near = F.abs(size - other) <= F.greatest(size, other) * 0.6
    overlap = F.col("k").contains(F.col("key")) | F.col("key").contains(F.col("k"))
    partial = (size >= 5) & ~F.col("exact") & (other >= 4) & overlap & near
    return F.when(F.col("k") == F.col("key"), F.lit(1_000_000) - F.col("ord")).when(partial, F.least(size, other))


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """The rows once for each different run of ``GRAM`` letters in their key."""
    cut = F.transform(F.sequence(F.lit(1), F.length(key) - (GRAM - 1)), lambda i: F.substring(F.col(key), i, F.lit(GRAM)))
    return rows.where(F.length(key) >= GRAM).select("*", F.explode(F.array_distinct(cut)).alias("gram"))


def _meetings(inner: DataFrame, inner_key: str, outer: DataFrame, outer_key: str) -> DataFrame:
    """Pairs whose inner key may lie in the outer one: they share the inner key's rarest run of letters among the outer keys.

    An inner key with a run that no outer key has meets nothing.
    """
    filed = _grams(outer, outer_key)
    often = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    cut = _grams(inner, inner_key).join(often, "gram", "left").fillna({"often": 0})
    rarest = cut.groupBy(*inner.columns).agg(F.min(F.struct("often", "gram")).alias("r")).where("r.often > 0").select(*inner.columns, F.col("r.gram").alias("gram"))
    return rarest.join(filed, "gram").drop("gram")


def alias_match(
    names: DataFrame,
    name_col: str,
    aliases: dict[str, list[str]] | DataFrame | None = None,
    exact_only: list[str] | None = None,
    inline: int = INLINE,
) -> DataFrame:
    """(role, name, score): the best matching name of each role.

    An equal key wins, by alias order.  Otherwise one key must contain the other;
    the alias needs five characters, the name four, and lengths may differ by
    60 %; the longest overlap wins, then the smallest name.

    A short alias list travels inside the expression, so each name is tested where it is read and only hits
    leave the scan.  A longer one, or a table (role, ord, alias), is joined: equal keys directly, and for
    containment both sides by an index of their runs of letters.  The best hit per role is a plain minimum.
    """
    aliases = ROLE_ALIASES if aliases is None else aliases
    exact_only = EXACT_ONLY_ALIASES if exact_only is None else exact_only
    spark = names.sparkSession
    keyed = names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn(
        "k", normalize_key(F.col("name"))
    )
    if isinstance(aliases, dict) and sum(map(len, aliases.values())) <= inline:
        entries = F.array(*[
            F.struct(F.lit(role).alias("role"), F.lit(i).alias("ord"), normalize_key(F.lit(a)).alias("key"), normalize_key(F.lit(a)).isin(exact_only).alias("exact"))
            for role, listed in aliases.items() for i, a in enumerate(listed)
        ])
        pairs = keyed.select("name", "k", F.inline(entries))
    else:
        if isinstance(aliases, dict):
            rows = [(role, i, a) for role, listed in aliases.items() for i, a in enumerate(listed)]
            aliases = spark.createDataFrame(rows, "role string, ord int, alias string")
        listed = aliases.where("alias IS NOT NULL").select("role", "ord", normalize_key(F.col("alias")).alias("key")).distinct()
        listed = listed.withColumn("exact", F.col("key").isin(exact_only))
        open_ = listed.where((F.length("key") >= 5) & ~F.col("exact"))
        columns = ["name", "k", "role", "ord", "key", "exact"]
        pairs = keyed.join(listed, keyed["k"] == listed["key"]).select(columns).unionByName(
            _meetings(open_, "key", keyed, "k").select(columns)).unionByName(_meetings(keyed, "k", open_, "key").select(columns))
    hits = pairs.select("role", "name", _score().alias("score")).where("score IS NOT NULL")
    best = hits.groupBy("role").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.select("role", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))


def guess_roles(df: DataFrame) -> dict[str, str]:
    """Role -> column, from the header alone (a few dozen names)."""
    header = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    return {row["role"]: row["name"] for row in alias_match(header, "name").collect()}


def junk_columns(df: DataFrame) -> list[str]:
    """Columns whose name says that they carry no information."""
    header = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    aliases = {a: [a] for a in ROLE_ALIASES["junk"]}
    return sorted({row["name"] for row in alias_match(header, "name", aliases).collect()})

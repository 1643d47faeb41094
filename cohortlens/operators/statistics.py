"""Descriptive statistics, correlation and the data behind charts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import is_infinite, numeric_columns, to_number
from cohortlens.operators.outcome import percent
from cohortlens.operators.quantiles import exact_quantiles

#: Rows whose products are taken at once, tasks that merge the sums of all others, and pairs of a result batch.
ROWS_AT_ONCE, MERGERS, PAIRS_AT_ONCE = 4096, 64, 10_000


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    columns = columns or numeric_columns(df)
    values = {c: to_number(df, c) for c in columns}
    facts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(v).alias(f"{name}{i}") for i, v in enumerate(values.values()) for name, fn in facts.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}{i}").alias(name) for name in facts])
        for i, c in enumerate(columns)
    ])
    quartiles = exact_quantiles(df, values, [0.25, 0.5, 0.75]).select(F.col("measure").alias("column"), "q")
    return wide.select(F.inline(rows)).join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), "max",
    )


def _chosen(df: DataFrame, columns: list[str] | None, event: str | None) -> list[str]:
    return [c for c in (columns or numeric_columns(df)) if c != event] + ([event] if event else [])


class PairSums:
    """Sums over the rows where both columns of a pair are present, for all pairs of ``width`` columns at once.

    ``n``, means, and sums of centred squares and products are (column, column) tables: entry (i, j) is about
    column i where j is present too.  ``size`` is what the squares added up to before centring, and ``lost``
    counts infinite values.  Tables of different rows merge exactly, so they can be added up in any tree.
    """

    FIELDS = ("n", "mean", "square", "product", "size", "lost")

    def __init__(self, width: int, tables: dict[str, np.ndarray] | None = None):
        self.width = width
        self.tables = tables or {f: np.zeros((width, width)) for f in self.FIELDS}

    @classmethod
    def of(cls, x: np.ndarray) -> "PairSums":
        """From rows of numbers, NaN where missing."""
        present = ~np.isnan(x)
        infinite = np.isinf(x)
        finite = np.where(present & ~infinite, x, 0.0)
        shift = finite.sum(axis=0) / np.maximum((present & ~infinite).sum(axis=0), 1)
        centred = np.where(present & ~infinite, x - shift, 0.0)
        mask = present.astype(float)
        n = mask.T @ mask
        some = np.maximum(n, 1.0)
        sums, squares = centred.T @ mask, (centred * centred).T @ mask
        tables = {"n": n, "mean": sums / some + shift[:, None], "square": squares - sums * sums / some,
                  "product": centred.T @ centred - sums * sums.T / some, "size": squares, "lost": infinite.astype(float).T @ mask}
        return cls(x.shape[1], tables)

    def merge(self, other: "PairSums") -> None:
        a, b = self.tables, other.tables
        n = a["n"] + b["n"]
        gap = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
        share = b["n"] / np.maximum(n, 1.0)
        weight = a["n"] * share
        a["square"] += b["square"] + weight * gap * gap
        a["product"] += b["product"] + weight * gap * gap.T
        a["mean"] = np.where(a["n"] > 0, a["mean"] + share * gap, b["mean"])
        a["size"] += b["size"] + weight * gap * gap
        a["lost"] += b["lost"]
        a["n"] = n

    def pack(self) -> bytes:
        return np.stack([self.tables[f] for f in self.FIELDS]).tobytes()

    @classmethod
    def unpack(cls, width: int, data: bytes) -> "PairSums":
        return cls(width, dict(zip(cls.FIELDS, np.frombuffer(data).reshape(len(cls.FIELDS), width, width).copy(), strict=True)))

    def correlations(self) -> np.ndarray:
        """Pearson's r of each pair; NaN where a side is constant or infinite."""
        spread = np.maximum(self.tables["square"], 0.0)
        # A side that is constant over the shared rows leaves nothing but rounding noise.
        spread = np.where((spread > self.tables["size"] * 1e-12) & (self.tables["lost"] == 0), spread, np.nan)
        with np.errstate(invalid="ignore"):
            return self.tables["product"] / (np.sqrt(spread) * np.sqrt(spread.T))


def pair_sums(df: DataFrame, values: list[Column]) -> DataFrame:
    """One row (sums): the packed ``PairSums`` of all rows, from one scan.

    Every task adds up its batches and sends one table; ``MERGERS`` tasks merge those, and one merges what they made,
    so no task holds more than two tables.
    """
    width = len(values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = PairSums(width)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                total.merge(PairSums.of(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])))
        yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = PairSums(width)
        for batch in batches:
            for item in batch.column(0):
                total.merge(PairSums.unpack(width, item.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([total.pack()], pa.binary())], names=["sums"])

    own = df.select(*[F.coalesce(v, F.lit(float("nan"))).alias(f"x{i}") for i, v in enumerate(values)]).mapInArrow(add, "sums binary")
    return own.repartition(MERGERS).mapInArrow(merge, "sums binary").repartition(1).mapInArrow(merge, "sums binary")


def correlation_pairs(
    df: DataFrame, columns: list[str] | None = None, event: str | None = None, pairs_per_pass: int = PAIRS_AT_ONCE
) -> DataFrame:
    """(a, b, r, n) for each pair of number columns, in table order, from one scan of the table.

    Pearson over rows where both sides are present; NULL for a constant or infinite side.  ``event`` adds a
    0/1 column.  Pairs leave the last task ``pairs_per_pass`` at a time.
    """
    chosen = _chosen(df, columns, event)
    width = len(chosen)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0):
                total = PairSums.unpack(width, item.as_py())
                i, j = np.triu_indices(width, 1)
                r, n = total.correlations()[i, j], total.tables["n"][i, j].astype(np.int64)
                for low in range(0, len(i), pairs_per_pass):
                    at = slice(low, low + pairs_per_pass)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chosen[k] for k in i[at]], pa.string()), pa.array([chosen[k] for k in j[at]], pa.string()),
                        pa.array(r[at], pa.float64(), mask=np.isnan(r[at])), pa.array(n[at])], names=["a", "b", "r", "n"])

    return pair_sums(df, [to_number(df, c) for c in chosen]).mapInArrow(pairs, "a string, b string, r double, n bigint")


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, event: str | None = None) -> DataFrame:
    """(a, b, r): both triangles and the diagonal (NULL for a constant column)."""
    pairs = correlation_pairs(df, columns, event).select("a", "b", "r")
    values = {c: to_number(df, c) for c in _chosen(df, columns, event)}
    ends = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values.values()) for n, f in (("lo", F.min), ("hi", F.max))])
    diagonal = ends.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), 1.0).alias("r"))
        for i, c in enumerate(values)
    ])))
    both = pairs.select(F.inline(F.array(F.struct("a", "b", "r"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r"))))
    return both.unionByName(diagonal)


def strong_pairs(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, r, abs_r) at or above the threshold, strongest first."""
    return pairs.where(F.abs("r") >= threshold).select("a", "b", "r", F.abs("r").alias("abs_r")).orderBy(
        F.desc("abs_r"), "a", "b"
    )


def correlation_insights(pairs: DataFrame, threshold: float = 0.5, top: int = 10) -> DataFrame:
    """(a, b, r, direction, text) for the strongest pairs."""
    direction = F.when(F.col("r") > 0, "thuận").otherwise("nghịch")
    text = F.format_string("`%s` liên hệ %s với `%s` (r = %.3f)", F.col("a"), direction, F.col("b"), F.col("r"))
    return strong_pairs(pairs, threshold).limit(top).select("a", "b", "r", direction.alias("direction"), text.alias("text"))


def analyze_correlation(df: DataFrame, event: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Every pair with its strength flag and direction, in one table."""
    return correlation_pairs(df, event=event).select(
        "a", "b", "r", F.coalesce(F.abs("r") >= threshold, F.lit(False)).alias("is_strong"),
        F.when(F.col("r") > 0, "thuận").when(F.col("r") < 0, "nghịch").alias("direction"),
    )


def topk_categories(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """(value, n, pct) of the ``k`` most frequent values; pct is of all rows."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.where("value IS NOT NULL").select("value", "n", percent(F.col("n"), whole).alias("pct")).orderBy(
        F.desc("n"), "value"
    ).limit(k)


def topk_rows(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """Rows whose category is one of the ``k`` most frequent ones."""
    keep = topk_categories(df, column, k).select(F.col("value").alias(column))
    return df.join(F.broadcast(keep), column, "left_semi")


def histogram(df: DataFrame, column: str, bins: int = 18) -> DataFrame:
    """(bin, low, high, n, mean, min, max) of equal-width bins; empty bins left out."""
    value = to_number(df, column)
    numbers = df.select(value.alias("x")).where(F.col("x").isNotNull() & ~is_infinite(F.col("x")))
    facts = numbers.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))).scalar()
    width = (facts["hi"] - facts["lo"]) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(F.col("x") - facts["lo"], width)), F.lit(bins - 1)))
    return numbers.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (facts["lo"] + F.col("bin") * width).alias("low"), (facts["lo"] + (F.col("bin") + 1) * width).alias("high"),
        "n", facts["mean"].alias("mean"), facts["lo"].alias("min"), facts["hi"].alias("max"),
    )


def box_stats(df: DataFrame, label: str, measure: str) -> DataFrame:
    """(label, n, q1, median, q3, whisker_low, whisker_high, n_outliers) per label."""
    rows = df.where(F.col(label).isNotNull())
    value = to_number(df, measure)
    boxes = exact_quantiles(rows, {measure: value}, [0.25, 0.5, 0.75], by=label).select(
        F.col("grp").alias("label"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    step = 1.5 * (F.col("q3") - F.col("q1"))
    # A plain join: its size at run time decides whether the fences are broadcast, and a label with most rows is split.
    fences = boxes.select("label", (F.col("q1") - step).alias("lo"), (F.col("q3") + step).alias("hi"))
    inside = F.col("x").between(F.col("lo"), F.col("hi"))
    whiskers = rows.select(F.col(label).alias("label"), value.alias("x")).where("x IS NOT NULL").join(fences, "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"),
    )
    return whiskers.join(boxes, "label").select(
        "label", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers"
    )


def top_variance_columns(df: DataFrame, limit: int = 14, keep: int = 13, always: str | None = None) -> DataFrame:
    """(column, variance) of the columns a heat map should show.

    Up to ``limit`` columns all stay; beyond, the ``keep`` most spread ones and ``always``.
    """
    columns = numeric_columns(df)
    wide = df.agg(*[F.var_samp(to_number(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    listed = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)
    ])))
    if len(columns) <= limit:
        return listed
    kept = listed.orderBy(F.desc_nulls_last("variance"), "column").limit(keep)
    return kept.unionByName(listed.where(F.col("column") == always).join(kept, "column", "left_anti")) if always else kept


def event_split(df: DataFrame) -> DataFrame:
    """(event, n, pct): both sides of the outcome."""
    counts = df.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.select("event", "n", percent(F.col("n"), whole).alias("pct"))

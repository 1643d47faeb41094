"""Row filters, search, paging and previews."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.text import quoted
from cohortlens.operators.profile import unpivot_cells

ALL_VALUES = ["All", "Tất cả"]
#: Rows of one key range of ``page``, and rows up to whose number a page is the end of a top-k.
RANGE_ROWS, TOP_ROWS = 1_000_000, 10_000


def _typed(df: DataFrame, name: str, value: object) -> Column | None:
    """Literal of the column's own type, so that the test reaches the scan."""
    kind = df.schema[name].dataType
    text = str(value)
    try:
        if isinstance(kind, T.BooleanType):
            return F.lit({"true": True, "false": False}[text.strip().lower()])
        if isinstance(kind, (T.IntegralType, T.DecimalType)):
            number = Decimal(text.strip())
            if not number.is_finite() or isinstance(kind, T.IntegralType) and number != int(number):
                return None
            if isinstance(kind, T.IntegralType):
                return F.lit(int(number)) if abs(number) < 1 << 63 else None
            return F.lit(number) if len(number.as_tuple().digits) <= 38 else None
        if isinstance(kind, T.NumericType):
            return F.lit(float(text))
    except (ValueError, KeyError, OverflowError, InvalidOperation):
        return None
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.lit(text).try_cast(kind)
    return F.lit(text)


def _condition(df: DataFrame, name: str, selected: object) -> Column | None:
    if name not in df.columns or selected is None:
        return None
    if isinstance(selected, (list, tuple, set)):
        if not selected:
            return None
        values = [v for v in (_typed(df, name, s) for s in sorted(selected, key=str)) if v is not None]
        return F.col(quoted(name)).isin(values) if values else F.lit(False)
    if not str(selected).strip() or str(selected) in ALL_VALUES:
        return None
    value = _typed(df, name, selected)
    return F.lit(False) if value is None else F.col(quoted(name)) == value


def apply_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Keep rows equal to each given value, or inside each given list.

    Unknown columns, ``None``, blanks, "All" and empty lists do not filter;
    NULL never matches.
    """
    conditions = [c for c in (_condition(df, n, s) for n, s in filters.items()) if c is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def filter_domain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-null values per filter column."""
    return unpivot_cells(df, columns).where(F.col("value").isNotNull()).distinct().orderBy("column", "value")


def search_any(df: DataFrame, query: str, literal: bool = False) -> DataFrame:
    """Rows where any column contains the query: a pattern, or plain text."""
    needle = query.strip().lower()
    if not needle:
        return df
    texts = [F.lower(F.col(quoted(c)).cast("string")) for c in df.columns]
    hits = [t.contains(needle) if literal else t.rlike(needle) for t in texts]
    return df.where(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]),
                               F.lit(False)))


def preview(df: DataFrame, order: str | list[str], n: int = 15) -> DataFrame:
    """First rows of an explicit order (a table has none of its own)."""
    keys = [order] if isinstance(order, str) else order
    return df.orderBy(*keys).limit(n)


@dataclass(frozen=True)
class PageIndex:
    """Rows without a key, and (rows, last key) of each range of keys in order; a row for every ``range_rows`` rows."""

    nulls: int
    ranges: list[tuple[int, object]]


def page_index(df: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> PageIndex:
    """The index that all later pages of an unchanged table can share.

    One shuffle of the key column alone sorts it in parts of about ``RANGE_ROWS`` keys, however short the ranges are;
    each part is cut into ranges in place, and their counts and ends are all that leaves it.
    """
    keys = df.select(F.col(quoted(key)).alias("k"))
    rows, nulls = keys.agg(F.count(F.lit(1)), F.count_if(F.col("k").isNull())).first()
    parts = max(1, -(-rows // max(range_rows, RANGE_ROWS)))
    # Equal keys meet in one part, where they are one row, so no range ends among them.
    sorted_ = keys.where(F.col("k").isNotNull()).repartitionByRange(parts, "k").groupBy("k").agg(
        F.count(F.lit(1)).alias("c")).sortWithinPartitions("k").select("k", "c", F.monotonically_increasing_id().alias("at"))
    place = F.col("at").bitwiseAND((1 << 33) - 1)
    placed = sorted_.groupBy((F.col("at") - place).alias("part"), F.floor(place / range_rows).alias("range")).agg(
        F.sum("c").alias("n"), F.max("k").alias("last"))
    return PageIndex(nulls, [(r["n"], r["last"]) for r in placed.orderBy("last").collect()])


def page(df: DataFrame, key: str, number: int, size: int = 25, range_rows: int = RANGE_ROWS, index: PageIndex | None = None) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows by a unique key of any orderable type, NULL keys first.

    The first pages, up to ``TOP_ROWS`` rows, are the end of a top-k: every task keeps so many rows at most and
    no column is shuffled.  A later page is cut from the key ranges it lies in (see ``page_index``; give ``index``
    to share one), which the scan filters by their literal ends; no task sorts more than the rows of those
    ranges (about ``range_rows`` each).
    """
    first, k = number * size, F.col(quoted(key))
    if index is None and first + size <= min(TOP_ROWS, range_rows):
        return df.orderBy(k.asc_nulls_first()).offset(first).limit(size)
    index = page_index(df, key, range_rows) if index is None else index
    before, wanted, lower, nulls = index.nulls, [], None, index.nulls
    for n, last in index.ranges:
        if before < first + size and before + n > first:
            wanted.append((before, lower, last))
        before, lower = before + n, last
    inside = F.lit(False) if first >= nulls else k.isNull()
    start = 0 if first < nulls else first
    if wanted:
        start = 0 if first < nulls else wanted[0][0]
        low = F.lit(True) if wanted[0][1] is None else k > F.lit(wanted[0][1])
        inside = inside | (low & (k <= F.lit(wanted[-1][2])))
    return df.where(inside).orderBy(k.asc_nulls_first()).offset(first - start).limit(size)


def band_filter(scored: DataFrame, band: str = "All") -> DataFrame:
    return scored if band in ALL_VALUES else scored.where(F.col("risk_band") == band)


def valid_target_rows(df: DataFrame, value: Column) -> DataFrame:
    """Rows whose regression target is a number."""
    return df.where(value.isNotNull())


def support_filter(groups: DataFrame, min_total: int = 20) -> DataFrame:
    """Groups of at least ``min_total`` rows, or all groups if none is that large."""
    largest = groups.agg(F.max("total")).scalar()
    return groups.where((F.col("total") >= min_total) | (largest < min_total))

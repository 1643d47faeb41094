"""Cleaning that trims, drops exact copies and turns infinities into NULL."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import is_infinite, is_text, numeric_columns, text_columns, to_number
from cohortlens.functions.text import quoted, strip_blanks
from cohortlens.operators.profile import LONG_TEXT, by_name, unpivot_cells
from cohortlens.operators.quality import duplicate_summary, iqr_outliers
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.session import checkpointed


def _floating_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[strip_blanks(F.col(quoted(c))).alias(c) if is_text(df, c) else F.col(quoted(c)) for c in df.columns])


def inf_to_null(df: DataFrame) -> DataFrame:
    floats = _floating_columns(df)
    return df.select(*[
        F.when(~is_infinite(F.col(quoted(c))), F.col(quoted(c))).alias(c) if c in floats else F.col(quoted(c)) for c in df.columns
    ])


def inf_counts(df: DataFrame) -> DataFrame:
    """(column, inf_count) for number columns that hold infinities."""
    floats = _floating_columns(df)
    if not floats:
        return df.sparkSession.createDataFrame([], "column string, inf_count bigint")
    wide = df.agg(*[F.count_if(is_infinite(F.col(quoted(c)))).alias(f"i{i}") for i, c in enumerate(floats)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"i{i}").alias("inf_count")) for i, c in enumerate(floats)])
    return wide.select(F.inline(rows)).where("inf_count > 0")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keys = {f"_map{i}": F.to_json(F.array_sort(F.map_entries(F.col(quoted(c))))) for i, c in enumerate(maps)}
    plain = [c for c in df.columns if c not in maps]
    return df.withColumns(keys).dropDuplicates([*plain, *keys]).drop(*keys)


def clean_dataset(df: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Trim, drop copies, turn infinities into NULL; never impute, never drop outliers."""
    trimmed = trim_strings(df)
    return inf_to_null(drop_duplicate_rows(trimmed) if drop_duplicates else trimmed)


def _missing_cells(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.count_if(F.col(quoted(c)).isNull()) for c in df.columns])


def clean_report(df: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """One row: sizes before and after cleaning, and what was done.

    Outliers and infinities are looked at after the copies are gone and before
    infinities become NULL.  The rows without copies are kept while the report is
    made, so they are found once.
    """
    trimmed = trim_strings(df)
    kept = (drop_duplicate_rows(trimmed) if drop_duplicates else trimmed).persist(StorageLevel.MEMORY_AND_DISK)
    floats = _floating_columns(df)
    before = df.agg(F.struct(F.count(F.lit(1)).alias("rows"), _missing_cells(df).alias("missing"))).scalar()
    copies = duplicate_summary(df).select("duplicate_count").scalar()
    infinite = reduce(lambda a, b: a + b, [F.count_if(is_infinite(F.col(quoted(c)))) for c in floats] or [F.lit(0)])
    after = kept.agg(
        F.count(F.lit(1)).alias("rows_after"), _missing_cells(kept).alias("_missing"), infinite.cast("bigint").alias("inf_replaced"),
    )
    outliers = iqr_outliers(kept).agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("n")).scalar()
    # Rows without copies can fall together again where an infinity became NULL.
    again = duplicate_summary(inf_to_null(kept)).select("duplicate_count").scalar()
    dropped = before["rows"] - F.col("rows_after") if drop_duplicates else duplicate_summary(kept).select("duplicate_count").scalar()
    actions = F.array_compact(F.array(
        F.lit(f"trimmed {len(text_columns(df))} text columns"),
        F.when(F.col("_missing") > 0, F.concat(F.lit("kept "), F.col("_missing").cast("string"), F.lit(" missing values")))
        .otherwise("no missing values"),
        F.when(dropped == 0, "no duplicate rows")
        .otherwise(F.concat(F.lit("removed " if drop_duplicates else "kept "), dropped.cast("string"), F.lit(" duplicate rows"))),
        F.concat(F.lit("kept "), outliers.cast("string"), F.lit(" IQR outliers")),
        F.when(F.col("inf_replaced") > 0, F.concat(F.lit("set "), F.col("inf_replaced").cast("string"), F.lit(" infinities to NULL"))),
    ))
    n_cols = F.lit(len(df.columns))
    report = after.select(
        before["rows"].alias("rows_before"), n_cols.alias("cols_before"), before["missing"].alias("missing_before"),
        copies.alias("duplicates_before"), "rows_after", n_cols.alias("cols_after"),
        (F.col("_missing") + F.col("inf_replaced")).alias("missing_after"), again.alias("duplicates_after"),
        "inf_replaced", F.array_join(actions, "; ").alias("actions"),
    )
    try:
        return checkpointed(report)
    finally:
        kept.unpersist()


def most_frequent(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, text): the most frequent value, the smallest of several.

    Long texts are counted by their first ``LONG_TEXT`` letters and a digest.  Only where such a text wins, the texts
    that begin like it are counted whole, in a second pass.
    """
    text, long = F.col("value"), F.length("value") > LONG_TEXT
    key = F.when(long, F.concat(F.substring(text, 1, LONG_TEXT), F.sha2(text, 256))).otherwise(text)

    def best(cells: DataFrame, value: Column) -> list:
        counts = cells.groupBy("column", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top")).collect()  # one for each column

    cells = unpivot_cells(df, columns).where("value IS NOT NULL")
    found = {r["column"]: r["top"]["value"] for r in best(cells, key)}
    begins = {c: v[:LONG_TEXT] for c, v in found.items() if len(v) > LONG_TEXT}
    if begins:
        near = unpivot_cells(df, list(begins)).where(long & (F.substring(text, 1, LONG_TEXT) == by_name(begins)))
        found |= {r["column"]: r["top"]["value"] for r in best(near, text)}
    return df.sparkSession.createDataFrame(list(found.items()), "column string, text string")


def column_defaults(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, number, text): median of number columns, most frequent text otherwise.

    The mode comes from counts per (column, value), smallest value on a tie.
    """
    columns = columns or df.columns
    numbers = [c for c in columns if c in numeric_columns(df)]
    others = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        medians = exact_quantiles(df, {c: to_number(df, c) for c in numbers}, [0.5])
        parts.append(medians.select(F.col("measure").alias("column"), F.col("q")[0].alias("number"),
                                    F.lit(None).cast("string").alias("text")))
    if others:
        parts.append(most_frequent(df, others).select("column", F.lit(None).cast("double").alias("number"), "text"))
    return reduce(DataFrame.unionByName, parts)


def default_fill(df: DataFrame, columns: list[str], source: DataFrame | None = None) -> DataFrame:
    """Fill missing cells of ``columns`` with the defaults of ``source``."""
    defaults = column_defaults(df if source is None else source, columns)
    packed = defaults.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("number", "text")))).alias("d")).scalar()
    numbers = numeric_columns(df)
    filled = {
        c: F.coalesce(F.col(quoted(c)).cast("double") if c in numbers else F.col(quoted(c)),
                      packed[c]["number"] if c in numbers else packed[c]["text"])
        for c in columns
    }
    return df.select(*[filled[c].alias(c) if c in filled else F.col(quoted(c)) for c in df.columns])

"""Numeric expressions that stay inside generated code and never raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.text import quoted

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_TEXT = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(column_type(df, name), (T.NumericType, T.BooleanType))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(column_type(df, name), (T.StringType, T.CharType, T.VarcharType))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a number type, in table order (booleans are not numbers here)."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(df, f.name)]


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_TEXT) | text.rlike(INFINITY_TEXT)


def text_to_number(text: Column) -> Column:
    """Text to double; whatever is not a plain decimal number becomes NULL."""
    return F.when(looks_numeric(text), F.trim(text).try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """Column as double: numbers cast, text parsed, NaN and junk become NULL."""
    if is_numeric(df, name):
        value = F.col(quoted(name)).cast("double")
        return F.nullif(value, F.lit(float("nan"))) if _floating(df, name) else value
    if is_text(df, name):
        return text_to_number(F.col(quoted(name)))
    return F.lit(None).cast("double")


def _floating(df: DataFrame, name: str) -> bool:
    return isinstance(column_type(df, name), (T.FloatType, T.DoubleType))


def parse_number_text(text: Column) -> Column:
    """As ``text_to_number``, after dropping thousands commas."""
    return text_to_number(F.replace(text, F.lit(","), F.lit("")))


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with 0 for a zero denominator; a NULL operand stays NULL."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def is_infinite(value: Column) -> Column:
    return F.abs(value) == F.lit(float("inf"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value: turn it into NULL right after the scan."""
    return df.select(
        *[
            F.nullif(F.col(quoted(f.name)), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(quoted(f.name))
            for f in df.schema
        ]
    )

"""Text expressions: key folding and display formats."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Pairs of lower-case accented letters and their base letters."""
    accented, plain = ["đ"], ["d"]
    for code in [*range(0x00DF, 0x0250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != char and char == char.lower():
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_map()
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def normalize_key(text: Column) -> Column:
    """Name without case, accents, blanks and ``_ - . / ( ) [ ] { }``."""
    folded = F.translate(F.lower(strip_blanks(text)), ACCENTED, PLAIN)
    return F.regexp_replace(folded, r"[ _\-./()\[\]{}\p{Mn}]", "")


def half_even(value: Column, digits: int) -> Column:
    """Round ties to the even digit; Java formats alone would round them up."""
    return F.bround(value.cast("double"), digits)


def strip_blanks(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind, not just spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def sanitize_text(text: Column) -> Column:
    """CR LF and CR to LF, other control characters to a blank, NULL to empty."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return F.coalesce(F.regexp_replace(unix, r"[\x00-\x09\x0B-\x1F]", " "), F.lit(""))


def ellipsize(text: Column, width: int = 40) -> Column:
    """Text of ``width`` characters or more is cut and marked with dots."""
    cut = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) >= width, cut).otherwise(text)


def format_pct(value: Column, digits: int = 2) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f%%", half_even(value, digits))).otherwise("N/A")


def format_money(value: Column, unit: str = "USD") -> Column:
    """Whole amount with dots between thousands, such as ``1.234.567 USD``."""
    grouped = F.replace(F.format_number(half_even(value, 0), 0), F.lit(","), F.lit("."))
    return F.coalesce(F.concat(grouped, F.lit(f" {unit}")), F.lit("N/A"))


def signed_diff(value: Column, unit: str = "pp") -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%+.2f {unit}".rstrip(), half_even(value, 2)))


def format_metric(value: Column) -> Column:
    """1,234 from a thousand on, four decimals below one, two in between."""
    number = value.cast("double")
    return (
        F.when(number.isNull(), F.lit("—"))
        .when(F.abs(number) >= 1000, F.format_string("%,.0f", half_even(number, 0)))
        .when(number < 1, F.format_string("%,.4f", half_even(number, 4)))
        .otherwise(F.format_string("%,.2f", half_even(number, 2)))
    )


def file_size_text(n_bytes: Column) -> Column:
    """Byte count as B, KB, MB or GB."""
    size = n_bytes.cast("double")
    return (
        F.when(size.isNull(), F.lit("—"))
        .when(size < 1024, F.format_string("%d B", n_bytes.cast("bigint")))
        .when(size < 1024**2, F.format_string("%.1f KB", half_even(size / 1024, 1)))
        .when(size < 1024**3, F.format_string("%.1f MB", half_even(size / 1024**2, 1)))
        .otherwise(F.format_string("%.1f GB", half_even(size / 1024**3, 1)))
    )


def quoted(name: str) -> str:
    """A column name as Spark reads it whole, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"

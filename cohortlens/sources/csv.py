"""CSV scan with missing tokens, type inference and encoding fallback; CSV sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import looks_numeric, text_to_number
from cohortlens.functions.vocabulary import ENCODINGS, MISSING_TOKENS

# Java names of the encodings, and which need the wider charset list.
JAVA_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "cp1258": "windows-1258",
                 "cp1252": "windows-1252"}
LEGACY_CHARSETS = ["cp1258", "cp1252"]


def _charset(spark: SparkSession, encoding: str) -> str:
    if encoding in LEGACY_CHARSETS:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return JAVA_CHARSETS.get(encoding, encoding)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    encoding: str = "utf-8",
    nrows: int | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Header CSV to a typed table; tokens such as ``NA`` and ``null`` read as NULL.

    Give ``schema`` for large files: the scan is then a single lazy pass.  Without
    it, one aggregate over all rows decides between whole numbers, numbers,
    booleans and text.  ``multi_line`` allows line breaks inside quotes, at the
    price of files that cannot be split.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding=_charset(spark, encoding), escape='"',
                         multiLine=multi_line, enforceSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if nrows is not None:
        raw = raw.limit(nrows)
    text = raw.select(*[F.when(~F.col(c).isin(MISSING_TOKENS), F.col(c)).alias(c) for c in raw.columns])
    kinds = _given(schema) if schema is not None else _infer(text)
    return text.select(*[_typed(c, kinds.get(c, T.StringType())).alias(c) for c in text.columns])


def _given(schema: T.StructType | str) -> dict[str, T.DataType]:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return {f.name: f.dataType for f in schema}


def _infer(text: DataFrame) -> dict[str, T.DataType]:
    whole = r"^\s*[+-]?\d{1,18}\s*$"
    aggs = []
    for i, c in enumerate(text.columns):
        value = F.col(c)
        aggs += [F.count(value).alias(f"n{i}"), F.count_if(value.rlike(whole)).alias(f"w{i}"),
                 F.count_if(looks_numeric(value)).alias(f"d{i}"),
                 F.count_if(F.lower(value).isin("true", "false")).alias(f"b{i}")]
    row = text.agg(*aggs).first()
    kinds: dict[str, T.DataType] = {}
    for i, c in enumerate(text.columns):
        n = row[f"n{i}"]
        if n and row[f"w{i}"] == n:
            kinds[c] = T.LongType()
        elif n and row[f"d{i}"] == n:
            kinds[c] = T.DoubleType()
        elif n and row[f"b{i}"] == n:
            kinds[c] = T.BooleanType()
        else:
            kinds[c] = T.StringType()
    return kinds


def _typed(name: str, kind: T.DataType):
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return text_to_number(F.col(name)).cast(kind)
    return F.trim(F.col(name)).try_cast(kind)


def undecodable_bytes(name: str) -> list[int]:
    """Bytes that a one-byte encoding gives no character to."""
    def known(byte: int) -> bool:
        try:
            bytes([byte]).decode(name)
        except UnicodeDecodeError:
            return False
        return True
    return [b for b in range(256) if not known(b)]


def _undecoded(latin: Column, name: str) -> Column:
    """Does a line not decode?  ``latin`` has a character for each of its bytes.

    UTF-8 is judged by the bytes, since U+FFFD may be in a sound file; other encodings have to be one-byte ones.
    """
    if name.lower().startswith("utf-8"):
        return ~F.is_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    missing = undecodable_bytes(name)
    if len(missing) > 128:
        raise ValueError(f"{name} is no one-byte encoding")
    return latin.rlike("[" + "".join(f"\\x{b:02x}" for b in missing) + "]") if missing else F.lit(False)


def encoding_report(spark: SparkSession, path: str, encodings: list[str] | None = None) -> DataFrame:
    """(ord, encoding, bad_rows): lines that do not decode, per candidate encoding, all from one scan of the bytes."""
    encodings = encodings or ENCODINGS
    lines = spark.read.option("lineSep", "\n").text(path)
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    counted = lines.select(latin.alias("line")).agg(*[F.count_if(_undecoded(F.col("line"), name)).alias(f"n{i}") for i, name in enumerate(encodings)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("encoding"), F.col(f"n{i}").alias("bad_rows")) for i, name in enumerate(encodings)])))


def detect_encoding(spark: SparkSession, path: str, chosen: str = "utf-8") -> str:
    """First encoding that decodes every line: the chosen one, then the usual ones; one scan tries them all."""
    found = encoding_report(spark, path, [chosen, *[e for e in ENCODINGS if e != chosen]]).where("bad_rows = 0").orderBy("ord").first()
    if found is None:
        raise ValueError("no encoding decodes the file")
    return found["encoding"]


def read_csv_any(spark: SparkSession, path: str, chosen: str = "utf-8", **options) -> tuple[DataFrame, str]:
    encoding = detect_encoding(spark, path, chosen)
    return read_csv(spark, path, encoding=encoding, **options), encoding


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One header per part file; whitespace at the ends of a value is kept."""
    df.write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False,
                            ignoreTrailingWhiteSpace=False, emptyValue="")

"""Column profiles and the rules read off them.

One unpivot and one count per (column, value) feed every per-column fact, so a
wide table is scanned and shuffled once, and a value that fills a third of all
rows is folded into one record before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import is_text, looks_numeric, numeric_columns
from cohortlens.functions.text import normalize_key, quoted
from cohortlens.functions.vocabulary import FILTER_ROLES, NEGATIVE_LABELS, POSITIVE_LABELS, ROLE_ALIASES

from cohortlens.operators.roles import alias_match

LONG_TEXT = 64

# What a date looks like inside a text.
DATE_TEXT = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy",
                "yyyy-M-d H:m:s", "yyyy/M/d H:m:s"]


def parses_as_date(text: Column) -> Column:
    tries = [F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]]
    return F.coalesce(*tries).isNotNull()


def by_name(mapping: dict[str, object], key: str = "column") -> Column:
    """Look a column name up in a small fixed mapping."""
    return F.create_map(*[F.lit(x) for item in mapping.items() for x in item])[F.col(key)]


def cell_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.nullif(F.col(quoted(name)), F.lit(float("nan")).cast(kind))
        return (value + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.col(quoted(name)))
    return F.col(quoted(name)).cast("string")


def unpivot_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with every cell as text."""
    return df.select(*[cell_text(df, c).alias(c) for c in columns]).unpivot([], [F.col(quoted(c)) for c in columns], "column", "value")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): one record per distinct cell value, NULL included."""
    columns = columns or df.columns
    return unpivot_cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _digest_cell(df: DataFrame, name: str) -> Column:
    """Cell text; a long one becomes a digest of the whole text and three test results.

    The three digits say whether the text is a number, holds a date, and parses as one.
    """
    text = cell_text(df, name)
    if not is_text(df, name):
        complex_type = isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.when(F.length(text) > LONG_TEXT, F.concat(F.sha2(text, 256), F.lit("000"))).otherwise(text) if complex_type else text
    dated = text.rlike(DATE_TEXT)
    digits = [looks_numeric(text), dated, dated & parses_as_date(text)]
    marks = [F.when(d, "1").otherwise("0") for d in digits]
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.sha2(text, 256), *marks)).otherwise(text)


def column_profile(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, position, kind, dtype, n_rows, non_null, missing, missing_pct, n_unique,
    numeric_share, date_like, date_parsed), one row per column; ``position`` is the table order.

    ``approx=True`` swaps the exact distinct count for a sketch and drops the
    shuffle of values altogether.
    """
    columns = columns or df.columns
    text = F.col("value")
    long = F.length(text) > LONG_TEXT

    def mark(place: int) -> Column:
        return F.substring(text, LONG_TEXT + place, 1) == "1"

    number = F.when(long, mark(1)).otherwise(looks_numeric(text))
    dated = F.when(long, mark(2)).otherwise(text.rlike(DATE_TEXT))
    parsed = F.when(long, mark(3)).otherwise(text.rlike(DATE_TEXT) & parses_as_date(text))
    textual = F.col("column").isin([c for c in columns if is_text(df, c)])

    def tally(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("value").isNotNull() & condition, F.col("n"))), F.lit(0))

    cells = df.select(*[_digest_cell(df, c).alias(c) for c in columns]).unpivot([], [F.col(quoted(c)) for c in columns], "column", "value")
    if approx:
        counts, unique = cells.withColumn("n", F.lit(1).cast("bigint")), F.approx_count_distinct("value")
    else:
        counts, unique = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), F.count("value")
    facts = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        tally(F.lit(True)).alias("non_null"),
        unique.alias("n_unique"),
        tally(textual & number).alias("n_number"),
        tally(textual & dated).alias("n_date"),
        tally(textual & parsed).alias("n_parsed"),
    )
    static = {f.name: f.dataType for f in df.schema}
    shares = _with_kind(facts.withColumn("base", by_name({c: _base_kind(static[c]) for c in columns})))
    return shares.select(
        "column",
        by_name({c: i for i, c in enumerate(columns)}).alias("position"),
        "kind",
        by_name({c: static[c].simpleString() for c in columns}).alias("dtype"),
        "n_rows",
        "non_null",
        (F.col("n_rows") - F.col("non_null")).alias("missing"),
        (F.lit(100.0) * (F.col("n_rows") - F.col("non_null")) / F.col("n_rows")).alias("missing_pct"),
        "n_unique",
        "numeric_share",
        "date_like",
        "date_parsed",
    )


def _kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, date_like, date_parsed) from one aggregate: no kind depends on distinct values, so no cell leaves its row."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    cells, none = [], F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        base = _base_kind(df.schema[c].dataType)
        if base == "text" and is_text(df, c):
            text = F.col(quoted(c))
            dated = text.rlike(DATE_TEXT)
            aggs += [F.count(text).alias(f"v{i}"), F.count_if(looks_numeric(text)).alias(f"n{i}"), F.count_if(dated).alias(f"d{i}"),
                     F.count_if(F.when(dated, parses_as_date(text)).otherwise(False)).alias(f"p{i}")]
            counts = [F.col(f"{k}{i}") for k in "vndp"]
        else:
            counts = [none] * 4
        cells.append(F.struct(F.lit(c).alias("column"), F.lit(base).alias("base"), F.lit(i).alias("position"),
                              *[x.alias(k) for x, k in zip(counts, ("non_null", "n_number", "n_date", "n_parsed"), strict=True)]))
    facts = df.agg(*aggs).select(F.col("rows").alias("n_rows"), F.inline(F.array(*cells)))
    return _with_kind(facts)


def _base_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "numeric" if isinstance(kind, T.NumericType) else "text"


def _with_kind(facts: DataFrame) -> DataFrame:
    """Shares and the kind that follows from them."""
    shares = facts.select(
        "*",
        F.coalesce(F.try_divide(F.col("n_number").cast("double"), F.col("n_rows")), F.lit(0.0)).alias("numeric_share"),
        F.coalesce(F.try_divide(F.col("n_date").cast("double"), F.col("non_null")), F.lit(0.0)).alias("date_like"),
        F.coalesce(F.try_divide(F.col("n_parsed").cast("double"), F.col("non_null")), F.lit(0.0)).alias("date_parsed"),
    )
    is_date = (F.col("non_null") >= 3) & (F.col("date_like") >= 0.6) & (F.col("date_parsed") >= 0.8)
    return shares.withColumn("kind", F.when(F.col("base") != "text", F.col("base")).when(is_date, "datetime")
                             .when((F.col("non_null") > 0) & (F.col("numeric_share") >= 0.9), "numeric").otherwise("categorical"))


def infer_kind(df: DataFrame) -> DataFrame:
    """(column, kind) in one pass."""
    return _kinds(df, df.columns).select("column", "kind")


def datetime_columns(df: DataFrame) -> DataFrame:
    """Share of date-looking and of parsable values per text column, and the verdict, in one pass."""
    columns = [c for c in df.columns if is_text(df, c)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, date_like double, date_parsed double, is_datetime boolean")
    return _kinds(df, columns).select("column", "date_like", "date_parsed", (F.col("kind") == "datetime").alias("is_datetime"))


def constant_rule() -> Column:
    return F.col("n_unique") <= 1


def high_cardinality_rule(share: float = 0.9) -> Column:
    return (F.col("kind") == "categorical") & (F.col("n_unique") >= F.col("n_rows") * share)


def id_like_rule() -> Column:
    """Named like an identifier and nearly unique."""
    name = F.replace(F.lower("column"), F.lit(" "), F.lit(""))
    named = reduce(lambda a, b: a | b, [name.contains(w) for w in ("id", "employee", "manhanvien", "empid")])
    return named & (F.col("n_unique") >= F.greatest(F.col("n_rows") * 0.9, F.lit(1)))


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.where(constant_rule()).select("column", "n_unique")


def high_cardinality(profile: DataFrame, share: float = 0.9) -> DataFrame:
    return profile.where(high_cardinality_rule(share)).select("column", "n_unique")


def id_like(profile: DataFrame) -> DataFrame:
    return profile.where(id_like_rule()).select("column", "n_unique")


def identifier_rule(df: DataFrame) -> Column:
    """Name is or ends like an identifier, or a text column is almost unique."""
    name = F.regexp_replace(F.lower("column"), r"[^\p{L}\p{N}]", "")
    named = name.rlike("(id|code|number)$")
    numbers = [c for c in df.columns if c in numeric_columns(df)] or [""]
    textual = ~F.col("column").isin(numbers)
    return named | (textual & (F.col("n_unique") >= F.greatest(F.col("non_null"), F.lit(1)) * 0.98))


def identifier_columns(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    profile = column_profile(df) if profile is None else profile
    return profile.where((F.col("n_unique") > 1) & identifier_rule(df)).select("column", "n_unique")


def feature_rule(df: DataFrame, target: str | None, id_col: str | None, junk: list[str] | None) -> Column:
    """Neither target, id nor junk, not constant and not identifier-looking."""
    dropped = [c for c in [target, id_col, *(junk or [])] if c]
    usable = ~constant_rule() & ~identifier_rule(df)
    return usable & ~F.col("column").isin(dropped) if dropped else usable


def number_type_rule(df: DataFrame) -> Column:
    return F.col("column").isin(numeric_columns(df) or [""])


def feature_projection(
    df: DataFrame,
    target: str | None = None,
    id_col: str | None = None,
    junk: list[str] | None = None,
    profile: DataFrame | None = None,
) -> DataFrame:
    """(column, role) of usable features: ``numeric`` by type, else ``categorical``."""
    profile = column_profile(df) if profile is None else profile
    return profile.where(feature_rule(df, target, id_col, junk)).select(
        "column", F.when(number_type_rule(df), "numeric").otherwise("categorical").alias("role")
    )


def suggest_filters(
    df: DataFrame, roles: dict[str, str], max_n: int = 6, profile: DataFrame | None = None
) -> DataFrame:
    """(ord, column): role columns if two or more, then columns of 2 to 20 values."""
    chosen = list(dict.fromkeys(roles[r] for r in FILTER_ROLES if roles.get(r) in df.columns))
    if len(chosen) >= 2:
        rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"))
                         for i, c in enumerate(chosen[:max_n])])
        return df.sparkSession.range(1).select(F.inline(rows))
    profile = column_profile(df) if profile is None else profile
    preferred = F.col("column").isin(chosen) if chosen else F.lit(False)
    fitting = profile.where(preferred | F.col("n_unique").between(2, 20))
    first = F.when(preferred, F.lit(0)).otherwise(F.lit(1))
    ranked = fitting.orderBy(first, "position").limit(max_n)
    listed = ranked.agg(F.array_sort(F.collect_list(F.struct(first.alias("f"), "position", "column"))).alias("l"))
    return listed.select(F.posexplode("l")).select(F.col("pos").alias("ord"), F.col("col.column").alias("column"))


def categorical_uniques(df: DataFrame, max_unique: int = 50, numeric_max: int = 20, sketch: dict[str, int] | None = None) -> DataFrame:
    """(column, n_categories, categories) for columns of few values.

    A sketch per column (``sketch`` if known already) first rules out columns far above the limit, so ids
    and long texts are not shuffled and no list is long; the rest is counted exactly, in one scan.
    """
    numbers = numeric_columns(df)
    limits = {c: min(numeric_max, max_unique) if c in numbers else max_unique for c in df.columns}
    if sketch is None:
        row = df.agg(*[F.approx_count_distinct(cell_text(df, c)).alias(f"d{i}") for i, c in enumerate(df.columns)]).first()
        sketch = {c: row[f"d{i}"] for i, c in enumerate(df.columns)}
    near = [c for c in df.columns if 0 < sketch[c] <= 4 * limits[c]]
    if not near:
        return df.sparkSession.createDataFrame([], "column string, n_categories bigint, categories array<string>")
    counts = value_counts(df, near).where("value IS NOT NULL")
    listed = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_categories"), F.array_sort(F.collect_list("value")).alias("categories"))
    return listed.where(F.col("n_categories") <= by_name({c: limits[c] for c in near}))


def target_candidates(df: DataFrame) -> DataFrame:
    """(column, ord, by_alias, by_labels): columns that read as an outcome, the likeliest first by ``ord``.

    The column that best matches the outcome's names comes first, then two-valued columns with labels or a name of an
    outcome in table order, then other columns that match one of the names, whatever values they have.
    """
    columns = [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    header = df.sparkSession.createDataFrame([(c,) for c in df.columns], "name string")
    aliases = {a: [a] for a in ROLE_ALIASES["target"]}
    # The header has a row for each column; a role and an alias match one of them.
    primary = [r["name"] for r in alias_match(header, "name", {"target": ROLE_ALIASES["target"]}).collect()]
    hits = {r["role"]: r["name"] for r in alias_match(header, "name", aliases).collect()}
    named = list(dict.fromkeys([*primary, *(hits[a] for a in aliases if a in hits)]))
    ends = df.agg(*[F.expr(f"{fn}({quoted(c)}) AS {fn}{i}") for i, c in enumerate(columns) for fn in ("min", "max")])
    # A third value differs from both ends; one more pass counts such rows.
    packed = ends.select(F.struct("*")).scalar()
    third = df.agg(*[
        F.count_if((F.col(quoted(c)) != packed[f"min{i}"]) & (F.col(quoted(c)) != packed[f"max{i}"])).alias(f"t{i}")
        for i, c in enumerate(columns)
    ])
    place = {c: i for i, c in enumerate(df.columns)}
    rows = third.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(-1 if c in primary else place[c]).alias("ord"), F.lit(c in named).alias("named"),
                 F.lit(len(columns) + (named.index(c) if c in named else 0)).alias("later"), packed[f"min{i}"].cast("string").alias("low"),
                 packed[f"max{i}"].cast("string").alias("high"), F.col(f"t{i}").alias("third"))
        for i, c in enumerate(columns)
    ])))
    labels = F.transform(F.array("low", "high"), lambda v: F.lower(F.trim(v)))
    vocabulary = F.array(*[F.lit(v) for v in [*POSITIVE_LABELS, *NEGATIVE_LABELS]])
    names = [normalize_key(F.lit(a)) for a in ROLE_ALIASES["target"]]
    two = (F.col("third") == 0) & (F.col("low") != F.col("high"))
    judged = rows.select(
        "column", "ord", "later", F.coalesce(two, F.lit(False)).alias("two"), "named",
        F.array_contains(F.array(*names), normalize_key(F.col("column"))).alias("same_name"),
        F.coalesce(two & F.arrays_overlap(labels, vocabulary), F.lit(False)).alias("by_labels"),
    )
    early = F.col("by_labels") | (F.col("two") & F.col("same_name"))
    return judged.where(F.col("named") | early).select(
        "column", F.when((F.col("ord") < 0) | early, F.col("ord")).otherwise(F.col("later")).cast("int").alias("ord"),
        (F.col("named") | F.col("same_name")).alias("by_alias"), "by_labels")


def vocabulary_overlap(df: DataFrame, column: str) -> DataFrame:
    """(label, positive): values of a column that the label lists know."""
    distinct = df.select(F.lower(F.trim(F.col(column).cast("string"))).alias("label")).distinct()
    return distinct.where(F.col("label").isin([*POSITIVE_LABELS, *NEGATIVE_LABELS])).select(
        "label", F.col("label").isin(POSITIVE_LABELS).alias("positive")
    )


def data_dictionary(df: DataFrame, target: str, id_col: str, profile: DataFrame | None = None) -> DataFrame:
    profile = column_profile(df) if profile is None else profile
    use = F.when(F.col("column") == target, "Target").when(F.col("column") == id_col, "ID").otherwise("Feature")
    return profile.select("column", use.alias("usage"), "kind", "dtype", "non_null", "missing", "n_unique")

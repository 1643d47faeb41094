"""Missing values, duplicates, invalid numbers, outliers and the quality score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numbers import (
    is_infinite, is_text, looks_numeric, numeric_columns, to_number,
)
from cohortlens.functions.text import quoted
from cohortlens.operators.profile import (
    categorical_uniques, cell_text, column_profile, constant_rule, feature_rule, high_cardinality_rule, id_like_rule,
    number_type_rule, target_candidates,
)
from cohortlens.operators.quantiles import exact_quantiles
from cohortlens.operators.roles import guess_roles, junk_columns


def _missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.col(quoted(name)).isNull() | F.isnan(F.col(quoted(name)))
    return F.col(quoted(name)).isNull()


def _records(wide: DataFrame, fields: dict[str, dict[str, Column]], *extra: str) -> DataFrame:
    """One row per table column out of a one-row aggregate."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("column"), *[c.alias(f) for f, c in cells.items()])
        for name, cells in fields.items()
    ])
    return wide.select(*extra, F.inline(rows))


def comparable(df: DataFrame, name: str) -> Column:
    """The column, a map as the text of its sorted entries: maps can be neither hashed nor grouped."""
    column = F.col(quoted(name))
    if not isinstance(df.schema[name].dataType, T.MapType):
        return column
    return F.when(column.isNotNull(), F.to_json(F.array_sort(F.map_entries(column))))


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row, NULL positions included; rows are not compared further, so two
    different ones count as copies with probability 2^-128 a pair."""
    cols = [comparable(df, c) for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(nulls, *cols).alias("h1"), F.xxhash64(F.lit(7), nulls, *cols).alias("h2")]


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, missing_count, missing_pct), most missing first."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = {c: {"missing_count": F.col(f"m{i}")} for i, c in enumerate(df.columns)}
    return _records(wide, cells, "_rows").select(
        "column", "missing_count",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("missing_count"), F.col("_rows")), F.lit(0.0)).alias("missing_pct"),
    ).orderBy(F.desc("missing_count"), "column")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each identical group.

    Sixteen bytes per row are shuffled instead of the row.
    """
    copies = df.select(*row_fingerprint(df)).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    ).select(
        "n_rows", "duplicate_count",
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("duplicate_count"), F.col("n_rows")), F.lit(0.0)).alias("duplicate_pct"),
    )


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    """One row (id_duplicates): repeated ids; NULL counts as one more id."""
    copies = df.groupBy(comparable(df, id_col)).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("id_duplicates"))


FACTS = ("column string, position int, n_rows bigint, missing bigint, blank bigint, infinite bigint, negative bigint, filled bigint, numbers bigint, "
         "levels bigint, constant boolean, numeric boolean, textual boolean")


def wide_facts(df: DataFrame) -> DataFrame:
    """Every count that the checks below need about single columns, from one scan; one row per column.

    ``filled`` and ``numbers`` are the values of a text column and those that are numbers ("nan" parses to a
    missing number, so it is none); ``levels`` is a sketch; ``constant`` means that the smallest and the
    largest value agree, which needs no distinct count.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    numeric, none = set(numeric_columns(df)), F.lit(0).cast("bigint")
    for i, c in enumerate(df.columns):
        value, text = comparable(df, c), F.col(quoted(c)) if is_text(df, c) else None
        number = F.col(quoted(c)).cast("double") if c in numeric else None
        own = {
            "missing": F.count_if(_missing(df, c)),
            "blank": none if text is None else F.count_if(text.rlike(r"^\s*$")),
            "infinite": none if number is None else F.count_if(is_infinite(number)),
            "negative": none if number is None else F.count_if(number < 0),
            "filled": none if text is None else F.count(text),
            "numbers": none if text is None else F.count_if(looks_numeric(text)),
            "levels": F.approx_count_distinct(cell_text(df, c)),
            "constant": F.coalesce(F.min(value).eqNullSafe(F.max(value)), F.lit(True)),
        }
        aggs.append(F.struct(*[v.alias(k) for k, v in own.items()]).alias(f"c{i}"))
    row = df.agg(*aggs).first()
    facts = [(c, i, row["rows"], *row[f"c{i}"], c in numeric, is_text(df, c)) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(facts, FACTS)


def _number_text() -> Column:
    """A text column of which at least half of all rows are numbers."""
    return F.col("textual") & (F.col("filled") > 0) & (F.col("numbers") >= 0.5 * F.col("n_rows"))


def _invalid(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("numeric") | _number_text()).select(
        "column", F.col("infinite").alias("inf_count"), F.col("negative").alias("negative_count"),
        F.when(F.col("numeric"), F.col("infinite")).otherwise(F.col("filled") - F.col("numbers")).alias("invalid_count"), "n_rows")


def _distinct_numbers(facts: DataFrame) -> dict[str, int]:
    return {r["column"]: r["levels"] for r in facts.where("numeric").select("column", "levels").collect()}  # one for each column


def invalid_numeric(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(column, inf_count, negative_count, invalid_count, invalid_pct).

    Number columns: infinities and negatives.  Text columns where at least half of
    all rows are numbers: values that are not.
    """
    return _invalid(wide_facts(df) if facts is None else facts).select(
        "column", "inf_count", "negative_count", "invalid_count",
        (F.lit(100.0) * F.col("invalid_count") / F.col("n_rows")).alias("invalid_pct"),
    )


def iqr_outliers(df: DataFrame, columns: list[str] | None = None, approx: bool = False, distinct: dict[str, int] | None = None) -> DataFrame:
    """(column, q1, q3, iqr, lower_bound, upper_bound, outlier_count, outlier_pct).

    Two passes: quartiles, then a count outside the fences.  The fences are one
    short row per column and reach the second pass as a scalar.  ``distinct``, about how many different
    numbers each column has, saves the pass that finds out.
    """
    columns = columns or numeric_columns(df)
    values = {c: to_number(df, c) for c in columns}
    if approx:
        probs = F.array(F.lit(0.25), F.lit(0.75))
        wide = df.agg(*[F.percentile_approx(v, probs, F.lit(10_000)).alias(f"q{i}") for i, v in enumerate(values.values())])
        quartiles = _records(wide, {c: {"q": F.col(f"q{i}")} for i, c in enumerate(columns)}).where("q IS NOT NULL")
    else:
        quartiles = exact_quantiles(df, values, [0.25, 0.75], distinct=distinct).select("measure", "q").withColumnRenamed("measure", "column")
    fences = quartiles.select(
        "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lower_bound", F.col("q1") - 1.5 * F.col("iqr")
    ).withColumn("upper_bound", F.col("q3") + 1.5 * F.col("iqr"))
    packed = fences.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "q3", "iqr", "lower_bound", "upper_bound")))).alias("f")
    ).scalar()
    outside = [
        F.count_if((v < packed[c]["lower_bound"]) | (v > packed[c]["upper_bound"])).alias(f"o{i}")
        for i, (c, v) in enumerate(values.items())
    ]
    wide = df.agg(*outside, *[F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())])
    fields = ["q1", "q3", "iqr", "lower_bound", "upper_bound"]
    cells = {
        c: {**{f: packed[c][f] for f in fields}, "outlier_count": F.col(f"o{i}"), "n": F.col(f"n{i}")}
        for i, c in enumerate(columns)
    }
    return _records(wide, cells).where("n > 0").select(
        "column", *fields, "outlier_count", (F.lit(100.0) * F.col("outlier_count") / F.col("n")).alias("outlier_pct")
    )


def validate_dataset(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(check, column, metric, value): missing, duplicate, type, level and number checks.

    Three scans: facts about single columns, copies of rows, and the values of columns with few levels.
    """
    facts = wide_facts(df) if facts is None else facts
    number = lambda c: F.col(c).cast("double").alias("value")
    none = F.lit(None).cast("string").alias("column")
    sketch = {r["column"]: r["levels"] for r in facts.select("column", "levels").collect()}  # one for each column
    parts = [
        facts.select(F.lit("missing").alias("check"), "column", F.lit("missing_count").alias("metric"), number("missing")),
        facts.agg(F.sum("missing").alias("t")).select(
            F.lit("missing").alias("check"), none, F.lit("total_missing").alias("metric"), number("t")),
        duplicate_summary(df).select(F.lit("duplicates").alias("check"), none,
                                     F.lit("duplicate_count").alias("metric"), number("duplicate_count")),
        categorical_uniques(df, sketch=sketch).select(F.lit("levels").alias("check"), "column",
                                        F.lit("n_categories").alias("metric"), number("n_categories")),
        _invalid(facts).select(F.lit("invalid_numeric").alias("check"), "column",
                               F.lit("invalid_count").alias("metric"), number("invalid_count")),
        facts.where("numeric").select(F.lit("numeric_columns").alias("check"), "column", F.lit("non_null").alias("metric"),
                                      (F.col("n_rows") - F.col("missing")).cast("double").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_check(df: DataFrame) -> DataFrame:
    """``validate_dataset`` and the outlier counts in one table; five scans."""
    facts = wide_facts(df)
    outliers = iqr_outliers(df, distinct=_distinct_numbers(facts)).select(
        F.lit("outliers").alias("check"), "column", F.lit("outlier_count").alias("metric"),
        F.col("outlier_count").cast("double").alias("value"),
    )
    return validate_dataset(df, facts).unionByName(outliers)


def _quality_facts(df: DataFrame, id_col: str | None, facts: DataFrame | None = None) -> DataFrame:
    """One row with every count the score and the issue list need."""
    facts = wide_facts(df) if facts is None else facts
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    duplicates = duplicate_summary(df).select("duplicate_count").scalar()
    ids = duplicate_ids(df, id_col).scalar() if id_col else F.lit(0)
    invalid = F.when(_number_text(), F.col("filled") - F.col("numbers"))
    return facts.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("n_cols"), total("missing").alias("missing"),
        total("blank").alias("empty_strings"), total("infinite").alias("inf_count"), total(invalid).alias("invalid_numeric"),
        F.count_if("constant").alias("constant_columns"),
    ).select("*", duplicates.alias("duplicates"), ids.cast("bigint").alias("id_duplicates"))


def quality_score(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """One row: completeness, uniqueness, validity, consistency, score and label."""
    facts = _quality_facts(df, id_col)
    rows = F.greatest(F.col("n_rows"), F.lit(1)).cast("double")
    cells = F.greatest(F.col("n_rows") * F.col("n_cols"), F.lit(1)).cast("double")

    def part(bad: Column, of: Column) -> Column:
        return F.greatest(F.lit(0.0), 100.0 * (1 - bad / of))

    scored = facts.select(
        "*",
        part(F.col("missing") + F.col("empty_strings"), cells).alias("completeness"),
        F.least(part(F.col("duplicates"), rows), part(F.col("id_duplicates"), rows)).alias("uniqueness"),
        part(F.least((F.col("inf_count") + F.col("invalid_numeric")) / rows, F.lit(1.0)), F.lit(1.0)).alias("validity"),
        (100.0 - F.least(F.lit(40.0), F.col("constant_columns") * 8.0)).alias("consistency"),
    ).withColumn(
        "score",
        F.round(0.35 * F.col("completeness") + 0.25 * F.col("uniqueness") + 0.25 * F.col("validity")
                + 0.15 * F.col("consistency"), 1),
    )
    empty = F.col("n_rows") == 0
    label = (
        F.when(empty, "No data").when(F.col("score") >= 90, "Good").when(F.col("score") >= 70, "Fair")
        .otherwise("Needs attention")
    )
    measures = ["completeness", "uniqueness", "validity", "consistency", "score"]
    return scored.select(*[F.when(empty, 0.0).otherwise(F.col(m)).alias(m) for m in measures], label.alias("label"))


def quality_issues(df: DataFrame, id_col: str | None = None, outlier_columns: int | None = None) -> DataFrame:
    """(issue, n) for every kind of problem found."""
    kinds = ["missing", "empty_strings", "duplicates", "id_duplicates", "inf_count", "invalid_numeric",
             "constant_columns"]
    wide = wide_facts(df)
    facts = _quality_facts(df, id_col, wide)
    listed = facts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("issue"), F.col(k).cast("bigint").alias("n")) for k in kinds
    ])))
    columns = numeric_columns(df)[:outlier_columns]
    if columns:
        outliers = iqr_outliers(df, columns, distinct=_distinct_numbers(wide)).agg(F.sum("outlier_count").alias("n")).select(
            F.lit("iqr_outliers").alias("issue"), "n"
        )
        listed = listed.unionByName(outliers)
    return listed.where("n > 0")


def dataset_gate(df: DataFrame, target: str | None = None) -> DataFrame:
    """(check, ok, detail): may this table be analysed at all?  One aggregate decides."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(df.columns)])
    names = F.array(*[F.when(F.col(f"n{i}") == 0, F.lit(c)) for i, c in enumerate(df.columns)])
    empty = F.array_compact(names)
    known = target is None or target in df.columns
    checks = [
        ("not_empty", F.col("rows") > 0, F.col("rows").cast("string")),
        ("two_columns", F.lit(len(df.columns) >= 2), F.lit(str(len(df.columns)))),
        ("target_known", F.lit(known), F.lit(target or "")),
        ("any_value", F.size(empty) < len(df.columns), F.lit("")),
        ("no_empty_column", F.size(empty) == 0, F.array_join(F.slice(empty, 1, 5), ", ")),
    ]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("ok"), d.alias("detail")) for n, ok, d in checks
    ])))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row that changes with the content, whatever the row order: n_rows, n_cols, sum_a, sum_b.

    A multiset hash that other engines can repeat: each row becomes a text of ``length:text`` for its cells (``N`` for
    NULL), and the first two groups of 15 digits of the texts' MD5 are summed, 120 bits together.  Repeated rows
    count as often as they stand.
    """
    cells = [F.when(cell_text(df, c).isNull(), "N").otherwise(F.concat(F.length(cell_text(df, c)).cast("string"), F.lit(":"), cell_text(df, c)))
             for c in df.columns]
    digest = df.select(F.md5(F.concat(*cells)).alias("m"))
    parts = [F.conv(F.substring("m", start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16)]
    return digest.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
                      *[F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(n) for p, n in zip(parts, ("sum_a", "sum_b"), strict=True)])


def _listed(condition: Column) -> Column:
    """Names of the profile rows that meet a condition, in one text."""
    return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("column")))), ",")


def _candidates(df: DataFrame) -> Column:
    return target_candidates(df).agg(F.array_join(F.array_sort(F.collect_list("column")), ",")).scalar()


def profile_dataset(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row: counts per kind, missing cells, duplicates, lists of special columns."""
    profile = column_profile(df) if profile is None else profile
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("numeric", "categorical", "datetime", "boolean")]
    return profile.agg(
        F.max("n_rows").alias("row_count"), F.count(F.lit(1)).alias("column_count"), *kinds,
        F.sum("missing").alias("missing_cells"), _listed(constant_rule()).alias("constant_columns"),
        _listed(high_cardinality_rule()).alias("high_cardinality_columns"), _listed(id_like_rule()).alias("id_columns"),
    ).select(
        "*", duplicate_summary(df).select("duplicate_count").scalar().alias("duplicate_rows"),
        _candidates(df).alias("target_candidates"),
    )


def describe_schema(df: DataFrame, target: str | None = None) -> dict:
    """What a table's columns are for, found from names and values: ``roles`` (role -> column, the outcome under
    "target"), ``junk`` and ``candidates`` for the outcome.  A given ``target`` is kept."""
    roles = guess_roles(df)
    candidates = [r["column"] for r in target_candidates(df).orderBy("ord").collect()]  # a few columns
    roles["target"] = target if target in df.columns else candidates[0] if candidates else None
    junk = [c for c in junk_columns(df) if c != roles["target"]]
    return {"roles": {r: c for r, c in roles.items() if c}, "junk": junk, "candidates": candidates}


def schema_summary(df: DataFrame, roles: dict[str, str] | None = None, junk: list[str] | None = None,
                   profile: DataFrame | None = None) -> DataFrame:
    """One row describing the table as the analysis sees it; roles and junk that are not given are found."""
    profile = column_profile(df) if profile is None else profile
    if roles is None:
        found = describe_schema(df)
        roles, junk = found["roles"], found["junk"] if junk is None else junk
    usable, number = feature_rule(df, roles.get("target"), roles.get("id"), junk), number_type_rule(df)
    named = [j for j in [roles.get("id"), *(junk or [])] if j]
    unused = constant_rule() | F.col("column").isin(named) if named else constant_rule()
    filters = [roles[r] for r in ("department", "location", "gender", "overtime") if roles.get(r)]
    return profile.agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"),
        F.count_if(usable & number).alias("n_numeric"), F.count_if(usable & ~number).alias("n_categorical"),
        F.sum("missing").alias("missing_total"), _listed(unused).alias("junk_columns"),
    ).select(
        "*", duplicate_summary(df).select("duplicate_count").scalar().alias("duplicate_total"),
        _candidates(df).alias("target_candidates"), F.lit(roles.get("target")).alias("target"),
        F.lit(",".join(filters)).alias("filter_columns"),
    )

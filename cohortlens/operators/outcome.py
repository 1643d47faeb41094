"""Event rates, key figures and the eight research questions.

All functions take a table with a 0/1 column ``event`` (see ``target.with_event``),
so the label is mapped once and every measure is a plain aggregate over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import to_number
from cohortlens.operators.quantiles import exact_quantiles

# Which role answers which question.
QUESTION_ROLES = {
    "rq2": "department", "rq3": "overtime", "rq4": "job_satisfaction", "rq5": "income", "rq6": "tenure",
    "rq7": "distance", "rq8_performance": "performance", "rq8_training": "training",
}
MEASURE_QUESTIONS = ["rq5", "rq6", "rq7"]


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole.cast("double")), F.lit(0.0))


def event_rate(df: DataFrame) -> DataFrame:
    """One row (total, leaving, rate); the rate of an empty table is 0."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("event"), F.lit(0)).alias("leaving")
    ).select("total", "leaving", percent(F.col("leaving"), F.col("total")).alias("rate"))


def rate_by_group(df: DataFrame, group: str) -> DataFrame:
    """(group, total, leaving, rate), highest rate first; NULL is a group."""
    return _rates(df, group).orderBy(F.desc("rate"), group)


def _rates(df: DataFrame, group: str) -> DataFrame:
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.sum("event").alias("leaving"))
    return counts.select(group, "total", "leaving", percent(F.col("leaving"), F.col("total")).alias("rate"))


def top_group(df: DataFrame, group: str) -> DataFrame:
    return rate_by_group(df, group).limit(1)


def rate_vs_overall(df: DataFrame, group: str) -> DataFrame:
    """Group rates next to the overall rate, which is summed from the group counts."""
    groups = _rates(df, group)
    overall = groups.agg(percent(F.sum("leaving"), F.sum("total"))).scalar()
    return groups.withColumn("overall_rate", overall).withColumn("diff", F.col("rate") - F.col("overall_rate"))


def group_question(df: DataFrame, group: str) -> DataFrame:
    """``rate_vs_overall`` plus a flag on the top group (rate, then smallest name)."""
    compared = rate_vs_overall(df, group)
    first = compared.orderBy(F.desc("rate"), group).limit(1).select(F.struct(F.col(group).alias("g"), "rate")).scalar()
    return compared.withColumn("is_top", F.col(group).eqNullSafe(first["g"]))


def first_last_level(df: DataFrame, level: str) -> DataFrame:
    """Two rows: the lowest and the highest level with their rates (NULL level left out)."""
    row = F.struct(F.col(level).alias("level"), "total", "leaving", "rate")
    ends = _rates(df, level).where(F.col(level).isNotNull()).agg(
        F.min_by(row, F.col(level)).alias("lowest"), F.max_by(row, F.col(level)).alias("highest")
    )
    sides = F.array(*[F.struct(F.lit(w).alias("which"), F.col(w).alias("row")) for w in ("lowest", "highest")])
    return ends.select(F.inline(sides)).select("which", "row.*")


def kpis(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One row of totals, the rate and four means (NULL where the role is absent)."""
    wanted = {"age": "avg_age", "income": "avg_income", "tenure": "avg_years_company",
              "job_satisfaction": "avg_job_satisfaction"}
    means = [
        F.avg(to_number(df, roles[r])).alias(name) if roles.get(r) in df.columns
        else F.lit(None).cast("double").alias(name)
        for r, name in wanted.items()
    ]
    present = [m for m, r in zip(means, wanted) if roles.get(r) in df.columns]
    absent = [m for m, r in zip(means, wanted) if roles.get(r) not in df.columns]
    totals = df.agg(F.count(F.lit(1)).alias("total_employees"),
                    F.coalesce(F.sum("event"), F.lit(0)).alias("employees_leaving"), *present)
    return totals.select("*", *absent).select(
        "total_employees", (F.col("total_employees") - F.col("employees_leaving")).alias("employees_staying"),
        "employees_leaving", percent(F.col("employees_leaving"), F.col("total_employees")).alias("event_rate"),
        *wanted.values(),
    )


def label_distribution(df: DataFrame, target: str) -> DataFrame:
    """(label, n, pct): share of the non-null labels, most frequent first."""
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", percent(F.col("n"), whole).alias("pct")).orderBy(F.desc("n"), "label")


def measures_by_label(df: DataFrame, target: str, measures: list[str]) -> DataFrame:
    """(measure, label, n, mean, median, std) of measures per raw label.

    Sums come from one aggregate and medians from one ``exact_quantiles``, whatever
    the number of measures; the two tables (a row per label and measure) are joined.
    """
    values = {m: to_number(df, m) for m in measures}
    rows = df.where(F.col(target).isNotNull())
    aggs = [
        a for i, v in enumerate(values.values())
        for a in (F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"))
    ]
    cells = F.array(*[
        F.struct(F.lit(m).alias("measure"), *[F.col(f"{f}{i}").alias(f) for f in ("n", "mean", "std")])
        for i, m in enumerate(measures)
    ])
    sums = rows.groupBy(F.col(target).alias("label")).agg(*aggs).select("label", F.inline(cells))
    medians = exact_quantiles(rows, values, [0.5], by=target).select(
        F.col("grp").alias("label"), "measure", F.col("q")[0].alias("median")
    )
    return sums.join(medians, ["label", "measure"], "left").select("measure", "label", "n", "mean", "median", "std")


def measure_by_label(df: DataFrame, target: str, measure: str, std: bool = False) -> DataFrame:
    """(label, n, mean, median[, std]) of one measure per raw label."""
    table = measures_by_label(df, target, [measure]).drop("measure")
    return table if std else table.drop("std")


def event_mean_compare(df: DataFrame, measures: list[str], medians: bool = False) -> DataFrame:
    """(measure, event_mean, other_mean, diff[, event_median, other_median])."""
    values = {m: to_number(df, m) for m in measures}
    aggs = []
    for i, v in enumerate(values.values()):
        aggs += [F.avg(F.when(F.col("event") == 1, v)).alias(f"e{i}"), F.avg(F.when(F.col("event") == 0, v)).alias(f"o{i}")]
    rows = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(f"e{i}").alias("event_mean"), F.col(f"o{i}").alias("other_mean"))
        for i, m in enumerate(measures)
    ])
    means = df.agg(*aggs).select(F.inline(rows)).withColumn("diff", F.col("event_mean") - F.col("other_mean"))
    if not medians:
        return means
    halves = exact_quantiles(df, values, [0.5], by="event")
    packed = halves.groupBy("measure").agg(
        F.max(F.when(F.col("grp") == 1, F.col("q")[0])).alias("event_median"),
        F.max(F.when(F.col("grp") == 0, F.col("q")[0])).alias("other_median"),
    )
    return means.join(packed, "measure", "left")


def level_rates(df: DataFrame, level: str) -> DataFrame:
    """Rates per level in level order, with the mean level of both classes."""
    value = to_number(df, level)
    means = df.agg(F.struct(
        F.avg(F.when(F.col("event") == 1, value)).alias("e"), F.avg(F.when(F.col("event") == 0, value)).alias("o")
    )).scalar()
    return _rates(df, level).select(
        "*", means["e"].alias("event_mean"), means["o"].alias("other_mean")
    ).orderBy(level)


def role_level_rates(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(role, level, total, leaving, rate) of several category columns in one pass."""
    cells = df.select("event", *[F.col(c).cast("string").alias(r) for r, c in columns.items()]).unpivot(
        ["event"], list(columns), "role", "level"
    )
    counts = cells.groupBy("role", "level").agg(F.count(F.lit(1)).alias("total"), F.sum("event").alias("leaving"))
    return counts.select("role", "level", "total", "leaving", percent(F.col("leaving"), F.col("total")).alias("rate"))


def run_questions(df: DataFrame, roles: dict[str, str], target: str) -> DataFrame:
    """(rq, grp, metric, value) for all questions whose role is present.

    All category questions share one grouped count, all measures one aggregate.
    """
    def tidy(table: DataFrame, rq: Column, group: str, metrics: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return table.select(rq.alias("rq"), F.col(group).cast("string").alias("grp"), F.inline(cells))

    found = {q: roles[r] for q, r in QUESTION_ROLES.items() if roles.get(r) in df.columns}
    measured = {q: c for q, c in found.items() if q in MEASURE_QUESTIONS}
    grouped = {q: c for q, c in found.items() if q not in measured}
    parts = [tidy(label_distribution(df, target), F.lit("rq1"), "label", ["n", "pct"])]
    if grouped:
        parts.append(tidy(role_level_rates(df, grouped), F.col("role"), "level", ["total", "leaving", "rate"]))
    if measured:
        names = {c: q for q, c in measured.items()}
        rq = F.create_map(*[F.lit(x) for item in names.items() for x in item])[F.col("measure")]
        long = tidy(measures_by_label(df, target, list(names)), rq, "label", ["n", "mean", "median", "std"])
        parts.append(long.where((F.col("metric") != "std") | (F.col("rq") == "rq5")))
    return reduce(DataFrame.unionByName, parts)


def question_availability(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(rq, role, available): which questions the table can answer."""
    rows = [("rq1", "target", True), *[(q, r, roles.get(r) in df.columns) for q, r in QUESTION_ROLES.items()]]
    return df.sparkSession.createDataFrame(rows, "rq string, role string, available boolean")

"""Bulk risk scores, their summary, and what-if scenarios over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.bands import decision_label, effect_label, risk_band
from cohortlens.functions.numbers import numeric_columns
from cohortlens.operators.features import FeatureSpec
from cohortlens.operators.zoo import probability_column

Scorer = Callable[[DataFrame], DataFrame]

# The message of a what-if.
WHAT_IF_TEXT = "Trước: %.1f%% (%s) → Sau: %.1f%% (%s) · Δ = %+.1f điểm phần trăm (%s)."


def model_scorer(model: PipelineModel, spec: FeatureSpec) -> Scorer:
    """Add ``probability`` with a fitted pipeline; all input columns stay."""
    def score(df: DataFrame) -> DataFrame:
        spec.require(df)
        columns = [F.col(c) for c in df.columns]
        return model.transform(df).select(*columns, vector_to_array(probability_column(model))[1].alias("probability"))
    return score


def linear_scorer(weights: dict[str, float], intercept: float) -> Scorer:
    """Add ``probability`` of a logistic score with given weights."""
    def score(df: DataFrame) -> DataFrame:
        margin = F.lit(float(intercept))
        for column, weight in weights.items():
            margin = margin + F.col(column).cast("double") * F.lit(float(weight))
        return df.withColumn("probability", 1.0 / (1.0 + F.exp(-margin)))
    return score


def with_risk_fields(scored: DataFrame, event: str = "Có", no_event: str = "Không") -> DataFrame:
    """Add percent (1 digit), band and decision to a table with ``probability``."""
    return scored.select(
        "*", F.round(F.col("probability") * 100, 1).alias("probability_pct"),
        risk_band(F.col("probability")).alias("risk_band"),
        decision_label(F.col("probability"), event, no_event).alias("prediction"),
    )


def batch_score(df: DataFrame, scorer: Scorer, id_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One scored row per input row, id and ``keep`` columns first.  Row-wise: no shuffle."""
    kept = list(dict.fromkeys([c for c in [id_col, *(keep or [])] if c and c in df.columns]))
    return with_risk_fields(scorer(df).select(*kept, "probability"))


def rank_risk(scored: DataFrame, id_col: str, top: int | None = None) -> DataFrame:
    """Riskiest rows first; with ``top`` only those (no full sort)."""
    ordered = scored.orderBy(F.desc("probability"), id_col)
    return ordered.limit(top) if top else ordered


def risk_summary(scored: DataFrame) -> DataFrame:
    """One row: total, rows per band, share of high risk, mean percent."""
    band = F.col("risk_band")
    return scored.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(band == "High").alias("high"),
        F.count_if(band == "Medium").alias("medium"), F.count_if(band == "Low").alias("low"),
        F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(band == "High"), F.count(F.lit(1))), F.lit(0.0)), 1).alias("high_rate"),
        F.round(F.avg("probability_pct"), 1).alias("avg_probability_pct"),
    )


def clean_changes(changes: dict[str, object], numeric: list[str], columns: list[str]) -> dict[str, object]:
    """Drop unknown and blank changes; numbers may carry thousands commas."""
    applied: dict[str, object] = {}
    for column, value in changes.items():
        if column not in columns or value is None or not str(value).strip():
            continue
        try:
            applied[column] = float(str(value).replace(",", "")) if column in numeric else value
        except ValueError:
            raise ValueError(f"{column} needs a number, got {value!r}") from None
    return applied


def _exact(value: object) -> str:
    """A number as typed, without commas, so that long ones keep all digits."""
    return format(Decimal(str(value).replace(",", "").strip()), "f")


def _kept_type(kind: T.DataType, values: list[float]) -> T.DataType:
    """The column's own type; a fraction for a whole-number column widens it to double."""
    fraction = isinstance(kind, T.IntegralType) and any(v != int(v) for v in values)
    return T.DoubleType() if fraction else kind


def scenario_rows(df: DataFrame, scenarios: dict[str, dict[str, object]], columns: list[str]) -> DataFrame:
    """Each row once per scenario, with the scenario's values in place.

    The scenarios are a literal inside the expression, so nothing is joined or
    shuffled: every row unfolds where it is.  Numbers keep their column's type.
    """
    numeric = numeric_columns(df)
    cleaned = {n: clean_changes(c, numeric, columns) for n, c in scenarios.items()}
    touched = [c for c in columns if any(c in changes for changes in cleaned.values())]
    kinds = {c: _kept_type(df.schema[c].dataType, [changes[c] for changes in cleaned.values() if c in changes]) if c in numeric else T.StringType()
             for c in touched}
    literal = F.array(*[
        F.struct(
            F.lit(name).alias("name"),
            F.lit(", ".join(f"{c}={changes[c]}" for c in touched if c in changes)).alias("applied"),
            *[F.lit(_exact(scenarios[name].get(c)) if c in numeric and c in changes else changes.get(c)).cast(kinds[c]).alias(c) for c in touched],
        )
        for name, changes in cleaned.items()
    ])
    unfolded = df.select("*", F.explode(literal).alias("_s"))
    return unfolded.select(
        F.col("_s.name").alias("scenario"), F.col("_s.applied").alias("applied"),
        *[F.coalesce(F.col(f"_s.{c}"), F.col(c).cast(kinds[c])).alias(c) if c in touched else F.col(c) for c in df.columns],
    )


def what_if(df: DataFrame, scorer: Scorer, scenarios: dict[str, dict[str, object]], id_col: str,
            columns: list[str] | None = None) -> DataFrame:
    """(id, scenario, before/after probability, percent and band, delta_pp, effect, applied, message)."""
    columns = columns or [c for c in df.columns if c != id_col]
    before = scorer(df).withColumnRenamed("probability", "probability_before")
    after = scorer(scenario_rows(before, scenarios, columns)).withColumnRenamed("probability", "probability_after")
    pct = {side: F.round(F.col(f"probability_{side}") * 100, 1) for side in ("before", "after")}
    table = after.select(
        id_col, "scenario", "applied", "probability_before", "probability_after",
        pct["before"].alias("pct_before"), pct["after"].alias("pct_after"),
        risk_band(F.col("probability_before")).alias("band_before"),
        risk_band(F.col("probability_after")).alias("band_after"),
        F.round(pct["after"] - pct["before"], 1).alias("delta_pp"),
    ).withColumn("effect", effect_label(F.col("delta_pp")))
    return table.withColumn("message", F.format_string(
        WHAT_IF_TEXT,
        F.col("pct_before"), F.col("band_before"), F.col("pct_after"), F.col("band_after"), F.col("delta_pp"), F.col("effect"),
    ))

"""From free-form labels to a 0/1 event column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numbers import is_numeric
from cohortlens.functions.text import strip_blanks
from cohortlens.functions.vocabulary import NEGATIVE_LABELS, POSITIVE_LABELS


def known_label(df: DataFrame, target: str) -> Column:
    """1 or 0 for labels of the vocabulary (or the numbers 1 and 0), else NULL."""
    if is_numeric(df, target):
        number = F.col(target).cast("double")
        return F.when(number == 1, 1).when(number == 0, 0).cast("int")
    label = F.lower(strip_blanks(F.col(target).cast("string")))
    return F.when(label.isin(POSITIVE_LABELS), 1).when(label.isin(NEGATIVE_LABELS), 0)


def label_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, known, n) per non-null label; ``known`` is its vocabulary value."""
    rows = df.where(F.col(target).isNotNull())
    return rows.groupBy(F.col(target).alias("label"), known_label(df, target).alias("known")).agg(
        F.count(F.lit(1)).alias("n")
    )


def minority_label(df: DataFrame, target: str) -> DataFrame:
    """One row (label, n): the rarer label, the smaller one on a tie."""
    return label_counts(df, target).orderBy("n", "label").limit(1).select("label", "n")


def unmappable_labels(df: DataFrame, target: str) -> DataFrame:
    """(label, n) for labels outside the vocabulary when no two-label rule can help."""
    counts = label_counts(df, target)
    n_labels = counts.agg(F.count(F.lit(1)))
    unknown = counts.where(F.col("known").isNull())
    return unknown.where(n_labels.scalar() != 2).select("label", "n")


def _label_facts(df: DataFrame, target: str) -> Column:
    """Scalar (unknown labels, labels, rarest label) of the label column."""
    return label_counts(df, target).agg(
        F.struct(
            F.count_if(F.col("known").isNull()).alias("unknown"),
            F.count(F.lit(1)).alias("labels"),
            F.min(F.struct("n", "label")).alias("rare"),
        ).alias("facts")
    ).scalar()


def event_value(
    df: DataFrame, target: str, positive: object | None = None, rule: str = "auto"
) -> Column:
    """0/1 column for ``target``; NULL labels stay NULL.

    ``positive`` pins the event label.  ``rule="vocabulary"`` needs no look at
    the data and fails the job on an unknown label.  ``rule="auto"`` adds one
    scalar subquery over the label column: with an unknown label and exactly two
    labels the rarer one is the event, with more the job fails.
    """
    if positive is not None:
        return (F.col(target) == F.lit(positive)).cast("int")
    known = known_label(df, target)
    label = F.col(target).cast("string")
    failure = F.raise_error(F.concat(F.lit("label cannot be mapped to 0/1: "), label)).cast("int")
    if rule == "vocabulary":
        return F.coalesce(known, F.when(F.col(target).isNotNull(), failure))
    facts = _label_facts(df, target)
    return (
        F.when(F.col(target).isNull(), F.lit(None).cast("int"))
        .when(facts["unknown"] == 0, known)
        .when(facts["labels"] == 2, (F.col(target) == facts["rare"]["label"]).cast("int"))
        .otherwise(failure)
    )


def with_event(
    df: DataFrame,
    target: str,
    positive: object | None = None,
    rule: str = "auto",
    name: str = "event",
    null_is_event: int | None = 0,
) -> DataFrame:
    """Add the 0/1 column once, so that all later measures reuse it."""
    value = event_value(df, target, positive, rule)
    if null_is_event is not None:
        value = F.coalesce(value, F.lit(null_is_event))
    return df.withColumn(name, value)


def event_mask(df: DataFrame, target: str, positive: object | None = None) -> Column:
    """Boolean event flag; NULL is no event.

    With an unknown label and exactly two labels the rarer one is the event; of more labels, those
    outside the vocabulary are no event.
    """
    if positive is not None:
        return F.coalesce(F.col(target) == F.lit(positive), F.lit(False))
    facts = _label_facts(df, target)
    rarer = (facts["unknown"] > 0) & (facts["labels"] == 2)
    return F.coalesce(F.when(rarer, F.col(target) == facts["rare"]["label"]).otherwise(known_label(df, target) == 1), F.lit(False))


def event_label(df: DataFrame, target: str, positive: object | None = None,
                rule: str = "auto") -> DataFrame:
    """One row: the original label that stands for the event."""
    flagged = df.select(F.col(target).alias("label"), event_value(df, target, positive, rule).alias("y"))
    return flagged.where("y = 1").agg(F.min("label").alias("event_label"))


def class_counts(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, balanced_weight, positive_weight); at most two rows."""
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.struct(
            F.sum("n").alias("all"),
            F.sum(F.when(F.col(y) == 1, F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(y) == 0, F.col("n")).otherwise(0)).alias("neg"),
        )
    ).scalar()
    ratio = F.coalesce(F.try_divide(totals["neg"].cast("double"), totals["pos"].cast("double")), F.lit(1.0))
    return counts.select(
        y,
        "n",
        (totals["all"] / (F.lit(2.0) * F.col("n"))).alias("balanced_weight"),
        F.when(F.col(y) == 1, F.greatest(ratio, F.lit(1.0))).otherwise(F.lit(1.0)).alias("positive_weight"),
    )


def with_class_weight(df: DataFrame, y: str = "y", scheme: str = "balanced") -> DataFrame:
    """Join the class weight on; the weight side has one row per class."""
    source = {"balanced": "balanced_weight", "positive": "positive_weight"}[scheme]
    weights = class_counts(df, y).select(y, F.col(source).alias("weight"))
    return df.join(F.broadcast(weights), y)


def two_class_guard(df: DataFrame, target: str) -> DataFrame:
    """(check, ok, n_labels): a classifier needs two labels at least."""
    distinct = df.select(target).dropna().distinct().agg(F.count(F.lit(1)).alias("n_labels"))
    return distinct.select(
        F.lit("two_classes").alias("check"), (F.col("n_labels") >= 2).alias("ok"), "n_labels"
    )

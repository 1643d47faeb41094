"""Threshold rules that turn a number into a word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(diff: Column) -> Column:
    """Size of a difference in percentage points."""
    size = F.abs(diff)
    return F.when(size >= 15, "HIGH").when(size >= 5, "MEDIUM").otherwise("LOW")


def overall_severity(rate: Column) -> Column:
    return F.when(rate >= 25, "HIGH").when(rate >= 15, "MEDIUM").otherwise("LOW")


def risk_band(probability: Column) -> Column:
    """Below 30 % Low, below 60 % Medium, else High; NULL stays NULL."""
    pct = probability * 100
    return F.when(pct < 30, "Low").when(pct < 60, "Medium").when(pct >= 60, "High")


def decision_label(probability: Column, event: str = "Có", no_event: str = "Không") -> Column:
    return F.when(probability >= 0.5, event).when(probability < 0.5, no_event)


# Readings of a change in risk.
FALLS, RISES, STEADY = "Giảm rủi ro", "Tăng rủi ro", "Hầu như không đổi"


def effect_label(delta: Column) -> Column:
    """Reading of a change in percentage points after a what-if."""
    return F.when(delta < -0.5, FALLS).when(delta > 0.5, RISES).otherwise(STEADY)

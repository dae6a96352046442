"""Severity label and confidence of an error, given learned thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..plans.rulebook import SEVERITY_LABELS


def severity(error: Column, thresholds: Sequence[float], labels: Sequence[str] = SEVERITY_LABELS) -> Column:
    """The label of the last threshold that the error exceeds."""
    chain = F.lit(labels[0])
    for limit, label in zip(thresholds, labels[1:]):
        chain = F.when(error > limit, label).otherwise(chain)
    return chain


def severity_confidence(error: Column, thresholds: Sequence[float]) -> Column:
    """Distance from the threshold, between 0.1 and 1. Beyond a threshold of zero it is 1."""
    value = F.greatest(F.lit(0.1), 1.0 - error / thresholds[0]) if thresholds[0] else F.lit(0.1)
    for limit in thresholds:
        beyond = F.least(F.lit(1.0), (error - limit) / limit + 0.5) if limit else F.lit(1.0)
        value = F.when(error > limit, beyond).otherwise(value)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), value))

"""Threshold text, comparison, and the outcome of a tick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwatch import model
from tickwatch.functions.jsonpath import text_to_double


def threshold_value(text: Column) -> Column:
    """Threshold text to DOUBLE; NULL when it is not a number."""
    return text_to_double(text)


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """``value operator threshold``; NULL for an unknown operator or threshold.

    Spark orders NaN above every number and equal to itself, so NaN is answered first:
    a comparison with NaN is false.
    """
    result = (
        F.when(operator == "greaterThan", value > threshold)
        .when(operator == "greaterThanOrEqual", value >= threshold)
        .when(operator == "lessThan", value < threshold)
        .when(operator == "lessThanOrEqual", value <= threshold)
        .when(operator == "equal", value == threshold)
    )
    nan = F.isnan(value) | F.isnan(threshold)
    known = operator.isin(model.OPERATORS) & threshold.isNotNull() & value.isNotNull()
    return F.when(known, F.when(nan, False).otherwise(result))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first check that is true, else ``ok``."""
    out = F.lit(model.OK)
    for name, failed in reversed(checks):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out

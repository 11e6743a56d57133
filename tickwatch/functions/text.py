"""Text forms used in messages and payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickwatch.functions.jsonpath import plain_number


def rfc3339(ts: Column) -> Column:
    """UTC time to whole seconds, e.g. ``2024-01-01T00:30:00Z``."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def number_text(value: Column) -> Column:
    """A DOUBLE without exponent and without trailing zeros, e.g. ``4`` or ``0.5``."""
    return plain_number(value.cast("string"))

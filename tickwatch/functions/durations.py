"""Duration text such as ``500ms`` or ``2h30m``."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit -> nanoseconds
UNIT_NANOS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)"
_WHOLE = rf"^[-+]?(0|({_PART})+)$"


def duration_nanos(text: str) -> Column:
    """Duration text to BIGINT nanoseconds; NULL when the text is not a duration.

    ``text`` is a column name or a SQL expression.
    """
    units = ", ".join(f"'{u}', {n}" for u, n in UNIT_NANOS.items())
    # each part is cut to whole nanoseconds before the parts are added
    return F.expr(
        f"""case when ({text}) rlike r'{_WHOLE}' then try_cast(
            if(startswith({text}, '-'), -1, 1) * aggregate(
                zip_with(
                    regexp_extract_all({text}, r'{_PART}', 1),
                    regexp_extract_all({text}, r'{_PART}', 2),
                    (n, u) -> floor(try_cast(n as decimal(28, 9)) * cast(element_at(map({units}), u) as decimal(14, 0)))),
                cast(0 as decimal(38, 0)),
                (total, part) -> cast(total + part as decimal(38, 0)))
            as bigint) end"""
    )


def duration_micros(text: str) -> Column:
    """Duration text to BIGINT microseconds, cut toward zero; NULL when not a duration."""
    return F.call_function("div", duration_nanos(text), F.lit(1000).cast("bigint"))


def parse_micros(text: str) -> int:
    """A positive duration text to microseconds, for windows and intervals at plan time."""
    if not re.fullmatch(rf"\+?({_PART})+", text or ""):
        raise ValueError(f"not a positive duration: {text!r}")
    return sum(int(Decimal(n) * UNIT_NANOS[u]) for n, u in re.findall(_PART, text)) // 1000

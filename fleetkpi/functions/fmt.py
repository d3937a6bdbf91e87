"""Number presentation.

Decimals are rounded on the exact binary value with ties to even. ``format_string`` and
``round`` work on the shortest decimal text with ties away from zero, which prints 2.5 days as
3 instead of 2 and 0.15 as 0.2 instead of 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _shifted(value: Column, digits: int) -> tuple[Column, Column]:
    """value·10^digits as a rounded double and what the rounding left over."""
    total, rest = value, F.lit(0.0)
    for _ in range(digits):
        eight, two = total * 8, total * 2  # both exact
        product = eight + two
        part = product - eight
        left = (eight - (product - part)) + (two - part)
        total, rest = product, rest * 10 + left
    return total, rest


def exact_round(value: Column, digits: int = 0) -> Column:
    number = value.cast("double")
    scaled, rest = _shifted(number, digits)
    low = F.floor(scaled).cast("double")
    tied = scaled - low == 0.5
    whole = (
        F.when(tied & (rest > 0), low + 1).when(tied & (rest < 0), low).otherwise(F.rint(scaled))
    )
    return whole / F.lit(float(10**digits))


def fixed(value: Column, digits: int = 0) -> Column:
    """A number with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def fmt(value: Column, kind: str = "decimal") -> Column:
    """A number as text; null is ``N/A``, unknown kinds print the plain value."""
    number = value.cast("double")
    whole = F.signum(number) * F.floor(F.abs(number))  # towards zero
    text = {
        "percentage": lambda: F.concat(fixed(number * 100, 1), F.lit("%")),
        "decimal": lambda: fixed(number, 2),
        "integer": lambda: F.format_number(whole, 0),
        "days": lambda: F.format_string("%d días", whole.cast("bigint")),
        "hours": lambda: F.concat(fixed(number, 1), F.lit(" hrs")),
    }.get(kind, lambda: value.cast("string"))()
    return F.when(value.isNull(), F.lit("N/A")).otherwise(text)

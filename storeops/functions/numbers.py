"""Rounding and durations, exact from integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_PER_HOUR = 3_600_000
#: Fixed value: flat pay rate in currency units an hour.
HOURLY_RATE = 160


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, negative if the end is first, null if one is missing."""
    return F.timestamp_diff("MILLISECOND", start, end)


def hours(ms: Column) -> Column:
    """Hours to 4 places, half away from zero."""
    return F.round(ms.cast("decimal(20,0)") / F.lit(MS_PER_HOUR), 4).cast("decimal(18,4)")


def cost(ms: Column, rate: int = HOURLY_RATE) -> Column:
    """Cost at the rate to 2 places, half away from zero; computed from the milliseconds, not from rounded hours."""
    return F.round((ms * rate).cast("decimal(20,0)") / F.lit(MS_PER_HOUR), 2).cast("decimal(18,2)")


def whole_cost(ms: Column, rate: int = HOURLY_RATE) -> Column:
    """Cost at the rate to whole units, half up."""
    return F.floor((ms * (2 * rate) + MS_PER_HOUR).cast("decimal(20,0)") / F.lit(2 * MS_PER_HOUR)).cast("bigint")


def round_half_up(x: Column) -> Column:
    """To whole numbers, halves towards plus infinity (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def hours_text(ms: Column) -> Column:
    """Hours as text with 2 places, as the exact binary value of the quotient rounds.

    A quotient can be an exact binary tie only at multiples of 450 seconds;
    those go away from zero, all others as the double's digits say.
    """
    size = F.abs(ms)
    tied = F.round(size.cast("decimal(20,0)") / F.lit(MS_PER_HOUR), 2).cast("decimal(18,2)").cast("string")
    other = F.call_function("format_number", size.cast("double") / F.lit(float(MS_PER_HOUR)), F.lit("0.00"))
    return F.concat(F.when(ms < 0, "-").otherwise(""), F.when(size % 450_000 == 0, tied).otherwise(other))

"""Column expressions shared by the operators; timestamps are naive UTC (TIMESTAMP_NTZ)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.plans.ranges import DateRange

# Heart-rate zones, inclusive bounds.
ZONES = {"Z1": (0, 114), "Z2": (115, 125), "Z3": (126, 140), "Z4": (141, 155), "Z5": (156, 1000)}


def within(c: str | Column, r: DateRange | None) -> Column:
    """Range filter as literals that reach the scan."""
    if r is None:
        return F.lit(True)
    c = F.col(c) if isinstance(c, str) else c
    low, high, closed = r.bounds()
    upper = F.lit(high).cast("timestamp_ntz")
    return (c >= F.lit(low).cast("timestamp_ntz")) & ((c <= upper) if closed else (c < upper))


def epoch(c: str | Column) -> Column:
    """Seconds since 1970 with fraction."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def seconds_crossed(start: str | Column, end: str | Column) -> Column:
    """Second boundaries between two timestamps, not elapsed time cut off."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(as_col(end).cast("timestamp")) - F.unix_seconds(as_col(start).cast("timestamp"))


def night(c: str) -> Column:
    """The date of the evening on which a night began."""
    return F.to_date(F.col(c) - F.expr("INTERVAL 12 HOURS"))


def in_zone(bpm: str | Column, zone: str) -> Column:
    low, high = ZONES[zone]
    return (F.col(bpm) if isinstance(bpm, str) else bpm).between(low, high)


def zone_of(bpm: str) -> Column:
    """The zone's name; null between zones."""
    c = F.lit(None).cast("string")
    for name in ZONES:
        c = F.when(in_zone(bpm, name), name).otherwise(c)
    return c


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def half_up(c: Column) -> Column:
    """Rounds halves upwards, for negative numbers too."""
    return F.floor(c + 0.5)


def shown(c: Column, digits: int | None) -> Column:
    """A value as results show it: rounded, unless all its digits are asked for. Rounding a double goes through decimal text, so queries that return pairs round the samples instead."""
    return c if digits is None else F.round(c, digits)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in it several times but is computed once; generated code would repeat it and grow too long."""
    return F.transform(F.array(value), body)[0]


#: Splits a double into two halves whose products are exact.
_HALF = float((1 << 27) + 1)


def _beyond(x: Column, product: Column, scale: float) -> Column:
    """What the rounded ``product`` of ``x`` and ``scale`` lacks, exactly, from products of halves."""
    high = _HALF * scale - (_HALF * scale - scale)
    low = scale - high
    x_high = x * _HALF - (x * _HALF - x)
    x_low = x - x_high
    return ((x_high * high - product) + x_high * low + x_low * high) + x_low * low


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals; null stays null.

    The double's exact value decides, as if all its binary digits were written out: 1.005 lies below its text and gives
    1.00, while 0.25 is a real tie and goes away from zero.
    """
    scale = float(10**digits)

    def units(x: Column) -> Column:
        product = x * scale
        down = F.floor(product)
        return (down + F.floor((product - down.cast("double") - 0.5) + _beyond(x, product, scale)) + 1).cast("string")

    def pointed(u: Column) -> Column:
        padded = F.lpad(u, F.greatest(F.length(u), F.lit(digits + 1)), "0")
        return F.concat(F.substring(padded, F.lit(1), F.length(padded) - digits), F.lit("."), F.right(padded, F.lit(digits)))

    def text(v: Column) -> Column:
        size = F.abs(v)
        whole = units(size)
        plain = F.concat(F.when(v < 0, "-").otherwise(""), bound(whole, pointed) if digits else whole)
        return F.when(F.isnan(v) | (size * scale >= float(1 << 62)), F.format_string(f"%.{digits}f", v)).otherwise(plain)

    return F.when(c.isNotNull(), bound(c.cast("double"), text))


def fixed_number(c: Column, digits: int) -> Column:
    """The number that ``fixed`` writes."""
    return fixed(c, digits).cast("double")


def signed(c: Column, digits: int, unit: str = "") -> Column:
    return F.when(c.isNotNull(), F.concat(F.when(c > 0, "+").otherwise(""), fixed(c, digits), F.lit(unit)))


def pace_text(seconds: Column) -> Column:
    """m:ss/km; seconds are rounded after minutes are taken off, so 60 can appear."""
    return F.when(seconds.isNull(), "unknown").otherwise(
        F.format_string("%d:%02d/km", F.floor(seconds / 60).cast("long"), half_up(seconds % 60).cast("long"))
    )


def trend(current: Column, baseline: Column, higher_is_better: bool = True, flat: float = 0.03) -> Column:
    """improving, declining, flat or insufficient_data."""
    delta = current - baseline
    share = delta / F.abs(baseline)
    better = (share > 0) if higher_is_better else (share < 0)
    missing = current.isNull() | baseline.isNull() | F.isnan(current) | F.isnan(baseline)
    return (
        F.when(missing, "insufficient_data")
        .when(baseline == 0, F.when(delta == 0, "flat").otherwise("insufficient_data"))
        .when(F.abs(F.when(baseline != 0, share)) < flat, "flat")
        .when(F.when(baseline != 0, better), "improving")
        .otherwise("declining")
    )

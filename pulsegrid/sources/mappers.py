"""Units, numbers, dates and keys of export rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schemas import SLEEP_STATES

#: What counts as a number; Spark's cast alone takes more (``1d``) than is meant.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WORKOUT_PREFIX = "HKWorkoutActivityType"


def moment(text: Column) -> Column:
    """An export date in UTC without zone; a missing offset means UTC; anything else raises."""
    pattern = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2})(?: ([+-]\d{4}))?$"
    clean = F.trim(text)
    with_zone = F.concat_ws(" ", F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2), F.when(F.regexp_extract(clean, pattern, 3) == "", "+0000").otherwise(F.regexp_extract(clean, pattern, 3)))
    value = F.when(clean.rlike(pattern), F.try_to_timestamp(with_zone, F.lit("yyyy-MM-dd HH:mm:ss Z")))
    checked = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("not an export date: "), F.coalesce(text, F.lit("null")))).cast("timestamp"))
    return checked.cast("timestamp_ntz")


def number(text: Column) -> Column:
    """A finite number, or null."""
    clean = F.trim(text)
    value = F.when(clean.rlike(NUMBER), clean.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def _scaled(value: Column, unit: Column, factors: dict[str, tuple[str, float]], lower: bool = True) -> Column:
    unit = F.lower(F.trim(unit)) if lower else unit
    out = F.when(unit.isNull(), value)
    for names, (op, factor) in factors.items():
        out = out.when(unit.isin(names.split()), value * factor if op == "*" else value / factor)
    return out


# Units and their factors.
def meters(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, {"m": ("*", 1.0), "km": ("*", 1000.0), "mi": ("*", 1609.344), "ft": ("*", 0.3048)})


def kcal(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, {"kcal cal": ("*", 1.0), "kj": ("/", 4.184)})


def meters_per_second(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, {"m/s": ("*", 1.0), "km/h km/hr": ("/", 3.6), "mph mi/h mi/hr": ("*", 0.44704)})


def length(value: Column, unit: Column) -> Column:
    return _scaled(value, unit, {"m": ("*", 1.0), "cm": ("/", 100.0), "mm": ("/", 1000.0), "km": ("*", 1000.0)})


def seconds(value: Column, unit: Column) -> Column:
    """Case counts; null without a unit."""
    return F.when(unit.isin("s", "sec"), value).when(unit == "min", value * 60.0).when(unit.isin("h", "hr"), value * 3600.0)


def contact_ms(value: Column, unit: Column) -> Column:
    unit = F.lower(F.trim(unit))
    return F.when(unit.isin("s", "sec"), value * 1000.0).otherwise(value)


def sleep_state(raw: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (state, _) in SLEEP_STATES.items():
        out = F.when(raw == name, state).otherwise(out)
    return out


def text_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")


def workout_type(raw: Column) -> Column:
    return F.when(raw.startswith(WORKOUT_PREFIX), F.expr(f"substring(type, {len(WORKOUT_PREFIX) + 1})")).otherwise(raw)


def workout_id(raw_type: Column, start: Column, end: Column) -> Column:
    return F.sha1(F.concat_ws("|", raw_type, text_of(start), text_of(end)).cast("binary"))


def dedup_key(kind: Column, start: Column, end: Column, token: Column, source: Column) -> Column:
    """Null parts are empty."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (kind, text_of(start), text_of(end), token, source)]
    return F.concat_ws("|", *parts)


def prefix_number(text: Column) -> Column:
    """The number that a text begins with."""
    return F.regexp_extract(F.trim(text), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")

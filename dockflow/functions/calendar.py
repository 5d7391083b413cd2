"""Time of day, date and season expressions.

All timestamps are TIMESTAMP_NTZ holding GMT wall-clock time, so no result
depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import SEASONS, SLOT_MINUTES, WEEKDAYS, WEEKEND


def epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def from_epoch_millis(ms: Column) -> Column:
    return F.timestamp_add("MILLISECOND", ms, epoch())


def to_epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(), ts)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)


def slot_of(ts: Column, minutes: int = SLOT_MINUTES) -> Column:
    """Minutes since midnight, floored to the slot length."""
    inside = F.floor(F.minute(ts) / F.lit(minutes)) * minutes
    return (F.hour(ts) * 60 + inside).cast("int")


def hour_of(slot: Column) -> Column:
    return F.floor(slot / F.lit(60)).cast("int")


def minute_of(slot: Column) -> Column:
    return (slot % 60).cast("int")


def time_text(slot: Column) -> Column:
    """``H:MM:00`` with an unpadded hour."""
    return F.concat(hour_of(slot).cast("string"), F.lit(":"), _two(minute_of(slot)), F.lit(":00"))


def hour_label(time: Column) -> Column:
    """``H:MM`` of a ``H:MM:SS`` text."""
    return F.regexp_substr(time, F.lit(r"\d+:\d+"))


def slot_of_text(time: Column) -> Column:
    """Minutes since midnight of a ``H:MM[:SS]`` text; NULL if it is none."""
    parts = F.split(time, ":")
    hour = F.try_element_at(parts, F.lit(1)).try_cast("int")
    minute = F.try_element_at(parts, F.lit(2)).try_cast("int")
    return hour * 60 + minute


def half_hour_text(slot: Column) -> Column:
    """``HH:00`` or ``HH:30``, zero padded."""
    half = F.when(minute_of(slot) < 30, F.lit("00")).otherwise(F.lit("30"))
    return F.concat(_two(hour_of(slot)), F.lit(":"), half)


def is_full_hour(time: Column) -> Column:
    return time.rlike(r"\d{2}:00")


def weekday_name(date: Column) -> Column:
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return F.element_at(names, F.weekday(date) + 1)


def weekday_ord(name: Column) -> Column:
    return _position(WEEKDAYS, name)


def season(date: Column) -> Column:
    month = F.month(date)
    return (
        F.when(month.isin(11, 12, 1), SEASONS[0])
        .when(month.isin(2, 3, 4), SEASONS[1])
        .when(month.isin(5, 6, 7), SEASONS[2])
        .when(month.isNotNull(), SEASONS[3])
    )


def season_ord(name: Column) -> Column:
    return _position(SEASONS, name)


def day_part(hour: Column) -> Column:
    return (
        F.when((hour >= 5) & (hour < 12), "Morning")
        .when((hour >= 12) & (hour < 19), "Afternoon")
        .when(hour >= 19, "Night")
        .when(hour < 5, "Late night")
    )


def map_part(hour: Column) -> Column:
    """The three part-of-day bands of the map tables; other hours are NULL."""
    return (
        F.when(hour.between(5, 10), "morning")
        .when(hour.between(11, 16), "afternoon")
        .when(hour.between(17, 22), "evening")
    )


def is_weekend(weekday: Column) -> Column:
    return weekday.isin(*WEEKEND)


def day_type(weekday: Column) -> Column:
    return F.when(is_weekend(weekday), "weekend").otherwise("weekday")


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def _position(levels: list[str], value: Column) -> Column:
    """0-based place in an ordered category; an unknown level is NULL."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), value)
    return F.when(place > 0, (place - 1).cast("int"))

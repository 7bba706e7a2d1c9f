"""Scalar functions over capture data, boxes, marks and times, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds from which a difference is told in the unit, the seconds of the unit, its name.
RELATIVE_UNITS = [(360 * 86400, 365 * 86400, "years"), (28 * 86400, 30 * 86400, "months"), (7 * 86400, 7 * 86400, "weeks"), (86400, 86400, "days"), (3600, 3600, "hours"), (60, 60, "minutes"), (10, 1, "seconds")]


def capture_seconds(text: Column) -> Column:
    """Epoch seconds of an RFC 3339 time, or of `YYYY:MM:DD HH:MM:SS` in the session's zone; else null."""
    zoned = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(text).try_cast("timestamp"))
    plain = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}:\d\d:\d\d \d\d:\d\d:\d\d)( |$)", 1), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.unix_seconds(F.coalesce(zoned, plain))


def calendar_range(year: int, month: int = -1, day: int = -1) -> tuple[Column, Column]:
    """[start, end) in epoch seconds of a year, month or day in the session's zone; -1 leaves a part open."""
    start = F.make_date(F.lit(year), F.lit(max(month, 1)), F.lit(max(day, 1) if month != -1 else 1))
    end = F.add_months(start, 12) if month == -1 else F.add_months(start, 1) if day == -1 else F.date_add(start, 1)
    return tuple(F.unix_seconds(d.cast("timestamp")) for d in (start, end))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, direction: Column) -> Column:
    """Degrees, minutes and seconds as one number, negative to the south and west."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(direction.isin("S", "W"), -value).otherwise(value)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A place on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def hash_hex(value: Column) -> Column:
    """A 64-bit pattern as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def rotation(now: Column, change: Column) -> Column:
    """A rotation after a change, from 0 to 359."""
    return F.pmod(F.coalesce(now, F.lit(0)) + change, F.lit(360))


def clamp(value: Column, low: int, high: int) -> Column:
    """The value within bounds; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes with x, y, w and h; 0 if apart or empty."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    tall = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    shared = F.greatest(wide, F.lit(0.0)) * F.greatest(tall, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def motion_mark(text: Column) -> tuple[Column, Column]:
    """Offset and length of `motion:<offset>:<length>`; null for other texts."""
    part = lambda n: F.regexp_extract(text, r"^motion:(\d+):(\d+)$", n).try_cast("long")
    return part(1), part(2)


def relative_time(seconds: Column, now: Column) -> tuple[Column, Column]:
    """(count, unit) of the distance to now, rounded down; `just now` under ten seconds; null for null or 0."""
    away = F.abs(now - seconds)
    count, unit = F.lit(0).cast("long"), F.lit("just now")
    for least, size, name in reversed(RELATIVE_UNITS):
        count = F.when(away >= least, F.floor(away / size)).otherwise(count)
        unit = F.when(away >= least, name).otherwise(unit)
    known = F.coalesce(seconds, F.lit(0)) != 0
    return F.when(known, count), F.when(known, unit)

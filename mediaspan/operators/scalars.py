"""Registered queries of the scalar functions, each over the whole library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaspan.functions import media
from mediaspan.plans.catalog import Library
from mediaspan.plans.registry import query, register

#: The moment that relative times are told from: the first of 1999.
NOW = 915148800


@query("X4_capture_seconds", "select id, taken_date as taken_seconds from v_files")
def capture(lib: Library) -> DataFrame:
    """Dates written as EXIF or RFC 3339 text, as metadata have them, read back."""
    at = F.timestamp_seconds("taken_date")
    text = F.when(F.col("id") % 2 == 0, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return lib.files.select("id", media.capture_seconds(text).alias("taken_seconds"))


_RANGES = [("year", (1995,), "1995-01-01", "1996-01-01"), ("month", (1995, 12), "1995-12-01", "1996-01-01"), ("day", (1996, 2, 29), "1996-02-29", "1996-03-01")]


@query("X5_calendar_ranges", "select " + ", ".join(f"count(*) filter (where make_timestamp(taken_date * 1000000) >= timestamp '{a}' and make_timestamp(taken_date * 1000000) < timestamp '{b}') n_{name}" for name, _, a, b in _RANGES) + " from v_files")
def in_ranges(lib: Library) -> DataFrame:
    inside = lambda start, end: F.count_if((F.col("taken_date") >= start) & (F.col("taken_date") < end))
    return lib.files.agg(*[inside(*media.calendar_range(*parts)).alias(f"n_{name}") for name, parts, _, _ in _RANGES])


@query("X6_decimal_degrees", "select id, round(gps_latitude + 90, 6) lat from v_files")
def degrees(lib: Library) -> DataFrame:
    """Latitudes taken apart into degrees, minutes and seconds, and put together."""
    size = F.abs("gps_latitude")
    minutes = (size - F.floor(size)) * 60
    side = F.when(F.col("gps_latitude") < 0, "S").otherwise("N")
    return lib.files.select("id", F.round(media.decimal_degrees(F.floor(size), F.floor(minutes), (minutes - F.floor(minutes)) * 60, side) + 90, 6).alias("lat"))


@query("X7_unit_vector", "select id, round(cos(radians(gps_latitude)) * cos(radians(gps_longitude)) + 2, 6) x, round(cos(radians(gps_latitude)) * sin(radians(gps_longitude)) + 2, 6) y, round(sin(radians(gps_latitude)) + 2, 6) z from v_files where gps_latitude is not null and gps_longitude is not null")
def vectors(lib: Library) -> DataFrame:
    found = media.unit_vector(F.col("gps_latitude"), F.col("gps_longitude"))
    placed = lib.files.where(F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull())
    return placed.select("id", *[F.round(c + 2, 6).alias(name) for name, c in zip("xyz", found, strict=True)])


register("X15_hash_hex", lambda lib: lib.files.select("id", media.hash_hex((F.col("id") - 1000) * 2654435761).alias("hex")), "select id, lpad(lower(to_hex((id - 1000) * 2654435761)), 16, '0') hex from v_files")
register("X17_rotation", lambda lib: lib.files.select("id", media.rotation(F.col("rotate"), (F.col("id") % 9).cast("int") * 90 - 450).alias("turned")), "select id, cast(((rotate + (id % 9) * 90 - 450) % 360 + 360) % 360 as int) turned from v_files")
register("X18_rating_clamp", lambda lib: lib.files.select("id", media.clamp(F.col("rating") + (F.col("id") % 9).cast("int") - 4, 0, 5).alias("stars")), "select id, cast(least(5, greatest(0, rating + id % 9 - 4)) as int) stars from v_files")


@query("X21_box_overlap", "select file_id, sum(cast(floor(case when shared > 0 then shared / (2 * w * h - shared) else 0 end * 1000000000) as bigint)) / 1000000000::double shared from (select file_id, w, h, greatest(w - file_id % 20, 0) * greatest(h - 1, 0) shared from v_faces) group by 1")
def overlaps(lib: Library) -> DataFrame:
    """Each face's box against the same box, moved; billionths are added, so the sum is the same in any order."""
    box = {"x": F.lit(0.0), "y": F.lit(0.0), "w": F.col("w").cast("double"), "h": F.col("h")}
    moved = box | {"x": (F.col("file_id") % 20).cast("double"), "y": F.lit(1.0)}
    return lib.faces.groupBy("file_id").agg((F.sum(F.floor(media.overlap(box, moved) * 1000000000)) / 1000000000.0).alias("shared"))


@query("X31_motion_marks", "select id, case when live_photo_type = 3 then size end as mark_offset, case when live_photo_type = 3 then id end as mark_length from v_files")
def motion_marks(lib: Library) -> DataFrame:
    mark = F.when(F.col("live_photo_type") == 3, F.concat(F.lit("motion:"), F.col("size").cast("string"), F.lit(":"), F.col("id").cast("string"))).otherwise(F.col("content_id"))
    at, length = media.motion_mark(mark)
    return lib.files.select("id", at.alias("mark_offset"), length.alias("mark_length"))


@query(
    "X39_relative_time",
    f"""select id, case when s < 10 then 0 when s < 60 then s when m < 60 then m when h < 24 then h when d < 7 then d when d // 7 < 4 then d // 7 when d // 30 < 12 then d // 30 else d // 365 end n,
        case when s < 10 then 'just now' when s < 60 then 'seconds' when m < 60 then 'minutes' when h < 24 then 'hours' when d < 7 then 'days' when d // 7 < 4 then 'weeks' when d // 30 < 12 then 'months' when d is not null then 'years' end unit
    from (select id, s, s // 60 m, s // 3600 h, s // 86400 d from (select id, abs({NOW} - taken_date) // (id % 5 * id % 7 * 1000 + 1) s from v_files))""",
)
def relative_times(lib: Library) -> DataFrame:
    """Distances from seconds to years: those of the taken dates, divided."""
    away = F.expr(f"abs({NOW} - taken_date) div (id % 5 * id % 7 * 1000 + 1)")
    count, unit = media.relative_time(F.lit(NOW) - away, F.lit(NOW))
    return lib.files.select("id", count.alias("n"), unit.alias("unit"))
